"""Ordinal pairing: the two sorted lists of a group, paired position by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numbers import half_up
from holdfast.operators.ordering import ROWS_PER_TASK, position
from holdfast.scale import durable


def ordinal_pairs(df: DataFrame, group: Sequence[str], value: str, first: Column,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(group, position, first, second): the n-th smallest value of either side of each group.

    ``first`` says which side a row is on. The shorter list ends the pairing. Both sides meet in
    one aggregation on (group, position): no self join. Groups that fit a task are dealt once, and
    that serves the order and the meeting; a long one is cut into slices, by value and, as one value
    may fill many slices, by row.
    """
    sides = df.filter(F.col(value).isNotNull()).select(
        *group, F.col(value).alias("_value"), F.coalesce(first, F.lit(False)).alias("_first"))
    longest = sides.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest <= rows_per_task:
        order = Window.partitionBy(*group, "_first").orderBy("_value")
        placed = sides.repartition(*group).withColumn("position", F.row_number().over(order).cast("long"))
    else:
        sides = durable(sides.withColumn("_row", F.monotonically_increasing_id()))
        placed = position(sides, [*group, "_first"], [F.col("_value").asc(), F.col("_row").asc()], "position",
                          rows_per_task=rows_per_task)
    met = placed.groupBy(*group, "position").agg(
        F.max(F.when(F.col("_first"), F.col("_value"))).alias("first"),
        F.max(F.when(~F.col("_first"), F.col("_value"))).alias("second"))
    return met.filter(F.col("first").isNotNull() & F.col("second").isNotNull())


def gaps(pairs: DataFrame, unit: float = 1e6) -> DataFrame:
    """Pairs with a gap, in thousandths of ``unit``; equal values are no pair."""
    gap = F.abs(F.col("first") - F.col("second"))
    return pairs.filter(gap != 0).withColumn("gap", half_up(gap / F.lit(unit), 3))


def gap_histogram(pairs_with_gap: DataFrame) -> DataFrame:
    """Pairs per gap."""
    return pairs_with_gap.groupBy("gap").agg(F.count(F.lit(1)).alias("pairs"))


def pairing_totals(df: DataFrame, pairs_with_gap: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups that could pair, and groups with at least one pair: a (metric, n) table."""
    def count(table: DataFrame, name: str) -> DataFrame:
        return (table.select(*group).distinct().agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(name).alias("metric"), "n"))
    return count(df, "groups").unionByName(count(pairs_with_gap, "paired_groups"))


def top_pairs(pairs_with_gap: DataFrame, k: int = 900, unit: float = 1e6) -> DataFrame:
    """The ``k`` commonest (low, high) value pairs, in thousandths of ``unit``."""
    step = unit / 1e3
    low = F.floor(F.least("first", "second") / F.lit(step) + 0.5) / F.lit(1e3)
    high = F.floor(F.greatest("first", "second") / F.lit(step) + 0.5) / F.lit(1e3)
    counted = pairs_with_gap.groupBy(low.alias("low"), high.alias("high")).agg(F.count(F.lit(1)).alias("links"))
    return counted.orderBy(F.desc("links"), "low", "high").limit(k)
