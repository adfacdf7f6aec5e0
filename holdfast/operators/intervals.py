"""Unions of intervals: what is covered, counted once however often it is held."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.ordering import ROWS_PER_TASK, running_max
from holdfast.scale import durable


def _reduced(intervals: DataFrame, group: Sequence[str], lo: str, hi: str) -> DataFrame:
    """The longest interval of each start, and how many start there. Empty ones and those with a bound missing are none."""
    real = intervals.filter((F.col(lo) < F.col(hi)) & ~F.isnan(lo) & ~F.isnan(hi))
    return real.groupBy(*group, F.col(lo).alias("lo")).agg(F.max(hi).alias("hi"), F.count(F.lit(1)).alias("blocks"))


def islands(intervals: DataFrame, group: Sequence[str], lo: str, hi: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(group, lo, hi, blocks): the stretches that the intervals [lo, hi) of a group cover, with the intervals in each.

    Intervals that touch are one stretch. Of those that start at one place only the longest travels.
    In the order of their starts, a stretch begins at an interval that starts after the end of all before
    it; that start is then the largest begun so far. Both are running maxima, which ``running_max`` carries
    over the slices of a group that is longer than a task.
    """
    group = list(group)
    starts = durable(_reduced(intervals, group, lo, hi))
    reach = durable(running_max(starts, group, [F.col("lo")], {"_reach": F.col("hi")}, rows_per_task, before=True))
    begun = F.when(F.col("_reach").isNull() | (F.col("lo") > F.col("_reach")), F.col("lo"))
    placed = running_max(reach, group, [F.col("lo")], {"_begun": begun}, rows_per_task)
    return placed.groupBy(*group, "_begun").agg(F.max("hi").alias("hi"), F.sum("blocks").alias("blocks")).select(
        *group, F.col("_begun").alias("lo"), "hi", "blocks")


def union_width(intervals: DataFrame, group: Sequence[str], lo: str, hi: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per group: ``blocks``, the ``summed`` width of all, the ``width`` of their union and its ``stretches``.

    ``summed`` counts what is held twice twice, ``width`` once.
    """
    group = list(group)
    stretches = islands(intervals, group, lo, hi, rows_per_task)
    union = stretches.groupBy(*group).agg(F.sum("blocks").alias("blocks"), F.sum(F.col("hi") - F.col("lo")).alias("width"),
                                          F.count(F.lit(1)).alias("stretches"))
    real = (F.col(lo) < F.col(hi)) & ~F.isnan(lo) & ~F.isnan(hi)
    summed = intervals.filter(real).groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(
        F.sum(F.col(hi) - F.col(lo)).alias("summed"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return union.join(summed, same).select(*group, "blocks", "summed", "width", "stretches")


def gaps(stretches: DataFrame, lo: str = "lo", hi: str = "hi", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(lo, hi): what lies between the stretches of one group, before the first (lo NULL) and after the last (hi NULL)."""
    ends = stretches.select(F.col(lo).alias("at"), F.lit(True).alias("begins")).unionByName(
        stretches.select(F.col(hi).alias("at"), F.lit(False).alias("begins")))
    ends = durable(ends)
    before = running_max(ends, [], [F.col("at")], {"_from": F.when(~F.col("begins"), F.col("at"))}, rows_per_task, before=True)
    inner = before.filter("begins").select(F.col("_from").alias("lo"), F.col("at").alias("hi"))
    after = ends.agg(F.max("at").alias("lo")).select("lo", F.lit(None).cast("double").alias("hi"))
    return inner.unionByName(after)
