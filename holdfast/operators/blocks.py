"""Interval blocks held in areas, without counting the same block once per place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import half_up
from holdfast.operators.ordering import best, share_of_group, top


def named_areas(areas: DataFrame, name: str, placeholder: str | None) -> DataFrame:
    """Areas with a real name: not blank and not matching the placeholder pattern (case ignored)."""
    named = areas.filter(F.col(name).isNotNull() & (F.col(name) != ""))
    return named if placeholder is None else named.filter(~F.col(name).rlike(f"(?i){placeholder}"))


def block_holdings(blocks: DataFrame, *, market: str, band: str, holder: str, licence: str,
                   lower: Column, upper: Column) -> DataFrame:
    """Lower, upper and total width and distinct licences per (market, band, holder).

    ``blocks`` has one row per block: a (licence, area) key may carry several, all of them held.
    """
    per = blocks.groupBy(market, band, holder, licence).agg(
        F.sum(lower).alias("_lower"), F.sum(F.coalesce(upper, F.lit(0.0))).alias("_upper"))
    held = per.groupBy(market, band, holder).agg(
        F.sum("_lower").alias("_lower"), F.sum("_upper").alias("_upper"), F.count(F.lit(1)).alias("licences"))
    return held.select(market, band, holder, half_up(F.col("_lower") + F.col("_upper"), 3).alias("width"),
                       half_up(F.col("_lower"), 3).alias("lower"), half_up(F.col("_upper"), 3).alias("upper"),
                       "licences")


def naive_and_one_area(blocks: DataFrame, *, holder: str, area: str, width: Column, k: int = 12) -> DataFrame:
    """Per holder: the sum over all areas, the most in any one area, and the number of areas.

    The first figure counts a block once per area it is licensed in; both are kept, with the
    overstatement, for the ``k`` holders with the largest sum.
    """
    per_area = blocks.groupBy(holder, area).agg(F.sum(width).alias("_w"))
    per = per_area.groupBy(holder).agg(F.sum("_w").alias("_naive"), F.max("_w").alias("_one"),
                                       F.count(F.lit(1)).alias("areas"))
    return top(per, [F.desc("_naive"), F.asc(holder)], k).select(
        holder, half_up(F.col("_naive")).alias("naive"), half_up(F.col("_one")).alias("in_one_area"), "areas",
        F.try_divide(half_up(F.col("_naive")), half_up(F.col("_one"))).alias("overstatement"))


def market_summary(holdings: DataFrame, market: str, holder: str) -> DataFrame:
    """Total width, holders, and the largest holder with its width, per market."""
    per = holdings.groupBy(market, holder).agg(F.sum("width").alias("w"))
    return per.groupBy(market).agg(F.sum("w").alias("width"), F.count(F.lit(1)).alias("holders"),
                                   best(holder, "w", holder).alias("largest"),
                                   F.max("w").alias("largest_width"))


def market_shares(holdings: DataFrame, market: str, band: str) -> DataFrame:
    """Share of every holder in its (market, band) column."""
    return share_of_group(holdings, [market, band], "width", "share", "column_width")
