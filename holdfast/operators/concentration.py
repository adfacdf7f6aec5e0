"""How unequal the holdings are: headline figures, Lorenz curve, Gini."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import half_up
from holdfast.operators.ordering import ROWS_PER_TASK, best, running, top
from holdfast.scale import durable


def size_histogram(totals: DataFrame, size: str, person: str) -> DataFrame:
    """(size, person, n): holders per size. Everything below needs no more than this.

    Whole sizes that add up to N take at most sqrt(2N) distinct values, so it is a short table;
    it is checkpointed because several figures are read off it.
    """
    return durable(totals.groupBy(F.col(size).alias("size"), F.col(person).alias("person"))
                   .agg(F.count(F.lit(1)).alias("n")))


def headline(totals: DataFrame, size: str, person: str) -> DataFrame:
    """(metric, value): largest named holding, share of the ten largest, HHI, single-licence counts.

    Shares are over the whole register, withheld holders included; numerators are named only.
    """
    sizes = size_histogram(totals, size, person)
    named = ~F.col("person")
    held = F.col("n") * F.col("size")
    row = sizes.agg(
        F.sum(held).alias("total"), F.max(F.when(named, F.col("size"))).alias("largest"),
        F.sum(F.when(named, held.cast("double") * F.col("size"))).alias("squares"),
        F.sum(F.when(named & (F.col("size") == 1), F.col("n")).otherwise(0)).alias("single_named"),
        F.sum(F.when(F.col("size") == 1, F.col("n")).otherwise(0)).alias("single_all"))
    ten = (top(sizes.filter(named), [F.desc("size")], 10)
           .select(F.explode(F.array_repeat("size", F.least(F.col("n"), F.lit(10)).cast("int"))).alias("size"))
           .orderBy(F.desc("size")).limit(10).agg(F.sum("size")).first()[0])
    whole = F.col("total").cast("double")
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in {
            "total": F.col("total"), "largest": F.col("largest"),
            "top10_share": half_up(F.try_divide(F.lit(ten).cast("double"), whole) * 100, 2),
            "hhi": half_up(F.try_divide(F.col("squares") * 1e4, whole * whole)),
            "single_named": F.col("single_named"), "single_all": F.col("single_all")}.items()])).alias("m")
    ).select("m.metric", "m.value")


def largest_holder(totals: DataFrame, size: str, name: str, key: str, person: str) -> DataFrame:
    """Name and size of the largest named holder: one row."""
    return totals.filter(~F.col(person)).agg(best(name, size, key).alias(name), F.max(size).alias(size))


def lorenz(totals: DataFrame, size: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The Lorenz curve, one point per distinct size: holders and sizes up to and including it.

    Equal holders lie on a straight piece of the curve, so the points of a size collapse into
    one without changing the area. Whole sizes that add up to N take at most sqrt(2N) distinct
    values; other sizes may take more, and are then summed in slices.
    """
    sizes = durable(totals.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n")))
    return running(sizes, [], [F.col("size").asc()],
                   {"cum_holders": F.col("n"), "cum_size": F.col("n") * F.col("size")}, rows_per_task)


def gini(curve: DataFrame) -> DataFrame:
    """One row: holders, total, Gini (1 - 2 × the trapezoid area), share held by the smaller half.

    The area of a piece needs its own end and its width only, so no window is needed here.
    """
    ends = curve.agg(F.max("cum_holders").alias("holders"), F.max("cum_size").alias("total")).first()
    holders, total = int(ends["holders"] or 0), float(ends["total"] or 0)
    if not holders or not total:
        return curve.sparkSession.createDataFrame([], "holders long, total double, gini double, half_share double")
    # The half point of a curve of holders + 1 points that starts at zero.
    half = (holders + 1) // 2
    piece = F.col("n") * (F.col("cum_size") * 2.0 - F.col("n") * F.col("size"))
    holds_half = (F.col("cum_holders") >= half) & (F.col("cum_holders") - F.col("n") < half)
    at_half = F.col("cum_size") - (F.col("cum_holders") - half) * F.col("size")
    return curve.agg(
        F.max("cum_holders").alias("holders"), F.max("cum_size").cast("double").alias("total"),
        (1 - F.sum(piece) / F.lit(float(holders) * total)).alias("gini"),
        (F.max(F.when(holds_half, at_half)) / F.lit(total)).alias("half_share"))


def stacked(df: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """Share of the group and the running offset of each piece, largest first (then by key)."""
    df = durable(df)
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    offset = running(df, group, [F.desc(value), F.asc(key)], {"_end": F.col(value)}).join(totals, group)
    return (offset.withColumn("share", F.try_divide(F.col(value).cast("double"), F.col("_total")))
            .withColumn("offset", F.try_divide((F.col("_end") - F.col(value)).cast("double"), F.col("_total")))
            .drop("_end", "_total"))
