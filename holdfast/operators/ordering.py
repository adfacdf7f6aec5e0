"""Ranks, positions and running sums that do not need a whole group in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.scale import durable, skew_join

# A group up to this long is ordered inside one task; a longer one is cut into slices.
ROWS_PER_TASK = 4_000_000
# Spark prunes a row_number filter before the shuffle only below this rank.
GROUP_LIMIT = 1000


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column],
            sums: Mapping[str, Column], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add inclusive running sums over ``order`` inside each ``group`` (the whole table when empty).

    ``order`` must be total. The longest group is measured first. When it fits one
    task, this is a plain window. Otherwise the rows are range-partitioned on
    (group, order), every slice is summed on its own, and the sums of the slices
    before it are added; only a group that crosses a slice border needs that, so
    the table of offsets is no longer than the number of slices. The measuring reads ``df`` once more:
    pass a scan, or something ``durable``, not a long computation.
    """
    group = list(group)
    total, longest = _extent(df, group)
    if longest <= rows_per_task:
        frame = _window(group, order)
        return df.withColumns({name: F.sum(value).over(frame) for name, value in sums.items()})

    slices = max(2, math.ceil(total / rows_per_task))
    ranged = df.repartitionByRange(slices, *[F.col(g) for g in group], *order)
    ranged = durable(ranged.withColumn("_slice", F.spark_partition_id()))
    local = _window([*group, "_slice"], order)
    ranged = ranged.withColumns({name: F.sum(value).over(local) for name, value in sums.items()})

    per_slice = ranged.groupBy(*group, "_slice").agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in sums.items()])
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_slice
               .select(*group, "_slice",
                       *[F.sum(f"_sum_{n}").over(before).alias(f"_before_{n}") for n in sums])
               .filter(reduce(lambda a, b: a | b, [F.col(f"_before_{n}").isNotNull() for n in sums])))
    offsets = F.broadcast(offsets.select(
        *[F.col(c).alias(f"_o_{c}") for c in [*group, "_slice"]],
        *[f"_before_{n}" for n in sums]))
    same = reduce(lambda a, b: a & b,
                  [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*group, "_slice"]])
    joined = ranged.join(offsets, same, "left")
    return joined.select(*df.columns, *[
        (F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in sums])


def position(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "position",
             start: int = 1, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Ordinal of each row in its group, from ``start``, under a total ``order``."""
    placed = running(df, group, order, {name: F.lit(1)}, rows_per_task)
    return placed.withColumn(name, F.col(name) + F.lit(start - 1).cast("long"))


def running_max(df: DataFrame, group: Sequence[str], order: Sequence[Column], maxima: Mapping[str, Column],
                rows_per_task: int = ROWS_PER_TASK, before: bool = False) -> DataFrame:
    """Add running maxima over ``order`` inside each ``group``; with ``before`` those of the earlier rows only.

    NULLs are passed over; a maximum of nothing is NULL. ``order`` must be total. As in ``running``, a group
    longer than a task is cut into slices of the range: every slice has its own maxima, and the maxima of
    the slices before it are carried in, from a table no longer than the number of slices. ``df`` is
    read twice: pass a scan, or something ``durable``.
    """
    group = list(group)
    total, longest = _extent(df, group)
    last = -1 if before else Window.currentRow
    if longest <= rows_per_task:
        frame = _window(group, order).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns({name: F.max(value).over(frame) for name, value in maxima.items()})

    slices = max(2, math.ceil(total / rows_per_task))
    ranged = df.repartitionByRange(slices, *[F.col(g) for g in group], *order)
    ranged = durable(ranged.withColumn("_slice", F.spark_partition_id())
                     .withColumns({f"_own_{name}": value for name, value in maxima.items()}))
    local = _window([*group, "_slice"], order).rowsBetween(Window.unboundedPreceding, last)
    per_slice = ranged.groupBy(*group, "_slice").agg(*[F.max(f"_own_{n}").alias(f"_max_{n}") for n in maxima])
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*[F.col(c).alias(f"_o_{c}") for c in [*group, "_slice"]],
                               *[F.max(f"_max_{n}").over(earlier).alias(f"_before_{n}") for n in maxima])
    carried = carried.filter(reduce(lambda a, b: a | b, [F.col(f"_before_{n}").isNotNull() for n in maxima]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in [*group, "_slice"]])
    ranged = ranged.withColumns({name: F.max(f"_own_{name}").over(local) for name in maxima})
    # A row for each group that crosses a border of slices: fewer than there are slices.
    joined = ranged.join(F.broadcast(carried), same, "left")
    return joined.select(*df.columns, *[F.greatest(n, f"_before_{n}").alias(n) for n in maxima])


def _extent(df: DataFrame, group: list[str]) -> tuple[int, int]:
    if not group:
        total = df.count()
        return total, total
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("total"), F.max("n").alias("longest")).first()
    return int(row["total"] or 0), int(row["longest"] or 0)


def _window(group: list[str], order: Sequence[Column]):
    frame = Window.partitionBy(*group) if group else Window.partitionBy()
    return frame.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Below GROUP_LIMIT every map task passes on at most ``k`` rows
    a group; from there on the rows are numbered, however long the group, and ``order`` must be total."""
    if k >= GROUP_LIMIT:
        return position(durable(df), group, order, name).filter(F.col(name) <= k)
    frame = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(frame)).filter(F.col(name) <= k)
    return ranked.withColumn(name, F.col(name).cast("long"))


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of the table; ``order`` must end in a key, Spark has no input order."""
    return df.orderBy(*order).limit(k)


def best(value: str | Column, size: str | Column, tie: str | Column) -> Column:
    """Aggregate: the ``value`` with the largest ``size``; the smallest ``tie`` wins among equals."""
    size = F.col(size) if isinstance(size, str) else size
    return F.min_by(value, F.struct((-size).alias("s"), (F.col(tie) if isinstance(tie, str) else tie).alias("t")))


def share_of_group(df: DataFrame, group: Sequence[str], value: str, name: str = "share",
                   total: str | None = None) -> DataFrame:
    """value / sum of value over the group.

    While the longest group fits a task this is a window. Otherwise the sums are built map-side and
    joined back with hot groups salted, so a large group is never gathered. ``df`` is written once,
    because it is read for both.
    """
    group = list(group)
    df = durable(df)
    if _extent(df, group)[1] <= ROWS_PER_TASK:
        whole = F.sum(value).over(Window.partitionBy(*group))
        out = df.withColumn(name, F.try_divide(F.col(value).cast("double"), whole))
        return out if total is None else out.withColumn(total, whole)
    sums = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    out = skew_join(df, sums, group).withColumn(name, F.try_divide(F.col(value).cast("double"), F.col("_total")))
    return out.drop("_total") if total is None else out.withColumnRenamed("_total", total)


def every_kth(df: DataFrame, order: Sequence[Column], points: int,
              rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Systematic sample: about ``points`` rows at equal steps in order, and always the last row."""
    df = durable(df)
    rows = df.count()
    step = max(1, rows // points)
    placed = position(df, [], order, "_at", start=0, rows_per_task=rows_per_task)
    return placed.filter((F.col("_at") % step == 0) | (F.col("_at") == rows - 1)).drop("_at")
