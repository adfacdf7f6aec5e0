"""Values into named bands: a constant band table, or a range join against any interval table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.numbers import log_bin, log_bin_count
from holdfast.operators.intervals import gaps, islands
from holdfast.scale import BROADCAST_ROWS, skew_join


@dataclass(frozen=True)
class Bands:
    """Half-open bands [lo, hi) in ascending order; the last ``hi`` may be None (open)."""

    rows: tuple[tuple[float, float | None, str], ...]

    def __post_init__(self):
        for i, (lo, hi, name) in enumerate(self.rows):
            if hi is None and i + 1 < len(self.rows):
                raise ValueError(f"only the last band may be open: {name}")
            if hi is not None and hi <= lo:
                raise ValueError(f"empty band: {name}")
            if i and self.rows[i - 1][1] > lo:
                raise ValueError(f"bands overlap at {name}")

    @property
    def contiguous(self) -> bool:
        return all(a[1] == b[0] for a, b in zip(self.rows, self.rows[1:]))

    def covers(self, x: Column) -> Column:
        """Is ``x`` inside the outer limits? A plain comparison, which reaches the Parquet scan."""
        low, high = self.rows[0][0], self.rows[-1][1]
        above = (x > 0) if low <= 0 else (x >= F.lit(float(low)))
        return above if high is None else above & (x < F.lit(float(high)))

    def index(self, x: Column) -> Column:
        """Band number of ``x`` as a balanced tree of comparisons; NULL when in no band.

        The table is a constant of the query, so this needs no join, and costs log2(bands)
        comparisons a row inside generated code. Values that are missing or not positive
        belong to no band.
        """
        return F.when(self.covers(x) & ~F.isnan(x), self._tree(x, 0, len(self.rows) - 1))

    def assign(self, df: DataFrame, value: str, name: str = "band") -> DataFrame:
        """The rows that are in a band, with its number. The outer limits are pushed to the scan."""
        x = F.col(value)
        inside = df.filter(self.covers(x) & ~F.isnan(x)).withColumn(name, self._tree(x, 0, len(self.rows) - 1))
        return inside if self.contiguous else inside.filter(F.col(name).isNotNull())

    def _tree(self, x: Column, first: int, last: int) -> Column:
        if first == last:
            hi = self.rows[first][1]
            # The next band starts where this one ends: the branch above has compared already.
            if hi is None or first + 1 == len(self.rows) or self.rows[first + 1][0] == hi:
                return F.lit(first)
            return F.when(x < F.lit(float(hi)), F.lit(first))
        middle = (first + last + 1) // 2
        return (F.when(x < F.lit(float(self.rows[middle][0])), self._tree(x, first, middle - 1))
                .otherwise(self._tree(x, middle, last)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The band table as a small dimension: band, lo, hi (NULL when open), name."""
        return spark.createDataFrame(
            [(i, float(lo), None if hi is None else float(hi), name)
             for i, (lo, hi, name) in enumerate(self.rows)],
            "band int, lo double, hi double, band_name string")


# Keys of what is in no interval whatever the intervals are, and of open intervals.
NOWHERE, OPEN = -32767, -32768


def _cell(x: Column, level: Column) -> Column:
    """The cell of 2^level that holds ``x``: divided by a power of two, so the order of values is kept."""
    edge = F.lit(4e18)
    return F.floor(F.greatest(-edge, F.least(edge, x / F.pow(F.lit(2.0), level.cast("double"))))).cast("long")


def _level(lo: Column, hi: Column) -> Column:
    """The level whose cells are as wide as the interval or up to twice as wide, so it lies in two of them, or in one."""
    return F.ceil(F.log2(hi - lo)).cast("int")


def _between(spans: list[tuple[float, float]]) -> list[tuple[float, float | None]]:
    """What positive values [lo, hi) none of ``spans`` covers; None is open."""
    out, reach = [], 0.0
    for lo, hi in sorted(spans):
        if lo > reach:
            out.append((reach, lo))
        reach = max(reach, hi)
    return out if reach == float("inf") else [*out, (reach, None)]


def _listed(spark: SparkSession, spans: list[tuple[float, float | None]]) -> DataFrame:
    """(_lo, _hi); a short list as constants of the plan, which need no Python worker."""
    if len(spans) > 64:
        return spark.createDataFrame(spans, "_lo double, _hi double")
    rows = [F.struct(F.lit(lo).cast("double").alias("_lo"), F.lit(hi).cast("double").alias("_hi")) for lo, hi in spans]
    empty = spark.range(1, numPartitions=1)
    return empty.select(F.inline(F.array(*rows))) if rows else empty.select(
        F.lit(0.0).alias("_lo"), F.lit(None).cast("double").alias("_hi")).limit(0)


def cells_of(facts: DataFrame, value: str, intervals: DataFrame, lo: str, hi: str, how: str, low: float, high: float,
             per_decade: int) -> tuple[DataFrame, DataFrame, bool]:
    """Facts and intervals by (_level, _cell), and whether the intervals were counted few.

    A closed interval is filed at the level of its width, so the cells of a level hold no more intervals
    than overlap there, and two; a fact is looked up once at every level that has any. Open intervals
    are filed under each log bin from their start on. For a left join what lies between all intervals is filed as
    well, as intervals without columns (``_lo`` and ``_hi`` are its ends): then every fact meets something.
    """
    spans = intervals.withColumns({"_lo": F.col(lo).cast("double"), "_hi": F.col(hi).cast("double")})
    spans = spans.filter(F.col("_hi").isNull() | (F.col("_lo") < F.col("_hi"))).filter(F.col("_lo").isNotNull() & ~F.isnan("_lo"))
    level = _level(F.col("_lo"), F.col("_hi"))
    few = spans.select("_lo", "_hi", level).limit(BROADCAST_ROWS + 1).collect()
    small, known = len(few) <= BROADCAST_ROWS, False
    if how == "left":
        if small:
            between = _between([(r[0], float("inf") if r[1] is None else r[1]) for r in few])
            known = all(hi is None for _, hi in between)
            rest = _listed(facts.sparkSession, between)
        else:
            whole = spans.select(F.greatest("_lo", F.lit(0.0)).alias("lo"), F.coalesce("_hi", F.lit(float("inf"))).alias("hi"))
            rest = gaps(islands(whole, [], "lo", "hi")).filter(~F.coalesce(F.col("lo") == float("inf"), F.lit(False)))
            rest = rest.select(F.coalesce("lo", F.lit(0.0)).alias("_lo"), F.col("hi").alias("_hi"))
            rest = rest.filter(F.col("_hi").isNull() | (F.col("_lo") < F.col("_hi")))
        spans = spans.unionByName(rest, allowMissingColumns=True)
    # Exponents of two: a few at most, whatever the number of intervals.
    if small and (known or how != "left"):
        levels = sorted({r[2] for r in few} - {None})
    else:
        levels = sorted(r[0] for r in spans.filter(F.col("_hi").isNotNull()).select(level).distinct().collect())
    last = log_bin_count(low, high, per_decade)

    def bin_of(x: Column) -> Column:
        return (F.when(x < low, F.lit(-1)).when(x >= high, F.lit(last))
                .otherwise(log_bin(x, low, high, per_decade))).cast("long")

    closed = spans.filter(F.col("_hi").isNotNull()).withColumn("_level", level)
    closed = closed.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_lo"), F.col("_level")), _cell(F.col("_hi"), F.col("_level")))))
    opened = spans.filter(F.col("_hi").isNull()).withColumn("_level", F.lit(OPEN))
    listed = closed.unionByName(opened.withColumn("_cell", F.explode(F.sequence(bin_of(F.col("_lo")), F.lit(last).cast("long")))))
    x = F.col(value).cast("double")
    places = [F.struct(F.lit(n).alias("_level"), _cell(x, F.lit(n)).alias("_cell")) for n in levels]
    places.append(F.struct(F.lit(OPEN).alias("_level"), bin_of(x).alias("_cell")))
    valid = (x > 0) & ~F.isnan(x)
    if how == "left":
        nowhere = F.array(F.struct(F.lit(NOWHERE).alias("_level"), F.lit(0).cast("long").alias("_cell")))
        keyed = facts.withColumn("_at", F.explode(F.when(valid, F.array(*places)).otherwise(nowhere)))
        none = facts.sparkSession.range(1, numPartitions=1).select(F.lit(NOWHERE).alias("_level"), F.lit(0).cast("long").alias("_cell"))
        listed = listed.unionByName(none, allowMissingColumns=True)
    else:
        keyed = facts.filter(valid).withColumn("_at", F.explode(F.array(*places)))
    return keyed.select(*facts.columns, "_at._level", "_at._cell"), listed, small


def range_join(facts: DataFrame, value: str, intervals: DataFrame, lo: str = "lo", hi: str = "hi",
               how: str = "left", low: float = 1.0, high: float = 1e12,
               per_decade: int = 24) -> DataFrame:
    """Rows of ``facts`` with the intervals [lo, hi) that hold ``value``; ``hi`` NULL means open.

    An equi-join on cells whose width follows that of the intervals (see ``cells_of``), with the range
    as a second condition: however many narrow intervals a decade has, a fact meets those around it only.
    ``how`` is left or inner. Up to BROADCAST_ROWS intervals are broadcast and the facts stay where they are;
    more are joined with hot cells salted. A value that is NULL, NaN or not positive is in no interval.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"range_join cannot do a {how} join")
    keyed, listed, small = cells_of(facts, value, intervals, lo, hi, how, low, high, per_decade)
    x = F.col(value)
    holds = (F.col("_level") == NOWHERE) | ((F.col("_lo") <= x) & (F.col("_hi").isNull() | (x < F.col("_hi"))))
    if small:
        met = keyed.join(F.broadcast(listed), ["_level", "_cell"]).filter(holds)
    else:
        met = skew_join(keyed, listed, ["_level", "_cell"]).filter(holds)
    return met.select(*facts.columns, *intervals.columns)


def overlapping(df: DataFrame, lo: str, hi: str, view: tuple[float, float]) -> DataFrame:
    """Rows whose interval [lo, hi) overlaps the open view; an open ``hi`` counts as infinite."""
    start, end = view
    return df.filter((F.col(hi).isNull() | (F.col(hi) > start)) & (F.col(lo) < end))


def within(df: DataFrame, value: str, view: tuple[float, float]) -> DataFrame:
    """Rows whose exact value lies in the closed view."""
    return df.filter(F.col(value).between(*view))


def pairs_within(df: DataFrame, lo: str, hi: str, view: tuple[float, float]) -> DataFrame:
    """Rows whose (lo, hi) pair lies wholly inside the closed view."""
    return df.filter((F.col(lo) >= view[0]) & (F.col(hi) <= view[1]))


# --- rollups -----------------------------------------------------------------------------


def assignments(devices: DataFrame, key: Sequence[str], carry: Sequence[str], transmit: str) -> DataFrame:
    """One row per distinct assignment ``key`` (NULL parts count), with its rows and transmit rows."""
    return devices.groupBy(*carry, *[k for k in key if k not in carry]).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(transmit)).alias("tx"))


def holder_bands(devices: DataFrame, licences: DataFrame, *, band: str, licence: str,
                 holder: Sequence[str], key: Sequence[str], transmit: str) -> DataFrame:
    """Rows, transmit rows, assignments and licences of every holder in every band.

    The facts are reduced to (band, licence) before the licence table is joined, so a
    licence with a third of all rows reaches the join as one row per band. ``holder`` is
    the holder's column followed by any attributes of it (class, person flag). ``devices`` are
    rows in a band, as ``Bands.assign`` gives them.
    """
    each = assignments(devices, key, [band, licence], transmit)
    per_licence = each.groupBy(band, licence).agg(
        F.sum("rows").alias("rows"), F.sum("tx").alias("tx"), F.count(F.lit(1)).alias("assignments"))
    return (per_licence.join(licences.select(licence, *holder), licence)
            .groupBy(band, *holder)
            .agg(F.sum("rows").alias("rows"), F.sum("tx").alias("tx"),
                 F.sum("assignments").alias("assignments"), F.count(F.lit(1)).alias("licences")))


def band_rollup(by_holder: DataFrame, band: str) -> DataFrame:
    """Rows, transmit rows, distinct assignments, licences and holders per band.

    Sums alone: a licence has one holder, and ``by_holder`` has one row per holder and band.
    """
    return by_holder.groupBy(band).agg(
        F.sum("rows").alias("rows"), F.sum("tx").alias("tx"),
        F.sum("assignments").alias("assignments"), F.sum("licences").alias("licences"),
        F.count(F.lit(1)).alias("holders"))


def class_mix(by_holder: DataFrame, band: str, cls: str) -> DataFrame:
    """Rows of every class in every band."""
    return by_holder.groupBy(band, cls).agg(F.sum("rows").alias("rows"))


def bin_rollup(events: DataFrame, value: Column, holder: str, transmit: Column, **axis) -> DataFrame:
    """Rows, transmit rows and distinct holders per constant-ratio bin; empty bins are absent."""
    binned = events.select(log_bin(value, **axis).alias("bin"), F.col(holder).alias("_holder"),
                           transmit.alias("_tx")).filter(F.col("bin") >= 0)
    each = binned.groupBy("bin", "_holder").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_tx").alias("tx"))
    return each.groupBy("bin").agg(F.sum("rows").alias("rows"), F.sum("tx").alias("tx"),
                                   F.count("_holder").alias("holders"))


def value_rollup(devices: DataFrame, licences: DataFrame, *, value: str, licence: str,
                 transmit: str) -> DataFrame:
    """Rows, transmit rows and distinct licences per exact value, for the licences given."""
    each = devices.filter(F.col(value).isNotNull()).groupBy(value, licence).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(transmit)).alias("tx"))
    kept = skew_join(each, licences.select(licence).distinct(), licence, "left_semi", probe=devices)
    return kept.groupBy(value).agg(F.sum("rows").alias("rows"), F.sum("tx").alias("tx"),
                                   F.count(F.lit(1)).alias("licences"))


def assignment_ratio(devices: DataFrame, key: Sequence[str], site: str) -> DataFrame:
    """Rows per distinct assignment over the rows that have a site: one row."""
    each = devices.filter(F.col(site).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("assignments"))
