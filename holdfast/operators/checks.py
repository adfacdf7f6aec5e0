"""Data-quality gates: figures recomputed from source, a report, and a run that stops.

A check is one aggregate over one source table. All checks on a source run as a single
aggregation; the report is a table, and ``enforce`` raises when a hard gate fails.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATE, WARNING = "gate", "warning"


class GateFailure(Exception):
    """One or more hard gates failed."""


@dataclass(frozen=True)
class Check:
    """``actual`` is an aggregate over ``source``; it has to equal ``expected`` or lie in [lo, hi]."""

    id: str
    source: str
    actual: Column
    expected: float | None = None
    lo: float | None = None
    hi: float | None = None
    kind: str = GATE
    detail: str = ""


def equals(id: str, source: str, actual: Column, expected: float, detail: str = "") -> Check:
    return Check(id, source, actual, expected=float(expected), detail=detail)


def in_range(id: str, source: str, actual: Column, lo: float | None = None, hi: float | None = None,
             detail: str = "", kind: str = GATE) -> Check:
    return Check(id, source, actual, lo=lo, hi=hi, kind=kind, detail=detail)


def plausible(id: str, source: str, actual: Column, lo: float, hi: float, detail: str = "") -> Check:
    """A warning only: a figure out of range is reported and the run goes on."""
    return Check(id, source, actual, lo=lo, hi=hi, kind=WARNING, detail=detail)


# --- aggregates worth a name -----------------------------------------------------------------


def rows() -> Column:
    return F.count(F.lit(1))


def rows_where(condition: Column) -> Column:
    return F.count_if(condition)


def share_of(condition: Column) -> Column:
    return F.try_divide(F.count_if(condition).cast("double"), F.count(F.lit(1)).cast("double"))


def violations(condition: Column) -> Column:
    """Rows for which a condition that must hold does not (NULL counts as a violation)."""
    return F.count_if(~F.coalesce(condition, F.lit(False)))


# --- source tables for checks that compare two tables ------------------------------------------


def histogram_difference(actual: DataFrame, expected: Mapping[str, int], key: str, n: str) -> DataFrame:
    """Keys whose count differs from a pinned histogram; the whole histogram agrees when empty."""
    spark = actual.sparkSession
    pinned = spark.createDataFrame([(str(k), int(v)) for k, v in expected.items()], "key string, expected long")
    found = actual.select(F.col(key).cast("string").alias("key"), F.col(n).alias("actual"))
    return found.join(pinned, "key", "full").filter(~F.col("actual").eqNullSafe(F.col("expected")))


def reconcile(**totals: DataFrame) -> DataFrame:
    """One row with one column per named one-cell table, to check that parts sum to the whole."""
    named = [df.select(F.lit(name).alias("name"), F.col(df.columns[0]).cast("double").alias("v"))
             for name, df in totals.items()]
    long = reduce(DataFrame.unionByName, named)
    return long.agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in totals])


def unresolved(references: DataFrame, ref: str, ids: DataFrame, id: str) -> DataFrame:
    """References that name no published id (-1 stands for a withheld one and is allowed)."""
    used = references.select(F.col(ref).alias("ref")).filter(F.col("ref") != -1).distinct()
    return used.join(ids.select(F.col(id).alias("ref")), "ref", "left_anti")


def recount(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Published against recomputed figures per key: (key, published, recomputed)."""
    a = left.select(*key, F.col(value).alias("published"))
    b = right.select(*key, F.col(value).alias("recomputed"))
    return a.join(b, list(key), "full")


# --- running ----------------------------------------------------------------------------------


def run_checks(sources: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """The report (check_id, kind, actual, expected, lo, hi, ok, detail): one aggregation a source."""
    reports = []
    for source in dict.fromkeys(c.source for c in checks):
        mine = [c for c in checks if c.source == source]
        figures = sources[source].agg(*[c.actual.cast("double").alias(f"c{i}") for i, c in enumerate(mine)])
        listed = F.array(*[F.struct(
            F.lit(c.id).alias("check_id"), F.lit(c.kind).alias("kind"), F.col(f"c{i}").alias("actual"),
            F.lit(c.expected).cast("double").alias("expected"), F.lit(c.lo).cast("double").alias("lo"),
            F.lit(c.hi).cast("double").alias("hi"), F.lit(c.detail).alias("detail"))
            for i, c in enumerate(mine)])
        reports.append(figures.select(F.explode(listed).alias("r")).select("r.*"))
    report = reduce(DataFrame.unionByName, reports)
    a = F.col("actual")
    ok = (a.isNotNull() & (F.col("expected").isNull() | (a == F.col("expected")))
          & (F.col("lo").isNull() | (a >= F.col("lo"))) & (F.col("hi").isNull() | (a <= F.col("hi"))))
    return report.withColumn("ok", ok).select(
        "check_id", "kind", "actual", "expected", "lo", "hi", "ok", "detail")


# --- are the gates worth having? ----------------------------------------------------------------


@dataclass(frozen=True)
class Plant:
    """A wrong input: ``change`` makes it from ``table``."""

    id: str
    table: str
    change: Callable[[DataFrame], DataFrame]


class _Reading(Mapping):
    """Tables, and the names of those that were asked for."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables, self.names = tables, set()

    def __getitem__(self, name: str) -> DataFrame:
        self.names.add(name)
        return self.tables[name]

    def __iter__(self):
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)


def sensitivity(tables: Mapping[str, DataFrame], sources: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]],
                checks: Sequence[Check], plants: Sequence[Plant]) -> DataFrame:
    """(check_id, plant, passes, failed, blind): every gate under every wrong input that it reads.

    ``sources`` makes each table that checks run on from ``tables``. Which tables it reads is seen while it
    does, and only the gates on sources that read a planted table are run again, on that table. ``passes``
    is the gate on the right input; a gate ``failed`` when it passes there and does not on the wrong one. A
    gate that no planted change fails is ``blind``: it would let all of them through. Gates that read
    none of them have one row, with a NULL plant.
    """
    reads, right = {}, {}
    for name in dict.fromkeys(c.source for c in checks):
        seen = _Reading(tables)
        right[name] = sources[name](seen)
        reads[name] = seen.names
    before = run_checks(right, checks).select("check_id", F.col("ok").alias("passes"))
    reports = []
    for plant in plants:
        hit = [c for c in checks if plant.table in reads[c.source]]
        if hit:
            wrong = {**tables, plant.table: plant.change(tables[plant.table])}
            after = run_checks({n: sources[n](wrong) for n in dict.fromkeys(c.source for c in hit)}, hit)
            reports.append(after.select("check_id", F.lit(plant.id).alias("plant"), (~F.col("ok")).alias("fails")))
    if not reports:
        return before.select("check_id", F.lit(None).cast("string").alias("plant"), "passes",
                             F.lit(False).alias("failed"), F.lit(True).alias("blind"))
    # A row for each check and plant: both tables are as long as the lists in the program.
    tried = before.join(F.broadcast(reduce(DataFrame.unionByName, reports)), "check_id", "left")
    tried = tried.withColumn("failed", F.col("passes") & F.coalesce("fails", F.lit(False)))
    sharp = tried.groupBy("check_id").agg((~F.bool_or("failed")).alias("blind"))
    return tried.join(F.broadcast(sharp), "check_id").select("check_id", "plant", "passes", "failed", "blind")


def enforce(report: DataFrame) -> list[str]:
    """Raise when a hard gate failed; return the warnings. The report has one row a check."""
    bad = report.filter(~F.col("ok")).orderBy("check_id").collect()
    lines = {r["check_id"]: f"{r['check_id']}: {r['actual']} (expected "
             f"{r['expected'] if r['expected'] is not None else (r['lo'], r['hi'])}) {r['detail']}".strip()
             for r in bad}
    failed = [lines[r["check_id"]] for r in bad if r["kind"] == GATE]
    if failed:
        raise GateFailure("\n".join(failed))
    return [lines[r["check_id"]] for r in bad]
