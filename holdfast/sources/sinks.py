"""Results to storage: Parquet first, JSON where a document is wanted, provenance on everything."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.checks import enforce


def with_provenance(df: DataFrame, text: str) -> DataFrame:
    """Stamp the attribution on every column's metadata, where it survives Parquet."""
    return df.select(*[F.col(c).alias(c, metadata={**df.schema[c].metadata, "provenance": text})
                       for c in df.columns])


def write_results(results: Mapping[str, DataFrame], folder: str, provenance: str,
                  formats: Sequence[str] = ("parquet",)) -> None:
    """One folder per result and format, plus a ``_provenance`` table that names them all.

    The rows of a result are written by the tasks that hold them; nothing passes the driver.
    """
    spark = None
    for name, df in results.items():
        spark = df.sparkSession
        stamped = with_provenance(df, provenance)
        for kind in formats:
            stamped.write.mode("overwrite").format(kind).save(f"{folder}/{kind}/{name}")
    if spark is not None:
        rows = [(name, provenance) for name in results]
        spark.createDataFrame(rows, "result string, provenance string") \
            .coalesce(1).write.mode("overwrite").parquet(f"{folder}/parquet/_provenance")


def write_point_layer(points: DataFrame, folder: str, id: str, name: str) -> None:
    """Points and their names as two tables, so a reader without need of names never opens them."""
    points.drop(name).write.mode("overwrite").parquet(f"{folder}/points")
    points.select(id, name).write.mode("overwrite").parquet(f"{folder}/point_names")


def as_object(key: Column, value: Column) -> Column:
    """Aggregate: a JSON object {key: value} for a sink. For bounded key domains only."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))))


class Results:
    """Saved results, read once and kept; a read that failed is tried again next time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._open: dict[str, DataFrame] = {}

    def load(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self.spark.read.parquet(f"{self.folder}/parquet/{name}").persist()
        return self._open[name]

    def release(self) -> None:
        for df in self._open.values():
            df.unpersist()
        self._open.clear()


_MANIFEST = "version long, run string, result string, path string, rows long, provenance string"


def publish(spark: SparkSession, results: Mapping[str, DataFrame], folder: str, provenance: str,
            gates: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None) -> int:
    """Publish all results or none; the version they got.

    First every result is written to a folder of this run, where no reader looks. Then ``gates`` makes its
    report from the tables as written and the run ends with ``GateFailure`` if one fails. Last, a manifest is
    appended, one file that names every table with its rows and provenance: it is there or it is not, and
    from then on ``Published`` reads this version. A run that fails before, or an executor lost at any
    time, leaves what was published as it was. Earlier versions stay readable by their number.
    """
    if not results:
        raise ValueError("nothing to publish")
    run = uuid.uuid4().hex
    staged = {}
    for name, df in results.items():
        path = f"{folder}/runs/{run}/{name}"
        with_provenance(df, provenance).write.parquet(path)
        staged[name] = spark.read.parquet(path)
    if gates is not None:
        enforce(gates(staged))
    version = (Published(spark, folder).version or 0) + 1
    rows = [df.agg(F.lit(name).alias("result"), F.count(F.lit(1)).alias("rows")) for name, df in staged.items()]
    manifest = reduce(DataFrame.unionByName, rows).select(
        F.lit(version).cast("long").alias("version"), F.lit(run).alias("run"), "result",
        F.concat(F.lit(f"runs/{run}/"), F.col("result")).alias("path"), "rows", F.lit(provenance).alias("provenance"))
    manifest.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


class Published:
    """What a folder has published: by default the last version, which stays the one read while this is kept.

    Two runs that published under one number at the same time are told apart by their run; one of them counts.
    """

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.spark, self.folder = spark, folder
        try:
            every = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
            last = every.filter(F.lit(True) if version is None else F.col("version") == version).agg(
                F.max(F.struct("version", "run")).alias("last")).first()["last"]
        except AnalysisException:
            every, last = None, None
        if last is None and version is not None:
            raise KeyError(f"{folder} has no version {version}")
        self.version = last["version"] if last else None
        self.run = last["run"] if last else None
        self._every = every

    def manifest(self) -> DataFrame:
        """(version, run, result, path, rows, provenance), a row for each table; none before anything is published."""
        if self.version is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self._every.filter((F.col("version") == self.version) & (F.col("run") == self.run))

    def load(self, name: str) -> DataFrame:
        if self.version is None:
            raise KeyError(f"nothing is published in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/runs/{self.run}/{name}")
