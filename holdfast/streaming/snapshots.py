"""Snapshots that arrive as files: take in what is new, keep counts that can be added up.

The register is rebuilt from bounded files, month by month. A file-source stream with
``availableNow`` finds the files not taken in yet and ends; every batch replaces its own folder,
so a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def take_in(spark: SparkSession, source: str, schema: StructType | str, target: str, progress: str,
            rollup: Callable[[DataFrame], DataFrame], file_format: str = "parquet",
            options: dict[str, str] | None = None, max_files: int | None = None) -> None:
    """Roll up every new file under ``source`` into ``target``/batch=n; ``progress`` keeps the place."""
    reader = spark.readStream.format(file_format).schema(schema).options(**(options or {}))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def write(batch: DataFrame, number: int) -> None:
        rollup(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (reader.load(source).writeStream.foreachBatch(write)
             .option("checkpointLocation", progress).trigger(availableNow=True).start())
    query.awaitTermination()


def added_up(spark: SparkSession, target: str, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The rollups of all batches added up: counts and sums only, which do not mind the split."""
    return spark.read.parquet(target).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
