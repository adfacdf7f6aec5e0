"""Running numpy work on blocks of texts, with the other columns carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.words import BLOCK, blocks


def name(column: str):
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within: Python tasks that are run get at most so many rows at a time, for rows that are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def map_texts(df: DataFrame, text: str, keep: Sequence[str], result: str,
              work: Callable[[pa.Array], Sequence[pa.Array]], limit: int = BLOCK) -> DataFrame:
    """``keep`` of every row, and the columns ``result`` (DDL) that ``work`` makes from its text.

    ``work`` gets the texts of a block and returns an array for each result column. Only the text
    and the kept columns are read. A kept column that bears the name of a result column gives way
    to it, so further columns of any name do no harm.
    """
    made = schema(result)
    kept = [c for c in dict.fromkeys(keep) if c not in made.names]
    # A text that is kept and is a string already travels once.
    again = text if text in kept and df.schema[text].dataType == T.StringType() else None
    place = {c: "text" if c == again else f"row.c{i}" for i, c in enumerate(kept)}
    row = F.struct(*[name(c).alias(f"c{i}") for i, c in enumerate(kept) if c != again], F.lit(0).alias("z"))
    source = df.select(row.alias("row"), name(text).cast("string").alias("text"))
    out = T.StructType([*(source.schema if again else source.schema[:1]),
                        *[T.StructField(f"r{i}", f.dataType) for i, f in enumerate(made)]])
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", limit):
            passed = [block.column("row"), block.column("text")][:2 if again else 1]
            yield pa.RecordBatch.from_arrays([*passed, *work(block.column("text"))], names=names)

    done = source.mapInArrow(run, out)
    return done.select(*[F.col(place[c]).alias(c) for c in kept], *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(made)])
