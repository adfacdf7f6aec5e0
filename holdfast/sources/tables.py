"""Register tables as CSV: quoted text with commas and newlines, every defective row counted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.functions.dates import to_day
from holdfast.functions.numbers import number

RAGGED = "_ragged"


class HeaderMismatch(ValueError):
    """The header of a file is not the declared one."""


def read_table(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str],
               embedded_newlines: bool = True, check_header: bool = True, folders: Sequence[str] = ()) -> DataFrame:
    """All columns as text (blank is NULL), plus ``_ragged``: the field count was not the header's.

    A short row is kept and padded with NULL. A byte-order mark, CRLF, doubled quotes, blank lines
    and a last row without a newline are handled by the reader. With ``embedded_newlines`` a file
    is one task, so a large table is read once and rewritten (``to_parquet``); without them the
    file is split. ``folders`` names the columns whose values are in the names of folders (``name=value``).
    """
    if check_header:
        found = spark.read.option("header", True).option("multiLine", embedded_newlines) \
            .option("escape", '"').csv(path).columns
        if list(found) != [*columns, *folders]:
            raise HeaderMismatch(f"{path}: expected {list(columns)}, found {found}")
    # Every file's header is checked as it is read, and every row over all columns, whatever a query
    # selects: so the count of ragged rows is always the same.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_bad", *folders]])
    raw = (spark.read.schema(schema).option("header", True).option("multiLine", embedded_newlines)
           .option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
           .option("enforceSchema", not check_header).option("columnPruning", False).csv(path))
    # Holds always: the reader refuses a query of the defect alone.
    every = F.length(F.concat_ws("", *[F.col(c) for c in columns])) >= 0
    return raw.withColumn(RAGGED, F.col("_bad").isNotNull() & every).drop("_bad")


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast named columns to double, long, date or string; what cannot be cast becomes NULL."""
    def cast(name: str) -> Column:
        kind = types.get(name, "string")
        if kind == "double":
            return number(F.col(name)).alias(name)
        if kind == "date":
            return to_day(F.col(name)).alias(name)
        if kind == "string":
            return F.col(name)
        return F.col(name).try_cast(kind).alias(name)
    return df.select(*[cast(c) for c in df.columns])


def defects(df: DataFrame) -> DataFrame:
    """Rows read and ragged rows: one row."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(RAGGED).alias("ragged"))


def to_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), files: int | None = None) -> DataFrame:
    """Write a table once as Parquet and read it back: splittable, columnar, prunable.

    A CSV with embedded newlines arrives as one task per file; ``files`` spreads it first.
    """
    spread = df if files is None else df.repartition(files)
    writer = spread.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def lookup_table(spark: SparkSession, path: str, columns: Sequence[str], code: str, text: str) -> DataFrame:
    """A (code, text) lookup; the first row of a repeated code wins by text order."""
    raw = read_table(spark, path, columns)
    return raw.groupBy(F.col(code).alias("code")).agg(F.min(text).alias("text"))


def latest_value(spark: SparkSession, path: str, columns: Sequence[str], code: str, value: str,
                 period: str | None = None) -> DataFrame:
    """(code, value): the value of the latest period of every code, such as a population."""
    raw = read_table(spark, path, columns)
    order = F.col(period) if period else F.lit(0)
    return raw.groupBy(F.col(code).alias("code")).agg(F.max_by(number(F.col(value)), order).alias("value"))
