"""Joins that account for every row: matched, blank, orphan; contracts, overlaps, dense domains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.scale import bounded_rows, skew_join

MATCHED, BLANK, ORPHAN = "matched", "blank", "orphan"


def join_with_status(facts: DataFrame, dim: DataFrame, key: str, status: str = "key_status") -> DataFrame:
    """Left join that tells a blank key from a key missing in ``dim``; no row is lost."""
    marked = dim.withColumn("_found", F.lit(True))
    return (skew_join(facts, marked, key, "left")
            .withColumn(status, F.when(F.col(key).isNull(), F.lit(BLANK))
                        .when(F.col("_found"), F.lit(MATCHED)).otherwise(F.lit(ORPHAN)))
            .drop("_found"))


def key_status_counts(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows per key status. The facts are counted per key first, so no key is hot in the join."""
    per_key = facts.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    marked = dim.select(key).distinct().withColumn("_found", F.lit(True))
    status = (F.when(F.col(key).isNull(), F.lit(BLANK))
              .when(F.col("_found"), F.lit(MATCHED)).otherwise(F.lit(ORPHAN)))
    return (per_key.join(marked, key, "left").select(status.alias("key_status"), "rows")
            .groupBy("key_status").agg(F.sum("rows").alias("rows")))


def orphans(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys used but not listed in ``dim``, with their rows; blank keys are not orphans."""
    per_key = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return per_key.join(dim.select(key), key, "left_anti")


def lookup(df: DataFrame, key: str, table: DataFrame, code: str, text: str, name: str) -> DataFrame:
    """Add the description of a code, NULL when the code is not listed. A long list is joined with hot codes salted."""
    listed = table.select(F.col(code).alias(key), F.col(text).alias(name))
    if bounded_rows(listed) is not None:
        return df.join(F.broadcast(listed), key, "left")
    return skew_join(df, listed, key, "left")


def key_overlap(sides: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """How many distinct keys every pair of columns has in common.

    ``sides`` maps a label to (table, key column). Every key becomes one bit mask of the sides
    it occurs on, in one shuffle; the result is one row per pair of labels, and one per label.
    """
    labels = list(sides)
    tagged = reduce(DataFrame.unionByName, [
        df.select(key.cast("string").alias("key"), F.lit(1 << i).alias("bit"))
        for i, (df, key) in enumerate(sides.values())])
    masks = (tagged.filter(F.col("key").isNotNull()).groupBy("key").agg(F.bit_or("bit").alias("mask"))
             .groupBy("mask").agg(F.count(F.lit(1)).alias("n")))
    pairs = [(i, j) for i in range(len(labels)) for j in range(i, len(labels))]
    listed = F.array(*[F.struct(F.lit(labels[i]).alias("a"), F.lit(labels[j]).alias("b"),
                                F.lit((1 << i) | (1 << j)).alias("need")) for i, j in pairs])
    return (masks.select(F.explode(listed).alias("p"), "mask", "n")
            .groupBy("p.a", "p.b")
            .agg(F.sum(F.when(F.col("mask").bitwiseAND(F.col("p.need")) == F.col("p.need"),
                              F.col("n")).otherwise(0)).alias("keys")))


def composite_cardinality(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, keys with several rows, and the most rows a key has: one row."""
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"),
                       F.count_if(F.col("n") > 1).alias("repeated_keys"), F.max("n").alias("most"))


def typed_contract(df: DataFrame, key: str, kind: Column, other: DataFrame, other_key: str) -> DataFrame:
    """Distinct keys of ``other``, and those reached with and without the mandatory type filter.

    The unfiltered count is recorded because it is wrong and has to stay different.
    """
    used = (df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k"))
            .agg(F.bool_or(F.coalesce(kind, F.lit(False))).alias("typed"), F.lit(True).alias("any")))
    listed = other.select(F.col(other_key).alias("k")).distinct().withColumn("listed", F.lit(True))
    return used.join(listed, "k", "full").agg(
        F.count_if("listed").alias("listed_keys"), F.count_if("typed").alias("typed_keys"),
        F.count_if("any").alias("unfiltered_keys"),
        F.count_if(F.col("typed") & F.col("listed")).alias("typed_matches"),
        F.count_if(F.col("any") & F.col("listed")).alias("unfiltered_matches"))


def disagreement(df: DataFrame, code: str, text: str, table: DataFrame, table_code: str,
                 table_text: str) -> DataFrame:
    """Rows whose own text differs from the text its code stands for: one row (rows, differing)."""
    per_pair = df.groupBy(code, text).agg(F.count(F.lit(1)).alias("n"))
    joined = lookup(per_pair, code, table, table_code, table_text, "_listed")
    return joined.agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(~F.col("_listed").eqNullSafe(F.col(text)), F.col("n"))), F.lit(0))
        .alias("differing"))


def dense(df: DataFrame, domain: DataFrame, on: Sequence[str], zeros: Sequence[str]) -> DataFrame:
    """Every member of ``domain``, with ``zeros`` filled where ``df`` has no row."""
    return domain.join(df, list(on), "left").fillna(0, subset=list(zeros))


def year_domain(df: DataFrame, year: str) -> DataFrame:
    """Every year from the first to the last in ``df``."""
    ends = df.agg(F.min(year).alias("a"), F.max(year).alias("b")).filter(F.col("a").isNotNull())
    return ends.select(F.explode(F.sequence("a", "b")).alias(year))


def common(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Distinct keys on both sides. Used for leak checks, where the result must be empty."""
    a = left.select(left_key.alias("key")).filter("key is not null").distinct()
    b = right.select(right_key.alias("key")).distinct()
    return a.join(b, "key", "left_semi")


def references(*columns: tuple[DataFrame, str, str]) -> DataFrame:
    """Flatten id columns (table, column, label) of several outputs into one list of references."""
    parts = [df.select(F.lit(label).alias("source"),
                       (F.explode(F.col(c).cast("array<long>")) if df.schema[c].dataType.typeName() == "array"
                        else F.col(c).cast("long")).alias("ref")) for df, c, label in columns]
    return reduce(DataFrame.unionByName, parts)


def search(df: DataFrame, text: str, query: str, order: Sequence[Column], limit: int = 40,
           least: int = 3) -> DataFrame:
    """The first ``limit`` rows whose text contains ``query``, case ignored; none below ``least`` letters."""
    query = query.strip().lower()
    if len(query) < least:
        return df.limit(0)
    return df.filter(F.lower(text).contains(query)).orderBy(*order).limit(limit)


def by_ids(df: DataFrame, column: str, ids: Sequence[int]) -> DataFrame:
    """Rows whose id is one of ``ids``; -1 stands for a withheld entity and names none."""
    return df.filter(F.col(column).isin([int(i) for i in ids if int(i) != -1]))


def equal_or_all(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Equality filter that lets every row through when the value is blank."""
    return df.filter(F.col(column) == value) if value else df
