"""Boundary polygons from GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.ordering import running
from holdfast.scale import durable

# Coordinates nest one level deeper in a MultiPolygon, so they are read as text first.
FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
FEATURES = ("features array<struct<properties:map<string,string>,"
            "geometry:struct<type:string,coordinates:string>>>")
POLYGON = "array<array<array<double>>>"
# What precedes a feature: a comma, or all up to the first list of objects; strings are passed over whole.
BEFORE = r'^(?:\s*,\s*(?=\{)|(?:[^"\[]++|"(?:[^"\\]++|\\.)*+"|\[(?!\s*\{))*+\[\s*(?=\{))'


class BrokenFile(ValueError):
    """A boundary file that ends before its outermost object does."""


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(feature, properties, type, coordinates): every feature, in file order, null geometry too.

    A file is one JSON object whose ``features`` lie on any number of lines. It is never one row: tasks
    read it in byte ranges, cut at closing braces, and whether a brace belongs to a string, and how deep it
    lies, follow from running sums over counts of each piece. Pieces of one feature meet again by its
    number, which starts at 0 in every file. A file that ends inside an object raises ``BrokenFile``.
    """
    features = durable(_feature_texts(spark, path))
    read = F.from_json("text", FEATURE)
    return (features.select("feature", read.alias("f")).filter(F.col("f.type") == "Feature")
            .select("feature", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("type"),
                    F.col("f.geometry.coordinates").alias("coordinates")))


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature, text): the text of every object in a list of the outermost object."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    # Outside of strings, when the piece begins outside (0) or inside (1) of one.
    outside = [F.regexp_replace(start, r'"[^"]*("|$)', "") for start in (bare, F.concat(F.lit('"'), bare))]
    pieces = (spark.read.option("lineSep", "}").text(path)
              .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at")))
    pieces = durable(pieces.withColumns({"quotes": _count(bare, '"').cast("long")} | {
        f"{kind}{s}": (_count(text, up) - (_count(text, down) if down else 0)).cast("long")
        for s, text in enumerate(outside) for kind, up, down in (("objects", "{", ""), ("lists", "[", "]"))}))
    order = [F.col("block"), F.col("at")]
    counts = durable(running(pieces.drop("value"), ["file"], order, {"seen": F.col("quotes")}))
    inside, ends_inside = (F.col("seen") - F.col("quotes")) % 2 == 1, F.col("seen") % 2 == 1
    opened = F.when(inside, F.col("objects1")).otherwise(F.col("objects0"))
    counts = counts.select("file", *order, (~ends_inside).alias("closes"), (opened - F.when(ends_inside, 0).otherwise(1)).alias("objects"),
                           F.when(inside, F.col("lists1")).otherwise(F.col("lists0")).alias("lists"))
    counts = durable(running(counts, ["file"], order, {"deep": F.col("objects"), "listed": F.col("lists")}))
    _require_closed(counts)
    ends = F.col("closes") & (F.col("deep") == 1) & (F.col("listed") == 1)
    counts = durable(counts.select("file", *order, ends.cast("int").alias("ends"), (F.col("deep") - F.col("objects") <= 1).alias("outer")))
    counts = running(counts, ["file"], order, {"ended": F.col("ends")})
    numbered = counts.select("file", *order, "outer", "ends", (F.col("ended") - F.col("ends")).cast("int").alias("feature"))
    # A feature begins in the last piece before its end that itself begins outside of all features.
    joined = pieces.select("file", *order, "value").join(numbered, ["file", "block", "at"])
    whole = joined.groupBy("file", "feature").agg(
        F.max("ends").alias("ends"), F.max(F.when(F.col("outer"), F.struct("block", "at"))).alias("first"),
        F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("pieces")).filter("ends = 1")
    own = F.filter("pieces", lambda p: F.struct(p["block"], p["at"]) >= F.col("first"))
    text = F.concat(F.array_join(F.transform(own, lambda p: p["value"]), "}"), F.lit("}"))
    return whole.select("file", "feature", F.regexp_replace(text, BEFORE, "").alias("text"))


def _require_closed(counts: DataFrame) -> None:
    """What follows the last brace counts as one brace more."""
    last = counts.groupBy("file").agg(F.max_by("deep", F.struct("block", "at")).alias("deep"))
    broken = last.filter(~F.col("deep").isin(0, -1)).orderBy("file").limit(20).collect()
    if broken:
        raise BrokenFile("; ".join(f"{r['file']} ends {r['deep']} objects deep" for r in broken))


def from_text(df: DataFrame, column: str = "value") -> DataFrame:
    document = F.from_json(F.col(column), FEATURES)
    rows = df.select(F.posexplode(document["features"]).alias("feature", "f"))
    return rows.select("feature", F.col("f.properties").alias("properties"),
                       F.col("f.geometry.type").alias("type"),
                       F.col("f.geometry.coordinates").alias("coordinates"))


def parts(features: DataFrame) -> DataFrame:
    """(feature, part, rings): one row per polygon; features without geometry have none.

    ``part`` is unique over the table and keeps feature order: both numbers have 31 bits at most.
    """
    single = F.array(F.from_json("coordinates", POLYGON))
    many = F.from_json("coordinates", f"array<{POLYGON}>")
    geometry = (F.when(F.col("type") == "Polygon", single)
                .when(F.col("type") == "MultiPolygon", many))
    return (features.filter(F.col("type").isNotNull())
            .select("feature", F.posexplode(geometry).alias("_n", "rings"))
            .select("feature", (F.col("feature").cast("long") * 2**32 + F.col("_n")).alias("part"), "rings"))
