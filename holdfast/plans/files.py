"""Queries that send given tables through files and back: CSV, JSON, point layers, publications, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators import checks as Q
from holdfast.operators import geo as G
from holdfast.plans.places import LOCATED, boundary_document, points
from holdfast.plans.registry import Tables, query
from holdfast.scale import checkpoint_folder
from holdfast.sources import dictionary, polygons, sinks, tables
from holdfast.streaming import snapshots


def shared(t: Tables) -> str:
    """A new folder that all executors reach."""
    return f"{checkpoint_folder(t.spark)}/files-{uuid.uuid4().hex}"


def written_csv(df: DataFrame, folder: str) -> str:
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return folder


@query("""SELECT doc_id, lang, source, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5, n_chars::BIGINT AS n_chars
FROM documents WHERE text <> ''""")
def csv_round_trip(t: Tables) -> DataFrame:
    """Whole texts with commas, quotes and line breaks, written as CSV and read again, none of them ragged.

    A line break within a field is read as one line feed, whatever it was.
    """
    columns = ["doc_id", "lang", "source", "n_chars", "text"]
    docs = t.documents.filter("text <> ''").select(*columns)
    text = F.regexp_replace("text", "\\r\\n?", "\\n")
    read = tables.read_table(t.spark, written_csv(docs, shared(t)), columns)
    whole = tables.typed(read.filter(f"not {tables.RAGGED}").drop(tables.RAGGED), {"doc_id": "long", "n_chars": "long"})
    return whole.select("doc_id", "lang", "source", F.md5(text).alias("text_md5"), "n_chars")


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0) AS ragged,
 count(*) FILTER (WHERE s_suppkey % 5 <> 0) AS named FROM supplier""")
def ragged_rows(t: Tables) -> DataFrame:
    """Rows a field short or long are read, padded, and counted; the file begins with a byte-order mark."""
    key = F.col("s_suppkey")
    line = F.concat_ws(",", key, F.col("s_nationkey"), F.when(key % 5 != 0, F.col("s_name")), F.when(key % 7 == 0, F.lit("extra")),
                       F.when((key % 7 == 0) & (key % 5 == 0), F.lit("more")))
    # A row a field short and one long would be of the right length: such keys get two more.
    head = t.spark.createDataFrame([("﻿k,nation,name", -1)], "line string, at long")
    lines = head.unionByName(t.supplier.select(line.alias("line"), key.cast("long").alias("at")))
    folder = shared(t)
    lines.coalesce(1).sortWithinPartitions("at").select("line").write.text(folder)
    read = tables.read_table(t.spark, folder, ["k", "nation", "name"])
    found = tables.defects(read).unionByName(
        read.agg(F.count_if(F.col("name").startswith("Supplier")).alias("named")), allowMissingColumns=True)
    return found.agg(*[F.max(c).alias(c) for c in ("rows", "ragged", "named")])


@query("SELECT n_nationkey::VARCHAR AS code, n_name AS text FROM nation")
def lookup_round_trip(t: Tables) -> DataFrame:
    """A code table from its file, where every code is listed twice, the second time with a later text."""
    listed = t.nation.select(F.col("n_nationkey").cast("string").alias("CODE"), F.col("n_name").alias("TEXT"))
    again = listed.withColumn("TEXT", F.concat(F.lit("~"), "TEXT"))
    return tables.lookup_table(t.spark, written_csv(listed.union(again), shared(t)), ["CODE", "TEXT"], "CODE", "TEXT")


@query("""SELECT o_custkey::VARCHAR AS code, arg_max(o_totalprice, strftime(o_orderdate, '%Y-%m-%d') || lpad(o_orderkey::VARCHAR, 12, '0'))::DOUBLE AS value
FROM orders GROUP BY 1""")
def latest_values(t: Tables) -> DataFrame:
    """The value of the last period of every code, from a file."""
    period = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    rows = t.orders.select(F.col("o_custkey").alias("code"), F.col("o_totalprice").alias("value"), period.alias("period"))
    return tables.latest_value(t.spark, written_csv(rows, shared(t)), ["code", "value", "period"], "code", "value", "period")


@query("SELECT n_name AS key, n_regionkey::VARCHAR AS class, count(s_suppkey) AS holders FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def dictionary_round_trip(t: Tables) -> DataFrame:
    """A name dictionary written as one JSON object, read again as a table, and met by names."""
    folder = shared(t)
    entries = t.nation.agg(F.to_json(sinks.as_object(F.col("n_name"), F.col("n_regionkey").cast("string"))).alias("value"))
    entries.coalesce(1).write.text(folder)
    read = dictionary.read_dictionary(t.spark, folder, optional=False)
    per = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    named = per.join(t.nation.select("n_nationkey", F.col("n_name").alias("key")), "n_nationkey")
    return read.join(named, "key", "left").select("key", "class", F.coalesce("n", F.lit(0)).alias("holders"))


@query("""SELECT vec_id, floor(embedding[1]::DOUBLE * 1e6) AS x, 'v' || vec_id AS name FROM embeddings""")
def point_layer(t: Tables) -> DataFrame:
    """Points and their names written as two tables; the first has no names, and they meet again by id."""
    folder = shared(t)
    points = t.embeddings.select("vec_id", F.floor(F.col("embedding")[0].cast("double") * 1e6).cast("double").alias("x"),
                                 F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"))
    sinks.write_point_layer(points, folder, "vec_id", "name")
    bare = t.spark.read.parquet(f"{folder}/points")
    if "name" in bare.columns:
        raise ValueError("the point layer has names")
    return bare.join(t.spark.read.parquet(f"{folder}/point_names"), "vec_id")


@query("""SELECT 'flags' AS result, count(DISTINCT l_returnflag) AS rows, count(*) AS lines, 1::BIGINT AS version FROM lineitem
UNION ALL SELECT 'statuses', count(DISTINCT o_orderstatus), count(*), 1 FROM orders""")
def published_results(t: Tables) -> DataFrame:
    """Results published together; a second run whose gate fails leaves the first version as it was."""
    folder = shared(t)
    flags = t.lineitem.groupBy(F.col("l_returnflag").alias("key")).agg(F.count(F.lit(1)).alias("lines"))
    statuses = t.orders.groupBy(F.col("o_orderstatus").alias("key")).agg(F.count(F.lit(1)).alias("lines"))

    def gates(total: DataFrame):
        def report(staged):
            sums = Q.reconcile(parts=staged["flags"].agg(F.sum("lines")), whole=total.agg(F.count(F.lit(1))))
            return Q.run_checks({"sums": sums}, [Q.equals("lines sum to the table", "sums", F.sum(F.col("whole") - F.col("parts")), 0)])
        return report

    sinks.publish(t.spark, {"flags": flags, "statuses": statuses}, folder, "Based on test tables", gates(t.lineitem))
    try:
        sinks.publish(t.spark, {"flags": flags.limit(1), "statuses": statuses}, folder, "Based on too little", gates(t.lineitem))
    except Q.GateFailure:
        pass
    shown = sinks.Published(t.spark, folder)
    lines = [shown.load(name).agg(F.lit(name).alias("result"), F.sum("lines").alias("lines")) for name in ("flags", "statuses")]
    return shown.manifest().join(F.broadcast(lines[0].unionByName(lines[1])), "result").select("result", "rows", "lines", "version")


@query(f"WITH {LOCATED} SELECT vec_id, region FROM located")
def located_from_file(t: Tables) -> DataFrame:
    """The first region that holds the point, the regions from a boundary file that is read in pieces."""
    folder = shared(t)
    boundary_document(t).coalesce(1).write.text(folder)
    features = polygons.read_polygons(t.spark, folder).withColumn("name", F.col("properties")["name"])
    parts = polygons.parts(G.drop_named(features, "name", "usual address"))
    return G.locate(points(t), parts, id="vec_id", lat="lat", lon="lon")


@query("SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS ids, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY event_type")
def snapshots_added_up(t: Tables) -> DataFrame:
    """Events that arrive as files in two lots: each is taken in once, though it is asked for three times."""
    folder = shared(t)
    source, target, progress = (f"{folder}/{part}" for part in ("in", "out", "progress"))
    events = t.events.select("event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))

    def rollup(batch: DataFrame) -> DataFrame:
        return batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"), F.sum("cents").alias("cents"))

    for lot in (0, 1, 2):
        if lot < 2:
            events.filter(F.col("event_id") % 2 == lot).write.mode("append").parquet(source)
        snapshots.take_in(t.spark, source, events.schema, target, progress, rollup)
    return snapshots.added_up(t.spark, target, ["event_type"], ["rows", "ids", "cents"])
