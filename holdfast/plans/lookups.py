"""Queries that look single things up, flatten and sort lists, and join on two columns, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import width
from holdfast.operators import checks as Q
from holdfast.operators import entity as E
from holdfast.operators import joins as J
from holdfast.plans.registry import Tables, query
from holdfast.scale import skew_join


@query("""SELECT c_custkey AS holder, c_name AS name, count(o_orderkey) AS licences
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (-1, 3, 7, 1000000000) GROUP BY ALL""")
def holders_by_id(t: Tables) -> DataFrame:
    """Holders by id with their licences; ids that name none, and -1, give no row."""
    asked = J.by_ids(t.clients.select("holder", "name"), "holder", [-1, 3, 7, 1_000_000_000])
    held = J.by_ids(t.owners, "holder", [-1, 3, 7, 1_000_000_000]).groupBy("holder").agg(F.count(F.lit(1)).alias("licences"))
    return asked.join(held, "holder", "left").fillna(0, ["licences"])


@query("""SELECT c_nationkey AS root, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS types FROM customer GROUP BY 1""")
def entity_types(t: Tables) -> DataFrame:
    """The set of record types of every merged entity."""
    found = E.record_types(t.customer, "c_nationkey", "c_mktsegment")
    return found.select(F.col("c_nationkey").alias("root"), F.array_join("types", "|").alias("types"))


@query("""WITH n AS (SELECT c_nationkey AS region, c_mktsegment AS class, count(*) AS n FROM customer GROUP BY ALL)
SELECT region, string_agg(class || ':' || n, '|' ORDER BY n DESC, class) AS classes FROM n GROUP BY region""")
def region_class_lists(t: Tables) -> DataFrame:
    """Classes of every region as one list, sorted by number and then by name."""
    n = t.customer.groupBy(F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    listed = n.groupBy("region").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("s"), "class"))).alias("l"))
    each = F.transform("l", lambda x: F.concat_ws(":", x["class"], (-x["s"]).cast("string")))
    return listed.select("region", F.array_join(each, "|").alias("classes"))


@query("""SELECT l_suppkey AS area, sum((l_extendedprice * 2 - l_extendedprice) / 1e6
  + coalesce(CASE WHEN l_returnflag = 'R' THEN (l_extendedprice + 5e5 - l_extendedprice) / 1e6 END, 0)) AS width FROM lineitem GROUP BY 1""")
def area_widths(t: Tables) -> DataFrame:
    """Width of the blocks of every area: the lower interval, and the upper one where there is one."""
    lo, upper = F.col("l_extendedprice"), F.col("l_returnflag") == "R"
    each = width(lo, lo * 2, F.when(upper, lo), F.when(upper, lo + F.lit(5e5)))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("area")).agg(F.sum(each).alias("width"))


@query("""WITH a AS (SELECT l_orderkey AS licence, l_suppkey AS area, max(l_shipdate) AS label FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT l_returnflag AS kind, count(*) AS blocks, count(DISTINCT (l_orderkey, l_suppkey)) AS areas, max(label) AS last
FROM lineitem JOIN a ON licence = l_orderkey AND area = l_suppkey GROUP BY 1""")
def blocks_of_named_areas(t: Tables) -> DataFrame:
    """Blocks joined to the areas of their licence on both columns of the key: every block, one area each."""
    named = t.lineitem.filter("l_returnflag <> 'N'").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("label"))
    joined = skew_join(t.lineitem.select("l_orderkey", "l_suppkey", "l_returnflag"), named, ["l_orderkey", "l_suppkey"])
    per = joined.groupBy(F.col("l_returnflag").alias("kind"), "l_orderkey", "l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("label").alias("label"))
    return per.groupBy("kind").agg(F.sum("n").alias("blocks"), F.count(F.lit(1)).alias("areas"), F.max("label").alias("last"))


@query("""WITH refs AS (SELECT 'size' AS source, unnest([p_size, p_size + 20]) AS ref FROM part UNION ALL SELECT 'key', s_suppkey FROM supplier)
SELECT source, count(*) AS refs, count(*) FILTER (WHERE n_nationkey IS NULL) AS unresolved
FROM refs LEFT JOIN nation ON n_nationkey = ref GROUP BY source""")
def list_references(t: Tables) -> DataFrame:
    """References in a list column and in a plain one, flattened and resolved against one list of ids."""
    sizes = t.part.select(F.array("p_size", F.col("p_size") + 20).alias("ids"))
    refs = J.references((sizes, "ids", "size"), (t.supplier, "s_suppkey", "key"))
    listed = t.nation.select(F.col("n_nationkey").cast("long").alias("ref"), F.lit(True).alias("found"))
    per = refs.groupBy("source", "ref").agg(F.count(F.lit(1)).alias("n")).join(listed, "ref", "left")
    return per.groupBy("source").agg(F.sum("n").alias("refs"),
                                     F.sum(F.when(F.col("found").isNull(), F.col("n")).otherwise(0)).alias("unresolved"))


@query("""SELECT 'nations' AS check_id, CAST(count(*) AS DOUBLE) AS actual, count(*) = 25 AS ok FROM nation
UNION ALL SELECT 'regions', count(*), count(*) = 6 FROM region
UNION ALL SELECT 'devices', count(*), count(*) >= 1 FROM lineitem""")
def pinned_rows(t: Tables) -> DataFrame:
    """Row counts against pinned ones; the second is pinned wrongly and has to fail."""
    report = Q.run_checks({"nation": t.nation, "region": t.region, "lineitem": t.lineitem}, [
        Q.equals("nations", "nation", Q.rows(), 25), Q.equals("regions", "region", Q.rows(), 6),
        Q.in_range("devices", "lineitem", Q.rows(), lo=1)])
    return report.select("check_id", "actual", "ok")


@query("""WITH p AS (SELECT DISTINCT trim(c_name) AS name FROM customer WHERE c_acctbal < 0),
shown AS (SELECT c_name AS name FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT upper(c_name) FROM customer WHERE c_custkey % 50 = 0)
SELECT (SELECT count(*) FROM p) AS withheld, count(*) AS leaked FROM p WHERE upper(name) IN (SELECT upper(trim(name)) FROM shown)""")
def leak_by_name(t: Tables) -> DataFrame:
    """Names of withheld holders among the names shown: some are planted and have to be found."""
    withheld = t.clients.filter("person").select(F.trim("name").alias("name")).distinct()
    shown = t.clients.filter("not person").select("name").unionByName(
        t.clients.filter(F.col("holder") % 50 == 0).select(F.upper("name").alias("name")))
    leaked = J.common(withheld, shown, F.upper("name"), F.upper(F.trim("name")))
    both = Q.reconcile(withheld=withheld.agg(F.count(F.lit(1))), leaked=leaked.agg(F.count(F.lit(1))))
    return both.select(*[F.col(c).cast("long").alias(c) for c in both.columns])
