"""Queries on the register itself: keys, contracts, health, history, and the gates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.dates import is_year, year_token
from holdfast.functions.numbers import is_missing
from holdfast.functions.text import any_contains, clean_spaces, ordered_code
from holdfast.operators import checks as Q
from holdfast.operators import joins as J
from holdfast.operators import rollups as R
from holdfast.operators.geo import coarsened
from holdfast.plans import holdings as H
from holdfast.plans import places as P
from holdfast.plans.registry import MAST_SQL, PRICE_BANDS, REGISTER_SQL, Tables, query
from holdfast.scale import durable, skew_join

# --- counts -----------------------------------------------------------------------------------


@query(f"""WITH {REGISTER_SQL}, x AS (SELECT dev.*, lic.granted FROM dev LEFT JOIN lic USING (licence)),
n AS (SELECT granted, tx, direction, value FROM x)
SELECT count(*) AS rows, count(*) FILTER (WHERE tx) AS tx, count(*) FILTER (WHERE direction = 'F') AS rx,
 count(*) FILTER (WHERE value IS NULL) AS no_value, count(*) FILTER (WHERE value >= 100000) AS above,
 count(*) FILTER (WHERE granted) AS granted_rows, count(*) FILTER (WHERE granted AND tx) AS granted_tx,
 count(*) FILTER (WHERE granted AND direction = 'F') AS granted_rx,
 count(*) FILTER (WHERE granted AND value IS NULL) AS granted_no_value,
 count(*) FILTER (WHERE granted AND value >= 100000) AS granted_above,
 count(*) FILTER (WHERE granted IS NULL) AS unmatched_rows FROM n""")
def scalar_totals(t: Tables) -> DataFrame:
    """Every total of the fact in one pass, over all licences and over granted ones."""
    granted = t.orders.select(F.col("o_orderkey").alias("licence"), (F.col("o_orderstatus") == "F").alias("granted"))
    return R.scalar_totals(t.devices, granted, "licence", "granted", {
        "tx": F.col("tx"), "rx": F.col("direction") == "F", "no_value": is_missing(F.col("value")),
        "above": F.col("value") >= 100000})


@query("SELECT o_orderstatus AS status, count(*) AS rows FROM orders GROUP BY 1")
def status_histogram(t: Tables) -> DataFrame:
    return R.histogram(t.orders, F.col("o_orderstatus").alias("status"))


@query(f"""WITH {REGISTER_SQL} SELECT service, count(*) AS rows FROM dev JOIN lic USING (licence) GROUP BY service""")
def service_rows(t: Tables) -> DataFrame:
    """Device rows per service: counted per licence, then joined."""
    per = R.licence_rows(t.devices, "licence", "tx")
    services = t.orders.select(F.col("o_orderkey").alias("licence"), F.col("o_orderpriority").alias("service"))
    return per.join(services, "licence").groupBy("service").agg(F.sum("rows").alias("rows"))


@query("""SELECT l_orderkey AS licence, count(*) AS rows, count(*) FILTER (WHERE l_linestatus = 'O') AS tx
FROM lineitem GROUP BY 1""")
def licence_rows(t: Tables) -> DataFrame:
    return R.licence_rows(t.devices, "licence", "tx")


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey) AS licences FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, licences FROM c""")
def licences_per_client(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("licences"))
    return J.dense(per, t.customer.select("c_custkey"), ["c_custkey"], ["licences"])


CODES = [("A", "accepted"), ("R", "returned")]
CODES_SQL = "codes(code, description) AS (VALUES " + ", ".join(f"('{c}', '{d}')" for c, d in CODES) + ")"


def code_usage_of(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame(CODES, "code string, description string")
    used = t.lineitem.filter(F.col("l_returnflag").isNotNull()).groupBy(F.col("l_returnflag").alias("code")) \
        .agg(F.count(F.lit(1)).alias("rows"))
    return J.lookup(used, "code", table, "code", "description", "description")


@query(f"""WITH {CODES_SQL} SELECT l_returnflag AS code, count(*) AS rows, any_value(description) AS description
FROM lineitem LEFT JOIN codes ON code = l_returnflag WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def code_usage(t: Tables) -> DataFrame:
    """Codes in use with their description, NULL where the lookup has none."""
    return code_usage_of(t)


@query(f"""WITH {CODES_SQL} SELECT l_returnflag AS code, count(*) AS rows FROM lineitem
WHERE l_returnflag NOT IN (SELECT code FROM codes) GROUP BY 1""")
def undocumented_codes(t: Tables) -> DataFrame:
    """Codes in use that the lookup does not list, with their rows."""
    table = t.spark.createDataFrame(CODES, "code string, description string")
    return J.orphans(t.lineitem.withColumnRenamed("l_returnflag", "code"), table, "code")


@query(f"""WITH {CODES_SQL}, u AS (SELECT l_returnflag AS code, count(*) AS rows FROM lineitem
WHERE l_returnflag NOT IN (SELECT code FROM codes) GROUP BY 1)
SELECT count(*) AS codes, CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows FROM u""")
def undocumented_total(t: Tables) -> DataFrame:
    return undocumented_codes(t).agg(F.count(F.lit(1)).alias("codes"),
                                     F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


# --- history --------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT year(l_shipdate) AS year, l_returnflag = 'R' AS r FROM lineitem),
y AS (SELECT CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM d)
SELECT y.year, count(*) FILTER (WHERE r) AS returned, count(*) FILTER (WHERE NOT r) AS kept
FROM y LEFT JOIN d USING (year) GROUP BY y.year""")
def vintage_by_year(t: Tables) -> DataFrame:
    """Rows per authorisation year, two populations kept apart, no year left out."""
    kind = F.when(F.col("l_returnflag") == "R", F.lit("returned")).otherwise(F.lit("kept"))
    return R.vintage(t.lineitem, F.col("l_shipdate"), kind, ["returned", "kept"])


@query("""SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'never' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year,
count(*) AS licences FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def expiry_buckets(t: Tables) -> DataFrame:
    """Expiry years of granted licences; licences without a date never expire."""
    granted = t.orders.filter(F.col("o_orderstatus") == "F")
    expires = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate"))
    return R.year_histogram(granted, expires, "never", "licences")


@query("""SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) AS licences FROM orders
WHERE o_orderpriority <> '5-LOW' GROUP BY 1""")
def issue_years(t: Tables) -> DataFrame:
    """Issue years as tokens, the blank bucket left out of the axis."""
    issued = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    return R.year_histogram(t.orders, issued, "blank", "licences").filter(is_year(F.col("year")))


@query("""WITH s AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderdate END AS d, o_orderstatus AS medium FROM orders)
SELECT medium, count(d) AS dated, count(*) - count(d) AS undated, CAST(year(min(d)) AS INTEGER) AS first_year,
CAST(year(max(d)) AS INTEGER) AS last_year FROM s GROUP BY medium""")
def dated_split(t: Tables) -> DataFrame:
    """Dated and undated services by medium, and the ends of the axis."""
    day = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderdate"))
    return t.orders.select(F.col("o_orderstatus").alias("medium"), day.alias("d")).groupBy("medium").agg(
        F.count("d").alias("dated"), F.count_if(F.col("d").isNull()).alias("undated"),
        F.year(F.min("d")).alias("first_year"), F.year(F.max("d")).alias("last_year"))


@query("""WITH n AS (SELECT lang AS interest, count(*) AS licences FROM documents WHERE lang <> '' GROUP BY 1)
SELECT interest, licences FROM n ORDER BY licences DESC, interest LIMIT 14""")
def interest_histogram(t: Tables) -> DataFrame:
    """Services per community interest, blank ones left out."""
    named = t.documents.filter(F.col("lang").isNotNull() & (F.col("lang") != ""))
    return R.histogram(named, F.col("lang").alias("interest"), name="licences") \
        .orderBy(F.desc("licences"), "interest").limit(14)


# --- keys -----------------------------------------------------------------------------------------


@query("""WITH sites AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 1000),
f AS (SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey END AS k FROM lineitem)
SELECT CASE WHEN k IS NULL THEN 'blank' WHEN s_suppkey IS NULL THEN 'orphan' ELSE 'matched' END AS key_status, count(*) AS rows
FROM f LEFT JOIN sites ON s_suppkey = k GROUP BY 1""")
def site_key_status(t: Tables) -> DataFrame:
    """Rows whose site key is matched, blank, or in no site record."""
    facts = t.lineitem.select(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("site"))
    sites = t.supplier.filter(F.col("s_acctbal") >= 1000).select(F.col("s_suppkey").alias("site"))
    return J.key_status_counts(facts, sites, "site")


@query("""WITH sites AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal >= 1000)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS site, s_nationkey AS class,
 CASE WHEN s_suppkey IS NULL THEN 'orphan' ELSE 'matched' END AS key_status
FROM lineitem LEFT JOIN sites ON s_suppkey = l_suppkey""")
def device_sites(t: Tables) -> DataFrame:
    """Every device row with its site's class and the status of the key: no row is lost."""
    facts = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("site"))
    sites = t.supplier.filter(F.col("s_acctbal") >= 1000).select(
        F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("class"))
    return J.join_with_status(facts, sites, "site")


@query("""SELECT l_suppkey AS site, count(*) AS rows FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 1000) GROUP BY 1""")
def orphans(t: Tables) -> DataFrame:
    sites = t.supplier.filter(F.col("s_acctbal") >= 1000).select(F.col("s_suppkey").alias("site"))
    return J.orphans(t.lineitem.select(F.col("l_suppkey").alias("site")), sites, "site")


OVERLAP = {"part": ("lineitem", "l_partkey"), "order": ("orders", "o_orderkey"),
           "customer": ("customer", "c_custkey"), "document": ("documents", "doc_id")}


@query("WITH k AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{label}' AS s, CAST({c} AS VARCHAR) AS key FROM {table}" for label, (table, c) in OVERLAP.items())
    + """), o(s, i) AS (VALUES """ + ", ".join(f"('{s}', {i})" for i, s in enumerate(OVERLAP)) + """)
SELECT x.s AS a, y.s AS b, count(*) AS keys FROM k x JOIN k y USING (key) JOIN o ox ON ox.s = x.s JOIN o oy ON oy.s = y.s
WHERE ox.i <= oy.i GROUP BY ALL""")
def key_overlap(t: Tables) -> DataFrame:
    """Which key columns really share keys: the documented join is measured, not assumed."""
    return J.key_overlap({label: (getattr(t, table), F.col(c)) for label, (table, c) in OVERLAP.items()}) \
        .filter("keys > 0")


@query("""WITH d AS (SELECT DISTINCT l_partkey AS k FROM lineitem), c AS (SELECT doc_id AS k FROM labels),
m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT k FROM c))
SELECT (SELECT count(*) FROM c) AS texts, (SELECT count(DISTINCT k) FROM c) AS keys,
 (SELECT count(*) FROM lineitem WHERE l_partkey IN (SELECT k FROM c)) AS device_matches,
 (SELECT count(*) FROM m) AS licences_reached,
 (SELECT count(*) FROM (SELECT DISTINCT k FROM c) WHERE k IN (SELECT o_orderkey FROM orders)) AS documented_matches""")
def condition_coverage(t: Tables) -> DataFrame:
    """Texts, keys, device rows matched, licences reached, and what the documented join matches."""
    keys = t.labels.groupBy(F.col("doc_id").alias("k")).agg(F.count(F.lit(1)).alias("texts"))
    per = t.lineitem.groupBy(F.col("l_partkey").alias("k"), "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    matched = skew_join(per, keys.select("k"), "k", "left_semi", probe=t.lineitem.select(F.col("l_partkey").alias("k")))
    licences = durable(matched.groupBy("l_orderkey").agg(F.sum("n").alias("n")))
    documented = keys.join(t.orders.select(F.col("o_orderkey").alias("k")), "k", "left_semi")
    one = Q.reconcile(texts=keys.agg(F.sum("texts")), keys=keys.agg(F.count(F.lit(1))),
                      device_matches=licences.agg(F.coalesce(F.sum("n"), F.lit(0))),
                      licences_reached=licences.agg(F.count(F.lit(1))),
                      documented_matches=documented.agg(F.count(F.lit(1))))
    return one.select(*[F.col(c).cast("long").alias(c) for c in one.columns])


@query("""WITH u AS (SELECT DISTINCT o_custkey AS k FROM orders), ty AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')),
o AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT (SELECT count(*) FROM o) AS listed_keys, (SELECT count(*) FROM ty) AS typed_keys, (SELECT count(*) FROM u) AS unfiltered_keys,
 (SELECT count(*) FROM ty JOIN o USING (k)) AS typed_matches, (SELECT count(*) FROM u JOIN o USING (k)) AS unfiltered_matches""")
def typed_join_contract(t: Tables) -> DataFrame:
    """The join with its mandatory type filter, next to the unfiltered count that is wrong."""
    kind = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return J.typed_contract(t.orders, "o_custkey", kind,
                            t.customer.filter(F.col("c_mktsegment") != "MACHINERY"), "c_custkey")


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE n_name || ':' || n_regionkey IS DISTINCT FROM
 'NATION_' || n_nationkey || ':' || r_regionkey) AS differing
FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'""")
def column_agreement(t: Tables) -> DataFrame:
    """Rows whose redundant text differs from what their code stands for."""
    own = t.nation.select(F.col("n_regionkey").alias("code"), F.concat_ws(":", "n_name", "n_regionkey").alias("text"),
                          F.concat_ws("_", F.lit("NATION"), "n_nationkey").alias("expected"))
    per = own.select(F.concat_ws(":", "expected", "code").alias("code"), "text", F.col("code").alias("r"))
    listed = t.region.filter(F.col("r_name") != "ASIA").select(F.col("r_regionkey").alias("r"))
    table = per.join(listed, "r", "left_semi").select("code", F.col("code").alias("listed")).distinct()
    return J.disagreement(per, "code", "text", table, "code", "listed")


# --- health -----------------------------------------------------------------------------------------


@query("""WITH b AS (
SELECT 'parts never used' AS label, count(*) FILTER (WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS n, count(*) AS of FROM part
UNION ALL SELECT 'receiver rows', count(*) FILTER (WHERE l_linestatus = 'F'), count(*) FROM lineitem
UNION ALL SELECT 'rows of one service', count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'clients without category', count(*) FILTER (WHERE c_mktsegment = 'FURNITURE'), count(*) FROM customer
UNION ALL SELECT 'issued in the last year', count(*) FILTER (WHERE year(o_orderdate) = 2001), count(*) FROM orders
UNION ALL SELECT 'unlabelled documents', count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)), count(*) FROM documents)
SELECT label, n, of, n / of AS share FROM b""")
def health_ratios(t: Tables) -> DataFrame:
    """Six defects of the register, each with numerator, denominator and share."""
    used = t.lineitem.select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("used", F.lit(True))
    service = service_rows(t)
    labelled = t.labels.select("doc_id").distinct().withColumn("labelled", F.lit(True))
    return R.ratio_table({
        "parts never used": R.share_bar(t.part.join(used, "p_partkey", "left"), F.col("used").isNull()),
        "receiver rows": R.share_bar(t.lineitem, F.col("l_linestatus") == "F"),
        "rows of one service": service.agg(
            F.sum(F.when(F.col("service") == "1-URGENT", F.col("rows")).otherwise(0)).alias("n"),
            F.sum("rows").alias("of")),
        "clients without category": R.share_bar(t.customer, F.col("c_mktsegment") == "FURNITURE"),
        "issued in the last year": R.share_bar(t.orders, F.year("o_orderdate") == 2001),
        "unlabelled documents": R.share_bar(t.documents.join(labelled, "doc_id", "left"), F.col("labelled").isNull())})


@query("""SELECT s_suppkey, trim(regexp_replace(s_name, '\\s+', ' ', 'g')) AS name, upper(left(s_name, 4)) AS state,
 TRY_CAST(CASE WHEN s_acctbal >= 0 THEN CAST(s_acctbal AS VARCHAR) ELSE 'n/a' END AS DOUBLE) AS lat,
 CASE s_nationkey WHEN 9 THEN 0 WHEN 6 THEN 1 ELSE 2 END AS accuracy FROM supplier""")
def clean_dimension(t: Tables) -> DataFrame:
    """The cleaning projection of a site table: casts, spaces, case, accuracy code."""
    raw = t.supplier.select(
        "s_suppkey", F.concat(F.lit("  "), F.regexp_replace("s_name", " ", "   ")).alias("name"),
        F.left("s_name", F.lit(4)).alias("state"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("string")).otherwise("n/a").alias("lat"),
        F.col("s_nationkey").cast("string").alias("precision"))
    from holdfast.functions.numbers import number
    return raw.select("s_suppkey", clean_spaces(F.col("name")).alias("name"), F.upper("state").alias("state"),
                      number(F.col("lat")).alias("lat"),
                      ordered_code(F.col("precision"), ["9", "6"]).alias("accuracy"))


@query("""SELECT o_orderkey AS licence, o_custkey AS holder, c_mktsegment AS class, c_acctbal < 0 AS person,
 o_orderstatus = 'F' AS granted, n_name AS home, CAST(year(o_orderdate) AS VARCHAR) AS expires
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2""")
def enrich_licences(t: Tables) -> DataFrame:
    """Every licence with its holder, class, person flag, status, expiry and a looked-up text."""
    licences = t.orders.select(F.col("o_orderkey").alias("licence"), F.col("o_custkey").alias("holder"),
                               (F.col("o_orderstatus") == "F").alias("granted"),
                               year_token(F.col("o_orderdate"), "never").alias("expires"))
    clients = t.customer.select(F.col("c_custkey").alias("holder"), F.col("c_mktsegment").alias("class"),
                                (F.col("c_acctbal") < 0).alias("person"), F.col("c_nationkey").alias("nation"))
    listed = t.nation.filter(F.col("n_regionkey") != 2)
    joined = J.lookup(skew_join(licences, clients, "holder"), "nation", listed, "n_nationkey", "n_name", "home")
    return joined.drop("nation")


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE contains(p_name, 'ring') OR contains(p_brand, '#2')) AS flagged FROM part""")
def rows_with_piece(t: Tables) -> DataFrame:
    """Rows in which any column contains a piece of text."""
    return t.part.agg(F.count(F.lit(1)).alias("rows"),
                      F.sum(F.when(any_contains([F.col("p_name")], "ring") | any_contains([F.col("p_brand")], "#2"), 1)
                            .otherwise(0)).cast("long").alias("flagged"))


# --- gates ------------------------------------------------------------------------------------------


@query(f"""WITH {MAST_SQL}, s AS (SELECT site, bool_and(person) AS p, bool_or(granted) AS g FROM tenants GROUP BY site),
shipped AS (SELECT site FROM s WHERE NOT p AND g), hidden AS (SELECT site FROM s WHERE p)
SELECT (SELECT count(*) FROM hidden JOIN shipped USING (site)) AS leaked, (SELECT count(*) FROM hidden) AS suppressed,
 (SELECT count(*) FROM shipped) AS published""")
def leak_check(t: Tables) -> DataFrame:
    """No suppressed site is in the published layer: what must be hidden is found from device and holder rows."""
    shipped = R.site_rollup(P.kept_tenants(t), "site").filter("publishable").select("site")
    held = t.lineitem.select(F.col("l_orderkey").alias("site"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    known = held.join(t.supplier.select("s_suppkey", "s_acctbal"), "s_suppkey")
    hidden = known.select("site").distinct().join(known.filter("s_acctbal >= 0").select("site").distinct(), "site", "left_anti")
    leaked = J.common(hidden, shipped, F.col("site"), F.col("site"))
    one = Q.reconcile(leaked=leaked.agg(F.count(F.lit(1))), suppressed=hidden.agg(F.count(F.lit(1))),
                      published=shipped.agg(F.count(F.lit(1))))
    return one.select(*[F.col(c).cast("long").alias(c) for c in one.columns])


@query(f"""{H.BANDED}, p AS (SELECT band, count(DISTINCT holder) AS n, count(DISTINCT licence) AS licences FROM fact GROUP BY band)
SELECT band, n AS published, n AS recomputed, licences > n AS definitions_differ FROM p""")
def recount(t: Tables) -> DataFrame:
    """Holders per band, published against recounted straight from the fact by another plan."""
    from holdfast.operators.bands import band_rollup
    published = band_rollup(H.held(t), "band").select("band", F.col("holders").alias("n"))
    facts = t.lineitem.select(F.col("l_orderkey").alias("licence"),
                              PRICE_BANDS.index(F.col("l_extendedprice")).alias("band")).distinct()
    owners = t.orders.select(F.col("o_orderkey").alias("licence"), F.col("o_custkey").alias("holder"))
    per = facts.join(owners, "licence").groupBy("band", "holder").agg(F.count(F.lit(1)).alias("l"))
    again = per.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("licences"))
    compared = Q.recount(published, again.select("band", "n"), ["band"], "n").join(
        again.select("band", (F.col("licences") > F.col("n")).alias("definitions_differ")), "band")
    return compared


@query("""WITH ids AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS id FROM supplier WHERE s_acctbal >= 0),
r AS (SELECT DISTINCT l_suppkey, coalesce(id, -1) AS ref FROM lineitem LEFT JOIN ids ON s_suppkey = l_suppkey)
SELECT count(*) AS refs, count(*) FILTER (WHERE ref = -1) AS withheld,
 count(*) FILTER (WHERE ref <> -1 AND ref NOT IN (SELECT id FROM ids)) AS unresolved FROM r""")
def reference_resolution(t: Tables) -> DataFrame:
    """Every reference of an output names a published id, or is the mark of a withheld one."""
    from holdfast.operators.entity import dense_ids, resolve_ids
    holders = t.supplier.select("s_suppkey", "s_acctbal", (F.col("s_acctbal") < 0).alias("person"))
    ids = dense_ids(holders, "s_acctbal", "s_suppkey", "person", "id")
    used = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    listed = resolve_ids(used, "s_suppkey", ids, "s_suppkey", "id")
    refs = J.references((listed, "id", "lines"))
    lost = Q.unresolved(refs, "ref", ids, "id")
    one = Q.reconcile(refs=refs.agg(F.count(F.lit(1))), withheld=refs.agg(F.count_if(F.col("ref") == -1)),
                      unresolved=lost.agg(F.count(F.lit(1))))
    return one.select(*[F.col(c).cast("long").alias(c) for c in one.columns])


@query("""SELECT o_orderstatus AS key, count(*) AS actual, CAST(CASE o_orderstatus WHEN 'F' THEN 5 END AS BIGINT) AS expected FROM orders
GROUP BY 1 HAVING count(*) IS DISTINCT FROM CASE o_orderstatus WHEN 'F' THEN 5 END
UNION ALL SELECT 'X', NULL, 2""")
def histogram_gate(t: Tables) -> DataFrame:
    """Keys whose count differs from a pinned histogram."""
    return Q.histogram_difference(status_histogram(t), {"F": 5, "X": 2}, "status", "rows")


@query(f"""{H.BANDED}, n AS (SELECT (SELECT count(*) FROM lineitem) AS whole, (SELECT count(*) FROM fact) AS parts,
 (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS lost,
 (SELECT avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END) FROM lineitem) AS tx_share,
 (SELECT count(*) FROM (SELECT band, holder, count(*) AS h FROM fact GROUP BY ALL) JOIN
    (SELECT band, count(*) AS b FROM fact GROUP BY band) USING (band) WHERE h > b) AS too_much,
 (SELECT count(*) FROM orders WHERE o_orderdate < DATE '1995-01-01') AS early,
 (SELECT min(l_extendedprice) FROM lineitem) AS least, (SELECT count(*) FROM lineitem WHERE l_quantity < 1) AS small)
SELECT * FROM (SELECT 'parts sum to the whole' AS check_id, 'gate' AS kind, CAST(whole - parts AS DOUBLE) AS actual, 0.0::DOUBLE AS expected, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, whole = parts AS ok, 'rows in bands' AS detail FROM n
UNION ALL SELECT 'orphan licences', 'gate', lost, 0, NULL, NULL, lost = 0, '' FROM n
UNION ALL SELECT 'transmit share', 'warning', tx_share, NULL, 0.6, 0.9, tx_share BETWEEN 0.6 AND 0.9, '' FROM n
UNION ALL SELECT 'holder within band', 'gate', too_much, 0, NULL, NULL, too_much = 0, '' FROM n
UNION ALL SELECT 'nothing before 1995', 'gate', early, 0, NULL, NULL, early = 0, '' FROM n
UNION ALL SELECT 'unit of the value', 'gate', least, NULL, 100, NULL, least >= 100, '' FROM n
UNION ALL SELECT 'quantities below one', 'gate', small, 0, NULL, NULL, small = 0, '' FROM n)""")
def checks_report(t: Tables) -> DataFrame:
    """Gates and warnings over several sources, one aggregation a source."""
    held = durable(H.held(t))
    per_band = held.groupBy("band").agg(F.sum("rows").alias("b"))
    parts = Q.reconcile(whole=t.lineitem.agg(F.count(F.lit(1))), parts=held.agg(F.sum("rows")))
    lost = J.orphans(t.devices, t.orders.select(F.col("o_orderkey").alias("licence")), "licence")
    return Q.run_checks(
        {"parts": parts, "lost": lost, "devices": t.lineitem, "licences": t.orders,
         "held": held.join(per_band, "band")},
        [Q.equals("parts sum to the whole", "parts", F.sum(F.col("whole") - F.col("parts")), 0, "rows in bands"),
         Q.equals("orphan licences", "lost", F.coalesce(F.sum("rows"), F.lit(0)), 0),
         Q.plausible("transmit share", "devices", Q.share_of(F.col("l_linestatus") == "O"), 0.6, 0.9),
         Q.equals("holder within band", "held", Q.violations(F.col("rows") <= F.col("b")), 0),
         Q.equals("nothing before 1995", "licences", Q.rows_where(F.col("o_orderdate") < "1995-01-01"), 0),
         Q.in_range("unit of the value", "devices", F.min("l_extendedprice"), lo=100),
         Q.equals("quantities below one", "devices", Q.rows_where(F.col("l_quantity") < 1), 0)])


# Positions of boundaries to the nearest four degrees: fit for drawing, not for counting.
COARSE = 4.0


def _region_counts(edges: str) -> str:
    return f"""SELECT region, count(*) AS sites FROM (SELECT vec_id, coalesce(min(feature), -1) AS region FROM pts LEFT JOIN (
  SELECT vec_id, feature, part FROM pts JOIN {edges} ON (y1 > lat) <> (y2 > lat) AND lon < (x1 - x2) * (lat - y2) / (y1 - y2) + x2
  GROUP BY ALL HAVING count(*) % 2 = 1) USING (vec_id) GROUP BY vec_id) GROUP BY region"""


# What each gate says on the right input and on each wrong one, from the tables themselves.
@query(f"""WITH {P.POINTS_SQL}, {P._edges_sql()}, {P._edges_sql("drawn", lambda v: math.floor(v / COARSE + 0.5) * COARSE)},
fine AS ({_region_counts("edges")}), coarse AS ({_region_counts("drawn")}),
tried(check_id, plant, passes, wrong) AS (VALUES
 ('regions recounted', 'coarse boundaries', true, EXISTS (SELECT 1 FROM fine FULL JOIN coarse USING (region) WHERE fine.sites IS DISTINCT FROM coarse.sites)),
 ('devices without a licence', 'licence keys shifted', (SELECT count(*) FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey) = 0,
   (SELECT count(*) FROM (SELECT CASE WHEN l_linenumber = 2 THEN -l_orderkey ELSE l_orderkey END AS k FROM lineitem) ANTI JOIN orders ON o_orderkey = k) <> 0),
 ('devices without a licence', 'lines dropped', (SELECT count(*) FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey) = 0,
   (SELECT count(*) FROM (SELECT * FROM lineitem WHERE l_linenumber <> 2) ANTI JOIN orders ON o_orderkey = l_orderkey) <> 0),
 ('devices without a licence', 'values in cents', (SELECT count(*) FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey) = 0, false),
 ('lines pinned', 'licence keys shifted', true, false), ('lines pinned', 'values in cents', true, false),
 ('lines pinned', 'lines dropped', true, (SELECT count(*) FROM lineitem WHERE l_linenumber <> 2) <> (SELECT count(*) FROM lineitem)),
 ('unit of the value', 'licence keys shifted', (SELECT max(l_extendedprice) FROM lineitem) <= 1e6, false),
 ('unit of the value', 'lines dropped', (SELECT max(l_extendedprice) FROM lineitem) <= 1e6, false),
 ('unit of the value', 'values in cents', (SELECT max(l_extendedprice) FROM lineitem) <= 1e6, (SELECT max(l_extendedprice) * 100 FROM lineitem) > 1e6),
 ('transmit share is a share', 'licence keys shifted', true, false), ('transmit share is a share', 'lines dropped', true, false),
 ('transmit share is a share', 'values in cents', true, false),
 ('licences have a holder', NULL, (SELECT count(*) FROM orders WHERE o_custkey IS NULL) = 0, false))
SELECT check_id, plant, passes, passes AND wrong AS failed, NOT bool_or(passes AND wrong) OVER (PARTITION BY check_id) AS blind FROM tried""")
def gate_sensitivity(t: Tables) -> DataFrame:
    """Which gates notice which wrong input, and those that notice none."""
    parts = P.boundary_parts(t)
    right = durable(P.region_counts(t, parts))
    moved = F.when(F.col("l_linenumber") == 2, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    return Q.sensitivity(
        {"lines": t.lineitem, "licences": t.orders, "boundaries": parts},
        {"regions": lambda s: Q.recount(right, P.region_counts(t, s["boundaries"]), ["region"], "sites"),
         "lost": lambda s: J.orphans(s["lines"].select(F.col("l_orderkey").alias("k")), s["licences"].select(F.col("o_orderkey").alias("k")), "k"),
         "lines": lambda s: s["lines"], "licences": lambda s: s["licences"]},
        [Q.equals("regions recounted", "regions", Q.violations(F.col("published").eqNullSafe(F.col("recomputed"))), 0),
         Q.equals("devices without a licence", "lost", F.coalesce(F.sum("rows"), F.lit(0)), 0),
         Q.equals("lines pinned", "lines", Q.rows(), t.lineitem.count()),
         Q.in_range("unit of the value", "lines", F.max("l_extendedprice"), hi=1e6),
         Q.in_range("transmit share is a share", "lines", Q.share_of(F.col("l_linestatus") == "O"), 0, 1),
         Q.equals("licences have a holder", "licences", Q.rows_where(F.col("o_custkey").isNull()), 0)],
        [Q.Plant("coarse boundaries", "boundaries", lambda df: coarsened(df, COARSE)),
         Q.Plant("licence keys shifted", "lines", lambda df: df.withColumn("l_orderkey", moved)),
         Q.Plant("lines dropped", "lines", lambda df: df.filter("l_linenumber <> 2")),
         Q.Plant("values in cents", "lines", lambda df: df.withColumn("l_extendedprice", F.col("l_extendedprice") * 100))])
