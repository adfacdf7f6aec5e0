"""Queries on who the holders are: merging, naming, classes, suppression, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.identifiers import weighted_checksum
from holdfast.functions.text import name_key as key_of
from holdfast.functions.text import personal_shape as shape_of
from holdfast.functions.text import whole_words
from holdfast.operators import concentration as C
from holdfast.operators import entity as E
from holdfast.operators import rollups as R
from holdfast.operators.joins import equal_or_all
from holdfast.operators.ordering import every_kth, position, top
from holdfast.plans.registry import REGISTER_SQL, Tables, query
from holdfast.scale import durable, skew_join

# Customers stand for licensee records. Two keys join them, so chains of records occur.
KEYS_SQL = """rec AS (SELECT c_custkey AS id, 'a' || c_nationkey || '|' || CAST(floor(c_acctbal / 20) AS BIGINT) AS k1,
  'b' || c_mktsegment || '|' || CAST(floor(c_acctbal / 4) AS BIGINT) AS k2 FROM customer),
star AS (SELECT id, min(id) OVER (PARTITION BY k1) AS m FROM rec UNION SELECT id, min(id) OVER (PARTITION BY k2) FROM rec),
edge AS (SELECT id AS a, m AS b FROM star WHERE id <> m UNION SELECT m, id FROM star WHERE id <> m),
walk(id, r) AS (SELECT id, id FROM rec UNION SELECT edge.b, walk.r FROM walk JOIN edge ON edge.a = walk.id),
merged AS (SELECT id, min(r) AS root FROM walk GROUP BY id)"""
# Recursive, and the entity model above the merge: counts, display name, person flag.
ENTITY_SQL = f"""WITH RECURSIVE {KEYS_SQL},
per_client AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1),
cli AS (SELECT id, root, c_name, c_mktsegment, c_acctbal < 0 AS person, coalesce(n, 0) AS lic
        FROM merged JOIN customer ON c_custkey = id LEFT JOIN per_client USING (id)),
ent AS (SELECT root, arg_min(c_name, (-lic, id)) AS name, arg_min(c_mktsegment, (-lic, id)) AS class,
               count(*) AS records, count(DISTINCT c_mktsegment) AS types, bool_or(person) AS person,
               CAST(sum(lic) AS BIGINT) AS licences FROM cli GROUP BY root)"""


def merged_records(t: Tables) -> DataFrame:
    """The merge, made once per set of tables."""
    return t.once("merged", lambda: durable(_merge(t)))


def _merge(t: Tables) -> DataFrame:
    nation, segment, balance = F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    keys = [F.concat(nation.cast("string"), F.lit("|"), F.floor(balance / 20).cast("string")),
            F.concat(segment, F.lit("|"), F.floor(balance / 4).cast("string"))]
    return E.components(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"),
                        "c_custkey", keys)


def client_records(t: Tables) -> DataFrame:
    """Licensee records with their root and licence count."""
    per_client = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("lic"))
    return (t.customer.join(merged_records(t), "c_custkey").join(per_client, "c_custkey", "left")
            .fillna(0, ["lic"]).withColumn("person", F.col("c_acctbal") < 0))


def entity_table(t: Tables) -> DataFrame:
    """Merged entities with the class of their largest record, made once."""
    return t.once("entities", lambda: durable(_entities(t)))


def _entities(t: Tables) -> DataFrame:
    records = client_records(t)
    ents = E.entities(records, id="c_custkey", root="root", name="c_name", type="c_mktsegment",
                      person="person", licences="lic")
    cls = records.groupBy("root").agg(
        F.min_by("c_mktsegment", F.struct(-F.col("lic"), F.col("c_custkey"))).alias("class"))
    return ents.join(cls, "root")


def entity_licences(t: Tables, of_entity: DataFrame | None = None) -> DataFrame:
    """Licences with the entity that holds them, and what ``of_entity`` says of it.

    The attributes are brought to the records first: the licences then take part in one join.
    """
    records = merged_records(t).withColumnRenamed("c_custkey", "holder")
    if of_entity is not None:
        records = records.join(of_entity, "root", "left")
    licences = t.orders.select(F.col("o_orderkey").alias("licence"), F.col("o_custkey").alias("holder"),
                               F.col("o_orderpriority").alias("service"))
    return skew_join(licences, records, "holder").drop("holder")


@query(f"WITH RECURSIVE {KEYS_SQL} SELECT id AS c_custkey, root FROM merged")
def entity_components(t: Tables) -> DataFrame:
    """The smallest record of every group of records joined by shared keys, transitively."""
    return merged_records(t)


@query(f"""WITH RECURSIVE {KEYS_SQL}, sizes AS (SELECT root, count(*) AS size FROM merged GROUP BY root)
SELECT size, count(*) AS entities FROM sizes GROUP BY size""")
def component_sizes(t: Tables) -> DataFrame:
    sizes = merged_records(t).groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("entities"))


@query(f"{ENTITY_SQL} SELECT root, name, class, records, types, person, licences FROM ent")
def entity_summary(t: Tables) -> DataFrame:
    """Display name, class, records, record types, person flag and licences per entity."""
    return entity_table(t)


@query(f"""{ENTITY_SQL} SELECT root, row_number() OVER (ORDER BY licences DESC, root) - 1 AS entity_id
FROM ent WHERE NOT person""")
def entity_ids(t: Tables) -> DataFrame:
    """The published id space: named entities numbered from 0 by licences."""
    return E.dense_ids(entity_table(t), "licences", "root", "person")


@query(f"""{ENTITY_SQL}, ids AS (SELECT root, row_number() OVER (ORDER BY licences DESC, root) - 1 AS entity_id
  FROM ent WHERE NOT person)
SELECT o_orderkey AS licence, coalesce(entity_id, -1) AS entity_id
FROM orders JOIN merged ON merged.id = o_custkey LEFT JOIN ids USING (root)""")
def licence_entity_ids(t: Tables) -> DataFrame:
    """Every licence with the published id of its holder, -1 when withheld."""
    ids = E.dense_ids(entity_table(t), "licences", "root", "person")
    return entity_licences(t, ids).select("licence", F.coalesce("entity_id", F.lit(-1)).alias("entity_id"))


@query(f"""{ENTITY_SQL}, d AS (SELECT root, count(*) AS devices, count(*) FILTER (WHERE l_linestatus = 'O') AS tx,
  count(DISTINCT l_partkey) AS sites FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN merged ON merged.id = o_custkey GROUP BY root)
SELECT root, name, class, records, types, person, licences, coalesce(devices, 0) AS devices,
       coalesce(tx, 0) AS tx, coalesce(sites, 0) AS sites FROM ent LEFT JOIN d USING (root)""")
def entity_totals(t: Tables) -> DataFrame:
    """Licences, devices, transmit rows and live sites per merged entity."""
    return totals(t)


def totals(t: Tables, only: Column | None = None) -> DataFrame:
    """The totals of all entities, or of those that satisfy ``only``, whose licences alone are then joined."""
    ents = entity_table(t)
    if only is not None:
        ents = ents.filter(only)
    owners = merged_records(t).withColumnRenamed("c_custkey", "holder")
    if only is not None:
        owners = owners.join(ents.select("root"), "root", "left_semi")
    licences = skew_join(t.owners, owners, "holder")
    return R.holder_totals(ents, t.devices, licences, key="root", licence="licence", site="site", transmit="tx")


@query(f"""{ENTITY_SQL} SELECT DISTINCT root, o_orderpriority AS service
FROM orders JOIN merged ON merged.id = o_custkey""")
def entity_services(t: Tables) -> DataFrame:
    """The services of every entity, in long form."""
    return entity_licences(t).select("root", "service").distinct()


@query(f"""{ENTITY_SQL}, d AS (SELECT root, count(*) AS devices, count(DISTINCT l_partkey) AS sites
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN merged ON merged.id = o_custkey GROUP BY root)
SELECT count(*) AS entities, CAST(sum(licences) AS BIGINT) AS licences, CAST(sum(devices) AS BIGINT) AS devices,
       CAST(sum(sites) AS BIGINT) AS sites, CAST(sum(records) AS BIGINT) AS records
FROM ent LEFT JOIN d USING (root) WHERE person""")
def withheld_aggregate(t: Tables) -> DataFrame:
    """Counts, and only counts, of the entities that may not be named."""
    return E.withheld_totals(totals(t, F.col("person")), "person", {"licences": "licences", "devices": "devices",
                                                   "sites": "sites", "records": "records"})


@query(f"""{ENTITY_SQL}
SELECT count(*) FILTER (WHERE c.person) AS client_level_records,
       CAST(coalesce(sum(c.lic) FILTER (WHERE c.person), 0) AS BIGINT) AS client_level_licences,
       CAST(coalesce(sum(c.lic) FILTER (WHERE ent.person), 0) AS BIGINT) AS entity_level_licences
FROM cli c JOIN ent USING (root)""")
def withheld_levels(t: Tables) -> DataFrame:
    """Withheld licences by record flag and by entity flag: the second is the one to publish."""
    records = client_records(t)
    flags = records.groupBy("root").agg(
        F.bool_or("person").alias("any"), F.sum("lic").alias("all_lic"),
        F.count_if("person").alias("n"), F.sum(F.when(F.col("person"), F.col("lic")).otherwise(0)).alias("own"))
    return flags.agg(F.sum("n").alias("client_level_records"), F.sum("own").alias("client_level_licences"),
                     F.sum(F.when(F.col("any"), F.col("all_lic")).otherwise(0)).alias("entity_level_licences"))


# --- names, identifiers, rules ------------------------------------------------------------------

# RE2 and Java agree on these classes; the text has no other spaces than the ones listed.
KEY_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(upper(replace({x}, 'ß', 'SS')),
 '&', ' AND '), '\bLTD\b', 'LIMITED', 'g'), '\bINCORPORATED\b', 'INC', 'g'), '[.,''’"()/-]', ' ', 'g'),
 '[\s\x{{00A0}}\x{{202F}}\x{{2007}}]+', ' ', 'g'))"""


@query(f"""SELECT doc_id, CAST(length({KEY_SQL.format(x='text')}) AS INTEGER) AS key_length, md5({KEY_SQL.format(x='text')}) AS key_md5
FROM documents""")
def name_key(t: Tables) -> DataFrame:
    """The name key of every document's whole text."""
    keyed = t.documents.select("doc_id", key_of(F.col("text")).alias("key"))
    return keyed.select("doc_id", F.length("key").alias("key_length"), F.md5(F.col("key").cast("binary")).alias("key_md5"))


@query(f"""WITH k AS (SELECT doc_id, md5({KEY_SQL.format(x='text')}) AS m FROM documents),
f AS (SELECT min(doc_id) AS first_doc, count(*) AS copies FROM k GROUP BY m)
SELECT first_doc, copies FROM f WHERE copies > 1""")
def shared_name_keys(t: Tables) -> DataFrame:
    """Groups of documents with the same key: what the merge by name starts from."""
    keyed = t.documents.select("doc_id", F.md5(key_of(F.col("text")).cast("binary")).alias("m"))
    groups = keyed.groupBy("m").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    return groups.filter("copies > 1").drop("m")


CHECK_SQL = " + ".join(f"(CAST(substr(d, {i + 1}, 1) AS BIGINT){' - 1' if i == 0 else ''}) * {w}"
                       for i, w in enumerate((10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)))


@query(f"""WITH x AS (SELECT c_custkey, CAST(10000000000 + c_custkey * 7919 AS VARCHAR) AS d FROM customer)
SELECT c_custkey, ({CHECK_SQL}) % 89 = 0 AS valid FROM x""")
def checksum_valid(t: Tables) -> DataFrame:
    """Checksum of an eleven-digit identifier, here made from the key of every customer."""
    number = (F.lit(10_000_000_000) + F.col("c_custkey") * 7919).cast("string")
    spaced = F.concat(F.substring(number, 1, 2), F.lit(" "), F.substring(number, 3, 9))
    return t.customer.select("c_custkey", weighted_checksum(
        spaced, (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19), 89, lead_offset=1).alias("valid"))


NOT_PERSONAL = ["WIDGET", "GIZMO", "PLATE"]
SHAPE_SQL = r"""(regexp_matches(k, '^[A-Z'']{1,15}( [A-Z'']{1,15}){1,3}$') AND NOT contains(k, ' AND ')
 OR contains(k, ' AND ') AND len(string_split(k, ' AND ')) <= 3
    AND len(list_filter(string_split(k, ' AND '), lambda p: NOT regexp_matches(p, '^ *[A-Z'']{1,15}( +[A-Z'']{1,15}){0,3} *$'))) = 0)
 AND k <> '' AND NOT regexp_matches(k, '[0-9]') AND NOT regexp_matches(k, '\b(WIDGET|GIZMO|PLATE)\b')"""


@query(f"""WITH a AS (SELECT DISTINCT p_name AS x FROM part UNION SELECT p_name || ' & ' || p_type FROM part
  UNION SELECT p_name || ' & ' || p_type || ' & ' || p_brand FROM part), n AS (SELECT x, {KEY_SQL.format(x='x')} AS k FROM a)
SELECT x AS name, {SHAPE_SQL} AS personal FROM n""")
def personal_shape(t: Tables) -> DataFrame:
    """Does a name look like one person, or a few joined by AND? Part names stand for names."""
    amp = F.lit(" & ")
    names = [F.col("p_name"), F.concat("p_name", amp, "p_type"), F.concat("p_name", amp, "p_type", amp, "p_brand")]
    listed = t.part.select(F.explode(F.array(*names)).alias("name")).distinct()
    return listed.withColumn("personal", shape_of(key_of(F.col("name")), NOT_PERSONAL))


@query(f"""WITH n AS (SELECT o_custkey, count(*) AS lic FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_mktsegment, c_acctbal, coalesce(lic, 0) AS lic, p.p_name,
             {KEY_SQL.format(x='p.p_name')} AS k
      FROM customer LEFT JOIN n ON o_custkey = c_custkey JOIN part p ON p_partkey = c_custkey)
SELECT c_custkey, c_mktsegment = 'HOUSEHOLD' OR (c_acctbal < 5000 AND lic <= 5 AND {SHAPE_SQL}) AS person FROM c""")
def person_flag(t: Tables) -> DataFrame:
    """The type flag, or no company number, few licences and a personal name."""
    per_client = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("lic"))
    names = t.part.select(F.col("p_partkey").alias("c_custkey"), "p_name")
    c = (t.customer.join(names, "c_custkey").join(per_client, "c_custkey", "left").fillna(0, ["lic"]))
    return c.select("c_custkey", E.person_flag(
        F.col("c_mktsegment") == "HOUSEHOLD", F.col("c_acctbal") >= 5000, F.col("lic"),
        key_of(F.col("p_name")), NOT_PERSONAL).alias("person"))


RULES = [(whole_words(["BOLT", "GEAR"]), "FASTENER"), (whole_words(["RED", "BLUE"]), "COLOURED"),
         (whole_words(["OLD", "NEW"]), "DATED"), (whole_words(["BOLT"]), "NEVER")]
DICTIONARY = '{"RED RING": "JEWEL", "OLD BOLT": "RELIC", "SMALL ANVIL": "TOOL"}'


@query(f"""WITH k AS (SELECT p_partkey, {KEY_SQL.format(x='p_name')} AS k, p_size = 7 AS person FROM part),
d(key, class) AS (VALUES ('RED RING', 'JEWEL'), ('OLD BOLT', 'RELIC'), ('SMALL ANVIL', 'TOOL'))
SELECT p_partkey, CASE WHEN person THEN 'INDIVIDUAL' WHEN d.class IS NOT NULL THEN d.class
  WHEN regexp_matches(k, '\\b(BOLT|GEAR)\\b') THEN 'FASTENER' WHEN regexp_matches(k, '\\b(RED|BLUE)\\b') THEN 'COLOURED'
  WHEN regexp_matches(k, '\\b(OLD|NEW)\\b') THEN 'DATED' ELSE 'UNCLASSIFIED' END AS class
FROM k LEFT JOIN d ON d.key = k.k""")
def rule_classify(t: Tables) -> DataFrame:
    """Person, else the dictionary, else the first of the ordered rules, else unclassified."""
    named = t.part.select("p_partkey", key_of(F.col("p_name")).alias("k"), (F.col("p_size") == 7).alias("person"))
    listed = t.spark.createDataFrame([(DICTIONARY,)], "value string").select(
        F.explode(F.from_json("value", "map<string,string>")).alias("key", "class"))
    return E.classify(named, "k", "person", listed, RULES).select("p_partkey", "class")


# --- classes and concentration --------------------------------------------------------------------


@query(f"""WITH {REGISTER_SQL}, h AS (SELECT holder, class, count(*) AS licences FROM lic GROUP BY ALL),
d AS (SELECT holder, count(*) AS devices, count(*) FILTER (WHERE tx) AS tx, count(DISTINCT site) AS sites
      FROM dev JOIN lic USING (licence) GROUP BY holder)
SELECT c.c_mktsegment AS class, CAST(sum(coalesce(licences, 0)) AS BIGINT) AS licences,
 CAST(sum(coalesce(devices, 0)) AS BIGINT) AS devices, CAST(sum(coalesce(tx, 0)) AS BIGINT) AS tx,
 CAST(sum(coalesce(sites, 0)) AS BIGINT) AS sites, count(*) AS entities
FROM customer c LEFT JOIN h ON h.holder = c_custkey LEFT JOIN d ON d.holder = c_custkey GROUP BY 1""")
def class_totals(t: Tables) -> DataFrame:
    """Licences, devices, transmit rows, sites and holders per class."""
    return R.class_totals(holder_totals(t), "class", ["licences", "devices", "tx", "sites"],
                          t.clients.select("class").distinct())


def holder_totals(t: Tables) -> DataFrame:
    """The same per customer, without merging."""
    per_holder = t.owners.groupBy("holder").agg(F.count(F.lit(1)).alias("licences"))
    ents = t.clients.join(per_holder, "holder", "left").fillna(0, ["licences"])
    return R.holder_totals(ents, t.devices, t.owners, key="holder", licence="licence", site="site", transmit="tx")


@query("""WITH s AS (SELECT DISTINCT o_orderpriority AS service FROM orders),
c AS (SELECT DISTINCT c_mktsegment AS class FROM customer UNION SELECT 'NO LICENCE AT ALL'),
n AS (SELECT c_mktsegment AS class, o_orderpriority AS service, count(*) AS licences
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT class, service, coalesce(licences, 0) AS licences FROM (SELECT class, service FROM c CROSS JOIN s) LEFT JOIN n USING (class, service)""")
def class_service_matrix(t: Tables) -> DataFrame:
    """Licences per class and service, combinations without any included: one listed class has none."""
    per_holder = t.orders.groupBy(F.col("o_custkey").alias("holder"), F.col("o_orderpriority").alias("service")).agg(
        F.count(F.lit(1)).alias("n"))
    df = per_holder.join(t.clients.select("holder", "class"), "holder")
    listed = t.clients.select("class").unionByName(t.spark.createDataFrame([("NO LICENCE AT ALL",)], "class string"))
    return R.matrix(df, "class", "service", listed, per_holder.select("service"), weight="n")


@query(f"""WITH {REGISTER_SQL}, l AS (SELECT class, count(*) AS licences FROM lic GROUP BY class),
d AS (SELECT class, count(*) AS devices FROM dev JOIN lic USING (licence) GROUP BY class),
x AS (SELECT class, licences, devices, licences * 100.0 / sum(licences) OVER () AS licences_share,
             devices * 100.0 / sum(devices) OVER () AS devices_share,
             devices / greatest(1, licences) AS devices_per_licences FROM l JOIN d USING (class))
SELECT class, licences, devices, CAST(licences_share AS DOUBLE) AS licences_share,
       CAST(devices_share AS DOUBLE) AS devices_share, devices_per_licences
FROM x WHERE licences_share > 20 OR devices_share > 20""")
def class_share_slope(t: Tables) -> DataFrame:
    """Share of licences against share of devices, classes above a threshold on either."""
    return R.shares(holder_totals(t), "class", {"licences": "licences", "devices": "devices"}, 20.0)


LICENCES_SQL = """t AS (SELECT c_custkey AS holder, c_acctbal < 0 AS person, count(o_orderkey) AS n
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING count(o_orderkey) > 0)"""


def holdings_of(t: Tables) -> DataFrame:
    per_holder = t.owners.groupBy("holder").agg(F.count(F.lit(1)).alias("n"))
    return per_holder.join(t.clients.select("holder", "person"), "holder")


@query(f"""WITH {LICENCES_SQL}, w AS (SELECT sum(n) AS total FROM t)
SELECT 'total' AS metric, CAST(total AS DOUBLE) AS value FROM w
UNION ALL SELECT 'largest', max(n) FROM t WHERE NOT person
UNION ALL SELECT 'top10_share', floor(s / any_value(total) * 100 * 100 + 0.5) / 100 FROM
  (SELECT sum(n) AS s FROM (SELECT n FROM t WHERE NOT person ORDER BY n DESC, holder LIMIT 10)), w GROUP BY s
UNION ALL SELECT 'hhi', floor(sum(n * n) * 1e4 / (any_value(total) * any_value(total)) + 0.5) FROM t, w WHERE NOT person
UNION ALL SELECT 'single_named', count(*) FROM t WHERE NOT person AND n = 1
UNION ALL SELECT 'single_all', count(*) FROM t WHERE n = 1""")
def headline_concentration(t: Tables) -> DataFrame:
    """Largest holder, share of the ten largest, HHI, holders of a single licence."""
    return C.headline(holdings_of(t), "n", "person")


@query(f"WITH {LICENCES_SQL} SELECT holder, n FROM t WHERE NOT person ORDER BY n DESC, holder LIMIT 50")
def fifty_largest(t: Tables) -> DataFrame:
    named = holdings_of(t).filter(~F.col("person")).drop("person")
    return top(named, [F.desc("n"), F.asc("holder")], 50)


@query(f"""WITH {LICENCES_SQL}, s AS (SELECT n AS size, count(*) AS n FROM t WHERE NOT person GROUP BY 1)
SELECT size, n, CAST(sum(n) OVER (ORDER BY size) AS BIGINT) AS cum_holders,
       CAST(sum(n * size) OVER (ORDER BY size) AS BIGINT) AS cum_size FROM s""")
def lorenz_curve(t: Tables) -> DataFrame:
    """One point per distinct holding size."""
    return C.lorenz(holdings_of(t).filter(~F.col("person")), "n")


@query(f"""WITH {LICENCES_SQL}, r AS (SELECT n, row_number() OVER (ORDER BY n, holder) AS i,
  sum(n) OVER (ORDER BY n, holder ROWS UNBOUNDED PRECEDING) AS cum FROM t WHERE NOT person),
e AS (SELECT count(*) AS holders, sum(n) AS total FROM r),
g AS (SELECT sum(2 * cum - n) AS a FROM r)
SELECT holders, CAST(total AS DOUBLE) AS total, 1 - a / (holders * total) AS gini,
       (SELECT cum FROM r, e WHERE i = (holders + 1) // 2) / total AS half_share FROM e, g""")
def lorenz_gini(t: Tables) -> DataFrame:
    """Gini coefficient by trapezoids, and the share of the smaller half."""
    return C.gini(C.lorenz(holdings_of(t).filter(~F.col("person")), "n"))


@query(f"""WITH {LICENCES_SQL}, r AS (SELECT holder, n, row_number() OVER (ORDER BY n, holder) - 1 AS i, count(*) OVER () AS c
  FROM t WHERE NOT person)
SELECT holder, n FROM r WHERE i % greatest(1, c // 40) = 0 OR i = c - 1""")
def systematic_sample(t: Tables) -> DataFrame:
    """Every k-th holder in order of size, and the last one: the sampling operator of the charts."""
    named = holdings_of(t).filter(~F.col("person")).drop("person")
    return every_kth(named, [F.asc("n"), F.asc("holder")], 40)


# --- order ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60")
def top_k_ties(t: Tables) -> DataFrame:
    """Top k with the key as the last order, so that ties have one answer."""
    return top(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 60)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders WHERE o_orderstatus = 'F'
ORDER BY o_orderdate, o_orderkey LIMIT 12""")
def oldest_k(t: Tables) -> DataFrame:
    """The oldest twelve of the dated rows of one kind."""
    dated = equal_or_all(t.orders, "o_orderstatus", "F").filter(F.col("o_orderdate").isNotNull())
    return top(dated, [F.asc("o_orderdate"), F.asc("o_orderkey")], 12).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) - 1 AS place FROM orders""")
def ordinal_in_year(t: Tables) -> DataFrame:
    """Place of every licence within its year, for stacked dots."""
    thin = t.orders.select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("year"))
    return position(thin, ["year"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "place", start=0).drop("o_orderdate")
