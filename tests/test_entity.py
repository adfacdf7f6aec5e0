"""Merging, naming, classes, suppression."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast import scale
from holdfast import scale
from holdfast.functions.identifiers import valid_abn
from holdfast.functions.text import name_key, whole_words
from holdfast.operators import concentration as C
from holdfast.operators import entity as E
from holdfast.operators import rollups as R
from holdfast.operators import tenancy as N
from holdfast.sources.dictionary import read_dictionary
from tests.test_functions import business_number

# Two names that share a valid number, the second name again with another number, an invalid number
# on two others, names alike up to a suffix, and records without any key.
NUMBER, OTHER, INVALID = business_number(3), business_number(4), business_number(5)[:-1] + "x"
CLIENTS = [("p1", "Fernquay Freight", NUMBER), ("p2", "Quill Depot", NUMBER), ("p3", "QUILL  DEPOT", OTHER), ("p4", "Tarn Signals", OTHER),
           ("q1", "Marl Ltd", INVALID), ("q2", "Loam Ltd", INVALID), ("r1", "Ida Inc", None), ("r2", "Ida Incorporated", None),
           ("r3", "Ida Pty", None), ("s1", " ", None), ("s2", None, " ")]


def roots(df):
    return {r[0]: r[1] for r in df.collect()}


def brute(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def merge(spark, clients, partitions=3):
    df = spark.createDataFrame(clients, "id string, name string, abn string").repartition(partitions)
    key = name_key(F.col("name"))
    return E.components(df, "id", [F.when(key != "", key), F.when(valid_abn(F.col("abn")), F.col("abn"))])


def test_records_merge_by_name_or_valid_identifier_and_on(spark):
    got = roots(merge(spark, CLIENTS))
    assert got == {**{f"p{k}": "p1" for k in range(1, 5)}, "q1": "q1", "q2": "q2", "r1": "r1", "r2": "r1", "r3": "r3", "s1": "s1", "s2": "s2"}


def test_merge_does_not_depend_on_order_or_partitions(spark):
    shuffled = CLIENTS[:]
    random.Random(4).shuffle(shuffled)
    assert roots(merge(spark, shuffled, 1)) == roots(merge(spark, CLIENTS, 7))


def by_pairs(spark, pairs, nodes):
    """Records whose two keys make a chain: record i carries both ends of pair i."""
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, a long, b long")
    found = roots(E.components(df, "id", [F.col("a"), F.col("b")]))
    first = {}
    edges = []
    for i, (a, b) in enumerate(pairs):
        for kind, key in ((0, a), (1, b)):
            if key is not None:
                edges.append((first.setdefault((kind, key), i), i))
    assert found == brute(edges, range(len(pairs)))


def test_a_long_chain_settles(spark):
    pairs = [((i + 1) // 2, i // 2) for i in range(300)]
    random.Random(1).shuffle(pairs)
    by_pairs(spark, pairs, 300)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.integers(0, 12))), min_size=1, max_size=30))
def test_random_keys(spark, pairs):
    by_pairs(spark, pairs, len(pairs))


def test_a_hot_key_with_salting(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 0)
    rng = random.Random(9)
    by_pairs(spark, [(0 if i % 3 == 0 else rng.randrange(200), rng.randrange(300)) for i in range(900)], 900)


def test_no_record_has_a_key(spark):
    by_pairs(spark, [(None, None), (None, None)], 2)


def test_one_flagged_record_flags_the_entity(spark):
    records = spark.createDataFrame(
        [("1", "r", "Small Name", "6", False, 2), ("2", "r", "Big Name", "7", True, 9), ("3", "s", "B", "6", False, 1),
         ("4", "s", "A", "6", False, 1)], "id string, root string, name string, type string, person boolean, lic long")
    got = {r["root"]: r for r in E.entities(records, id="id", root="root", name="name", type="type", person="person", licences="lic").collect()}
    assert (got["r"]["name"], got["r"]["records"], got["r"]["types"], got["r"]["person"], got["r"]["licences"]) == ("Big Name", 2, 2, True, 11)
    assert (got["s"]["name"], got["s"]["types"], got["s"]["person"]) == ("B", 1, False)


def test_person_flag(spark):
    """The type alone decides, or all of: no company number, few licences, a personal name."""
    cases = [(t, acn, lic, name) for t in ("own", "firm", None) for acn in ("c", None) for lic in (0, 5, 6) for name in ("Ida Quill", "Quill Depot", None)]
    want = [t == "own" or (acn is None and lic <= 5 and name == "Ida Quill") for t, acn, lic, name in cases]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, acn string, lic int, name string")
    flag = E.person_flag(F.col("t") == "own", F.col("acn").isNotNull(), F.col("lic"), name_key(F.col("name")), ["DEPOT"])
    assert [r[1] for r in df.select("k", flag).orderBy("k").collect()] == want


def test_classes(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"WIDE NET CO LIMITED": "TELCO",\n "POLICE BAND": "MUSIC"}')
    listed = read_dictionary(spark, str(tmp_path / "d.json"))
    assert read_dictionary(spark, str(tmp_path / "none.json")).count() == 0
    rules = [(whole_words(["POLICE"]), "SAFETY"), (whole_words(["MINING", "COAL"]), "MINING")]
    df = spark.createDataFrame([("WIDE NET CO LIMITED", False), ("POLICE BAND", False), ("COAL POLICE", False), ("NORTH COAL", False),
                                ("COALITION", False), ("WIDE NET CO LIMITED", True)], "key string, person boolean")
    got = [r["class"] for r in E.classify(df, "key", "person", listed, rules).orderBy("person", "key").collect()]
    assert sorted(got) == sorted(["TELCO", "MUSIC", "SAFETY", "MINING", "UNCLASSIFIED", "INDIVIDUAL"])


def test_ids_are_dense_and_withheld_ones_are_minus_one(spark):
    ents = spark.createDataFrame([("x", 3, False), ("y", 9, False), ("z", 3, True), ("w", 3, False)], "root string, n long, person boolean")
    for limit in (None, 1):
        ids = E.dense_ids(ents, "n", "root", "person", rows_per_task=limit)
        assert roots(ids) == {"y": 0, "w": 1, "x": 2}
    refs = spark.createDataFrame([("z",), ("w",), ("unknown",)], "root string")
    assert roots(E.resolve_ids(refs, "root", ids, "root")) == {"z": -1, "w": 1, "unknown": -1}


def test_person_only_sites_are_withheld(spark):
    devices = spark.createDataFrame([("home", "L1"), ("home", "L2"), ("tower", "L1"), ("tower", "L3"), ("old", "L4"), (None, "L3")],
                                    "site string, lic string").withColumn("tx", F.lit(True))
    licences = spark.createDataFrame([("L1", "P", "I", True, True), ("L2", "P", "I", True, False), ("L3", "O", "T", False, True),
                                      ("L4", "O", "T", False, False)], "lic string, root string, cls string, person boolean, granted boolean")
    tenants = R.site_holders(devices, licences, site="site", licence="lic", holder="root", cls="cls", person="person", granted="granted", transmit="tx")
    got = {r["site"]: (r["devices"], r["licences"], r["holders"], r["person_only"], r["publishable"]) for r in R.site_rollup(tenants, "site").collect()}
    assert got == {"home": (2, 2, 1, True, False), "tower": (2, 2, 2, False, True), "old": (1, 1, 1, False, False)}


def test_pairs_under_both_readings(spark):
    tenants = spark.createDataFrame([("s", "1", "A"), ("s", "2", "A"), ("s", "3", "B"), ("t", "1", "A"), ("u", "3", "B"), ("u", "4", "C")],
                                    "site string, holder string, class string")
    classes = tenants.select("class").distinct()
    got = {(r["a"], r["b"]): (r["sites"], r["same_class_sites"]) for r in N.class_pairs(tenants, "site", classes).collect()}
    assert got == {("A", "A"): (2, 1), ("A", "B"): (1, 1), ("B", "B"): (2, 0), ("B", "C"): (1, 1), ("C", "C"): (1, 0)}
    assert roots(N.pair_totals(N.class_pairs(tenants, "site", classes))) == {"A": 3, "B": 4, "C": 2}


@pytest.mark.parametrize("n", [62, 70])
def test_pairs_of_many_classes(spark, n):
    rng = random.Random(n)
    rows = [(f"s{k % 9}", f"h{k}", f"c{rng.randrange(n):03}") for k in range(400)]
    tenants = spark.createDataFrame(rows, "site string, holder string, class string")
    classes = spark.createDataFrame([(f"c{k:03}",) for k in range(n)], "class string")
    want = {}
    for site in {s for s, _, _ in rows}:
        count = {}
        for s, _, c in rows:
            if s == site:
                count[c] = count.get(c, 0) + 1
        for a in count:
            for b in count:
                if a <= b:
                    x, y = want.get((a, b), (0, 0))
                    want[a, b] = x + 1, y + (a != b or count[a] > 1)
    got = {(r["a"], r["b"]): (r["sites"], r["same_class_sites"]) for r in N.class_pairs(tenants, "site", classes).collect()}
    assert got == want


def test_matrix_of_many_columns(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("r"), (F.col("id") % 1500).alias("c"))
    rows = spark.createDataFrame([(0,), (1,), (2,)], "r long")
    got = R.matrix(df, "r", "c", rows, df.select("c"))
    assert got.count() == 4500 and got.agg(F.sum("licences"), F.count_if(F.col("licences") == 0)).first()[:] == (3000, 3000)


@pytest.mark.parametrize("sizes", [[1, 1, 1, 1], [1, 2, 3, 10, 10, 50], [5]])
def test_gini_and_half_share(spark, sizes):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "h int, n long")
    row = C.gini(C.lorenz(df, "n", rows_per_task=2)).first()
    ordered, total, cum, area, points = sorted(sizes), sum(sizes), 0, 0.0, [(0.0, 0.0)]
    for i, s in enumerate(ordered):
        cum += s
        points.append(((i + 1) / len(sizes), cum / total))
    for (a, b), (c, d) in zip(points, points[1:]):
        area += (b + d) / 2 * (c - a)
    assert row["gini"] == pytest.approx(1 - 2 * area, abs=1e-12)
    assert row["half_share"] == pytest.approx(points[len(points) // 2][1])


def test_headline(spark):
    df = spark.createDataFrame([(s, i == 0) for i, s in enumerate([40, 20, 1, 1, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 3])], "n long, person boolean")
    got = roots(C.headline(df, "n", "person"))
    named = [20, 1, 1, 5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 3]
    assert got["total"] == 115 and got["largest"] == 20 and got["single_named"] == got["single_all"] == 2
    assert got["top10_share"] == pytest.approx(round(65 / 115 * 100, 2))
    assert got["hhi"] == int(sum((n / 115 * 100) ** 2 for n in named) + 0.5)


def test_totals_of_holders_from_one_join(spark):
    """Rows without a site count as devices and not as sites; licences nobody lists are left out."""
    devices = spark.createDataFrame(
        [("l1", "a", True), ("l1", "a", False), ("l1", None, True), ("l2", "a", True), ("l2", "b", False), ("l3", "c", True), (None, "d", True), ("l9", "e", True)],
        "licence string, site string, tx boolean")
    owners = spark.createDataFrame([("l1", 1), ("l2", 1), ("l3", 2), ("l4", 3), ("l5", None)], "licence string, k int")
    entities = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    got = R.holder_totals(entities, devices, owners, key="k", licence="licence", site="site", transmit="tx")
    assert {r["k"]: (r["devices"], r["tx"], r["sites"]) for r in got.collect()} == {1: (5, 3, 2), 2: (1, 1, 1), 3: (0, 0, 0)}
    alone = R.holder_totals(entities.filter("k = 2"), devices, owners.filter("k = 2"), key="k", licence="licence", site="site", transmit="tx")
    assert [tuple(r) for r in alone.collect()] == [(2, 1, 1, 1)]


@pytest.mark.parametrize("hot", [False, True])
def test_sites_are_dealt_in_bounded_tasks(spark, monkeypatch, hot):
    """No task aggregates more than its share of the rows, and rows of hot keys give the same sites."""
    monkeypatch.setattr(scale, "TASK_ROWS", 200)
    monkeypatch.setattr(scale, "HOT_ROWS", 0 if hot else scale.HOT_ROWS)
    devices = spark.range(8000).select((F.col("id") % 4000).alias("site"), (F.col("id") % 700).alias("lic"), (F.col("id") % 3 == 0).alias("tx"))
    licences = spark.range(700).select(F.col("id").alias("lic"), (F.col("id") % 50).alias("root"), F.lit("T").alias("cls"),
                                       (F.col("id") % 2 == 0).alias("person"), F.lit(True).alias("granted"))
    tenants = R.site_holders(devices, licences, site="site", licence="lic", holder="root", cls="cls", person="person", granted="granted", transmit="tx")
    sites = R.site_rollup(tenants, "site")
    assert sites.agg(F.count("site"), F.sum("devices"), F.sum("licences"), F.sum("tx")).first()[:] == (4000, 8000, 8000, 2667)
    largest = sites.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert hot or largest <= 300
