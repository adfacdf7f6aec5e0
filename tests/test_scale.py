"""What must hold when one key has a third of the rows: same results, spread work."""

import math
import random

import pytest
from pyspark.sql import functions as F

from holdfast import scale
from holdfast.operators import bands as B
from holdfast.operators import ordering as O
from holdfast.operators import pairing as P


@pytest.fixture
def eager_salting(monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 0)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed(spark):
    """30,000 rows, a third of them key 7 and many of those exact copies; some keys NULL."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 101)
    return spark.range(30000).select(key.alias("k"), (F.col("id") % 4).alias("v"))


def test_the_sketch_finds_the_hot_key(spark, skewed, eager_salting):
    want = spark.range(1).select(F.xxhash64(F.lit(7).cast("long"))).first()[0]
    found = scale.hot_hashes(skewed, ["k"])
    assert found[want] == max(found.values()) > 10 * sorted(found.values())[-2]
    assert list(scale.hot_hashes(skewed, ["k"], 0.2)) == [want]
    assert len(scale.hot_hashes(spark.range(30000).withColumnRenamed("id", "k"), ["k"])) <= scale.HOT_KEYS


def test_few_rows_are_never_hot(skewed):
    assert scale.hot_hashes(skewed, ["k"]) == {}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salting_changes_no_result(spark, skewed, eager_salting, how):
    dim = spark.range(0, 101, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("d"))
    dim = dim.union(spark.createDataFrame([(7, 70), (7, 71)], "k long, d long"))
    assert rows(scale.skew_join(skewed, dim, "k", how)) == rows(skewed.join(dim, "k", how))


def test_hot_rows_reach_many_tasks(spark, skewed, eager_salting):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dim = spark.createDataFrame([(7, 1)], "k long, d long")
        joined = scale.skew_join(skewed.repartition(16), dim, "k")
        per_task = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total = sum(r["count"] for r in per_task)
    assert len(per_task) >= 6 and max(r["count"] for r in per_task) < total / 2


def test_condition_is_part_of_the_join(spark, skewed, eager_salting):
    dim = spark.createDataFrame([(7, 1, 3), (9, 0, 2)], "k long, lo long, hi long")
    inside = (F.col("lo") <= F.col("v")) & (F.col("v") < F.col("hi"))
    got = scale.skew_join(skewed, dim, "k", "left", condition=inside).groupBy("k", "v", "lo").count()
    other = dim.withColumnRenamed("k", "q")
    want = skewed.join(other, (F.col("k") == F.col("q")) & inside, "left").groupBy("k", "v", "lo").count()
    assert rows(got) == rows(want)


def test_checkpoint_folder_is_the_session_s(spark):
    folder = scale.checkpoint_folder(spark)
    assert folder == spark.sparkContext.getCheckpointDir()
    kept = scale.durable(spark.range(10))
    assert kept.count() == 10
    assert folder.removeprefix("file:") in kept.inputFiles()[0]


def test_bounded_rows(spark):
    assert scale.bounded_rows(spark.range(10), 10) == 10
    assert scale.bounded_rows(spark.range(11), 10) is None


@pytest.mark.parametrize("group", [[], ["g"], ["g", "h"]])
def test_slices_give_the_window_s_running_sums(spark, group):
    rng = random.Random(5)
    data = [(None if i % 17 == 0 else ("hot" if i % 3 else f"g{i % 5}"), i % 2, rng.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, h int, x int, id int").repartition(7)
    order = [F.col("x").desc(), F.col("id").asc()]
    sums = {"n": F.lit(1), "s": F.col("x")}
    whole = O.running(df, group, order, sums)
    sliced = O.running(df, group, order, sums, rows_per_task=150)
    assert rows(sliced) == rows(whole)


def test_positions_and_samples_in_slices(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("x")).repartition(5)
    order = [F.asc("x"), F.asc("id")]
    got = O.position(df, [], order, start=0, rows_per_task=100).orderBy("position").collect()
    want = sorted(((i % 10, i) for i in range(1000)))
    assert [(r["x"], r["id"]) for r in got] == want and [r["position"] for r in got] == list(range(1000))
    sample = O.every_kth(df, order, 30, rows_per_task=100).collect()
    assert sorted((r["x"], r["id"]) for r in sample) == sorted({*want[::33], want[-1]})


def test_pairing_of_a_hot_group(spark):
    rng = random.Random(2)
    data = [("hot" if i % 3 == 0 else f"g{i % 40}", rng.random() < 0.4, float(rng.randrange(500))) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, t boolean, v double")
    whole = P.ordinal_pairs(df, ["g"], "v", F.col("t"))
    sliced = P.ordinal_pairs(df, ["g"], "v", F.col("t"), rows_per_task=200)
    want = []
    for g in {d[0] for d in data}:
        a = sorted(v for k, t, v in data if k == g and t)
        b = sorted(v for k, t, v in data if k == g and not t)
        want += [(g, i + 1, x, y) for i, (x, y) in enumerate(zip(a, b))]
    assert rows(whole) == rows(sliced) == sorted(want, key=repr)


def test_pairs_skip_equal_values_and_one_sided_groups(spark):
    df = spark.createDataFrame([("a", True, 1e6), ("a", True, 3e6), ("a", False, 1e6), ("b", True, 2e6),
                                ("c", True, 11.245e9), ("c", False, 10.755e9), ("c", False, None)], "g string, t boolean, v double")
    found = P.gaps(P.ordinal_pairs(df, ["g"], "v", F.col("t")))
    assert rows(found.select("g", "gap")) == [("c", 490.0)]
    assert rows(P.top_pairs(found)) == [(10755.0, 11245.0, 1)]
    assert rows(P.pairing_totals(df, found, ["g"])) == [("groups", 3), ("paired_groups", 1)]


def test_shares_of_a_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0)], "g string, v int")
    assert rows(O.share_of_group(df, ["g"], "v").select("g", "v", "share")) == [("a", 1, 0.25), ("a", 3, 0.75), ("b", 0, None)]


def test_top_per_group_beyond_the_limit(spark):
    df = spark.range(12_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = O.top_per_group(df, ["g"], [F.desc("v")], 5000)
    assert got.groupBy("g").agg(F.count("v"), F.min("v"), F.max("rank")).orderBy("g").collect() == [(0, 5000, 2000, 5000), (1, 5000, 2001, 5000)]


# --- bands -----------------------------------------------------------------------------------

TABLE = B.Bands(((0.0, 400e6, "below"), (400e6, 430e6, "land"), (430e6, 450e6, "amateur"), (450e6, 520e6, "business"),
                 (3.4e9, 3.7e9, "mid"), (1e12, None, "light")))


def test_band_table_is_checked():
    assert not TABLE.contiguous
    assert B.Bands(((0.0, 1.0, "a"), (1.0, None, "b"))).contiguous
    for bad in [((0.0, 2.0, "a"), (1.0, 3.0, "b")), ((0.0, None, "a"), (1.0, 2.0, "b")), ((1.0, 1.0, "a"),)]:
        with pytest.raises(ValueError):
            B.Bands(bad)


# Each limit, just below it, and what is in no band.
_LIMITS = [x for lo, hi, _ in TABLE.rows for x in (lo, hi) if x]
VALUES = [(x, next((i for i, (lo, hi, _) in enumerate(TABLE.rows) if lo <= x and (hi is None or x < hi)), None))
          for limit in _LIMITS for x in (limit, math.nextafter(limit, 0.0))]
VALUES += [(v, None) for v in (None, float("nan"), -0.0, -5e8)] + [(float("inf"), len(TABLE.rows) - 1)]


def test_band_of_a_value(spark):
    df = spark.createDataFrame(VALUES, "x double, want int")
    got = df.withColumn("band", TABLE.index(F.col("x")))
    assert all(r["band"] == r["want"] for r in got.collect())
    kept = TABLE.assign(df, "x")
    assert rows(kept.select("x", "band")) == sorted([(x, b) for x, b in VALUES if b is not None], key=repr)


@pytest.mark.parametrize("hot", [False, True])
def test_range_join_agrees_with_the_tree(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(scale, "HOT_ROWS", 0)
    rng = random.Random(11)
    data = [(i, 10 ** rng.uniform(-2, 14)) for i in range(2000)] + [(i, 451e6) for i in range(2000, 3000)]
    data += [(5000, None), (5001, float("nan")), (5002, 0.0), (5003, -1.0)]
    df = spark.createDataFrame(data, "id int, x double")
    for low, high in ((1.0, 1e12), (1e6, 1e9)):
        joined = B.range_join(df, "x", TABLE.frame(spark), low=low, high=high)
        assert rows(joined.select("id", "band")) == rows(df.select("id", TABLE.index(F.col("x")).alias("band")))
    inner = B.range_join(df, "x", TABLE.frame(spark), how="inner")
    assert rows(inner.select("id", "band")) == rows(df.select("id", TABLE.index(F.col("x")).alias("band")).filter("band is not null"))


def test_overlapping_intervals_are_all_found(spark):
    iv = spark.createDataFrame([(1, 1.0, 100.0), (2, 50.0, None), (3, 50.0, 50.5)], "i int, lo double, hi double")
    df = spark.createDataFrame([(0.5,), (50.0,), (100.0,), (1e15,)], "x double")
    assert rows(B.range_join(df, "x", iv, how="inner").select("x", "i")) == [(100.0, 2), (1e15, 2), (50.0, 1), (50.0, 2), (50.0, 3)]


@pytest.mark.parametrize("few", [True, False])
def test_range_join_against_every_pair(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(B, "BROADCAST_ROWS", 3)
    rng = random.Random(5)
    iv = [(k, lo, lo + 10 ** rng.uniform(-3, 4)) for k, lo in enumerate(rng.uniform(-50, 9000) for _ in range(150))]
    iv += [(500, 200.0, None), (501, 20000.0, 20001.0), (502, 20001.0, 20002.0), (503, 5.0, 5.0), (504, 9.0, 2.0), (505, None, 4.0)]
    iv = [i for i in iv if few or i[2] is not None or i[0] != 500]  # without an open one what comes last is open
    values = [rng.uniform(0, 21000) for _ in range(300)] + [20000.0, 20001.0, 20002.0, 5.0, float("inf"), 1e300, 1e-300, None, float("nan"), 0.0, -3.0]
    values += [v for _, lo, hi in iv for v in (lo, hi) if v is not None][:100]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, x double")
    table = spark.createDataFrame(iv, "i int, lo double, hi double")
    want = []
    for k, v in enumerate(values):
        hits = [i for i, lo, hi in iv if lo is not None and v is not None and v > 0 and lo <= v and (hi is None or v < hi)]
        want += [(k, i) for i in hits or [None]]
    assert rows(B.range_join(df, "x", table).select("id", "i")) == sorted(want, key=repr)
    assert rows(B.range_join(df, "x", table, how="inner").select("id", "i")) == sorted([w for w in want if w[1] is not None], key=repr)


def test_a_million_narrow_intervals_give_few_candidates(spark):
    """All in one decade, a tenth of them overlapping others: a fact meets a constant number of them."""
    n = 1_000_000
    iv = spark.range(n).select((1e6 + F.col("id") * 5.0).alias("lo"), (1e6 + F.col("id") * 5.0 + F.when(F.col("id") % 10 == 0, 8.0).otherwise(5.0)).alias("hi"))
    facts = spark.range(2000).select((1e6 + F.col("id") * 2499.25).alias("x"))
    keyed, listed, small = B.cells_of(facts, "x", iv, "lo", "hi", "left", 1.0, 1e12, 24)
    assert not small
    per = keyed.join(listed, ["_level", "_cell"]).groupBy("x").count().agg(F.max("count"), F.count("x")).first()
    assert per[0] <= 10 and per[1] == 2000
    assert B.range_join(facts, "x", iv).count() == sum(2 if int(k * 2499.25 // 5) % 10 == 1 and k * 2499.25 % 5 < 3 else 1 for k in range(2000))


def test_band_rollup_counts_each_thing_once(spark):
    devices = spark.createDataFrame(
        [("L1", "s", 401e6, "T"), ("L1", "s", 401e6, "T"), ("L1", None, 401e6, "T"), ("L2", "s", 402e6, "R"), ("L3", "s", 451e6, "T")],
        "lic string, site string, v double, d string").withColumn("tx", F.col("d") == "T")
    licences = spark.createDataFrame([("L1", "A", False), ("L2", "A", False), ("L3", "B", True)], "lic string, root string, person boolean")
    held = B.holder_bands(TABLE.assign(devices, "v"), licences, band="band", licence="lic", holder=["root", "person"],
                          key=["lic", "site", "v", "d"], transmit="tx")
    rolled = {r["band"]: (r["rows"], r["tx"], r["assignments"], r["licences"], r["holders"]) for r in B.band_rollup(held, "band").collect()}
    assert rolled == {1: (4, 3, 3, 2, 1), 3: (1, 1, 1, 1, 1)}


