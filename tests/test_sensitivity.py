"""Gates under wrong inputs: who notices, who reads, and who never would."""

from pyspark.sql import functions as F

from holdfast.operators import checks as Q
from holdfast.operators import geo as G


def report(spark, plants):
    a = spark.createDataFrame([(k, k % 5) for k in range(20)], "k int, v int")
    b = spark.createDataFrame([(k,) for k in range(20)], "k int")
    made = []

    def lost(t):
        made.append("lost")
        return t["a"].join(t["b"], "k", "left_anti")

    out = Q.sensitivity(
        {"a": a, "b": b, "unread": b}, {"lost": lost, "values": lambda t: t["a"], "keys": lambda t: t["b"]},
        [Q.equals("no key is lost", "lost", Q.rows(), 0), Q.equals("rows pinned", "values", Q.rows(), 20),
         Q.in_range("a share", "values", Q.share_of(F.col("v") > 2), 0, 1), Q.equals("fails anyway", "keys", Q.rows(), 3)], plants)
    return {(r["check_id"], r["plant"]): (r["passes"], r["failed"], r["blind"]) for r in out.collect()}, made


def test_only_gates_that_read_it_run_again(spark):
    got, made = report(spark, [Q.Plant("shifted", "a", lambda df: df.withColumn("k", F.col("k") + 1)),
                               Q.Plant("dropped", "a", lambda df: df.filter("k <> 3")),
                               Q.Plant("nobody's", "unread", lambda df: df.limit(0))])
    assert got == {
        ("no key is lost", "shifted"): (True, True, False), ("no key is lost", "dropped"): (True, False, False),
        ("rows pinned", "shifted"): (True, False, False), ("rows pinned", "dropped"): (True, True, False),
        ("a share", "shifted"): (True, False, True), ("a share", "dropped"): (True, False, True),
        ("fails anyway", None): (False, False, True)}
    assert len(made) == 3


def test_a_gate_that_fails_anyway_proves_nothing(spark):
    got, _ = report(spark, [Q.Plant("emptied", "b", lambda df: df.limit(0))])
    assert got[("fails anyway", "emptied")] == (False, False, True)
    assert got[("no key is lost", "emptied")] == (True, True, False)


def test_without_plants_every_gate_is_blind(spark):
    got, _ = report(spark, [])
    assert len(got) == 4 and all(blind and not failed for _, failed, blind in got.values())


def test_coarsened_rings(spark):
    ring = [[0.2, 0.1], [0.3, 0.1], [4.1, 0.3], [4.4, 3.9], [4.4, 3.8], [-0.4, 4.2], [0.2, 0.1]]
    df = spark.createDataFrame([(1, 5, [ring])], "feature int, part long, rings array<array<array<double>>>")
    (row,) = G.coarsened(df, 1.0).collect()
    assert row["rings"] == [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]
