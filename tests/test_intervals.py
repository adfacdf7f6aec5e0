"""Unions of intervals against a sweep in plain Python."""

import random

import pytest

from holdfast.operators import intervals as I
from holdfast.operators import ordering as O
from pyspark.sql import functions as F


def swept(rows):
    out, by = [], {}
    for g, lo, hi in rows:
        if lo is not None and hi is not None and lo < hi:  # a NaN is in no order
            by.setdefault(g, []).append((lo, hi))
    for g, mine in by.items():
        stretch = None
        for lo, hi in sorted(mine):
            if stretch and lo <= stretch[1]:
                stretch[1], stretch[2] = max(stretch[1], hi), stretch[2] + 1
            else:
                stretch = [lo, hi, 1]
                out.append((g, stretch))
    return sorted(((g, *s) for g, s in out), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    made = []
    for k in range(3000):
        group = None if k % 50 == 0 else 7 if k % 3 == 0 else rng.randint(0, 20)  # 7 holds a third
        lo = float(rng.randint(0, 4000))
        made.append((group, lo, lo + rng.choice([0, 1, 1, 2, 5, 40])))
    made += [(7, 1.0, 3900.0), (8, 5.0, None), (8, None, 5.0), (9, 5.0, 3.0), (9, float("nan"), 3.0), (9, 3.0, float("nan"))] + [(7, 10.0, 11.0)] * 200
    return made


@pytest.mark.parametrize("rows_per_task", [10**6, 40])
def test_islands(spark, rows, rows_per_task):
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(5)
    got = sorted((tuple(r) for r in I.islands(df, ["g"], "a", "b", rows_per_task).collect()), key=repr)
    assert got == swept(rows)


@pytest.mark.parametrize("rows_per_task", [10**6, 25])
def test_one_group_of_many_stretches_is_cut(spark, rows_per_task):
    rows = [(1, float(k), k + 0.5 + (k % 7 == 0) * 3) for k in range(500)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = sorted((tuple(r) for r in I.islands(df, ["g"], "a", "b", rows_per_task).collect()), key=repr)
    assert got == swept(rows) and len(got) > 200


def test_width(spark, rows):
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {r["g"]: (r["blocks"], r["summed"], r["width"], r["stretches"]) for r in I.union_width(df, ["g"], "a", "b").collect()}
    want, real = {}, [r for r in rows if r[1] is not None and r[2] is not None and r[1] < r[2]]
    for g in {r[0] for r in real}:
        mine = [s for s in swept(real) if s[0] == g]
        want[g] = (sum(s[3] for s in mine), sum(b - a for x, a, b in real if x == g), sum(s[2] - s[1] for s in mine), len(mine))
    assert got == want


def test_no_interval(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0)], "g int, a double, b double")
    assert I.islands(df, ["g"], "a", "b").collect() == [] and I.union_width(df, ["g"], "a", "b").collect() == []


@pytest.mark.parametrize("rows_per_task", [10**6, 3])
def test_gaps(spark, rows_per_task):
    df = spark.createDataFrame([(float(10 * k), 10.0 * k + 4) for k in range(20)], "lo double, hi double")
    got = {(r["lo"], r["hi"]) for r in I.gaps(df, rows_per_task=rows_per_task).collect()}
    assert got == {(None, 0.0), (194.0, None)} | {(10.0 * k + 4, 10.0 * (k + 1)) for k in range(19)}


@pytest.mark.parametrize("before", [False, True])
def test_running_max_passes_over_nulls(spark, before):
    rng = random.Random(1)
    rows = [(k % 4 if k % 9 else None, k, rng.choice([None, rng.randint(0, 1000)])) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, v int")
    for size in (10**6, 20):
        got = {r["k"]: r["m"] for r in O.running_max(df, ["g"], [F.col("k")], {"m": F.col("v")}, size, before).collect()}
        for g, k, _ in rows:
            seen = [v for h, j, v in rows if h == g and v is not None and (j < k or j == k and not before)]
            assert got[k] == max(seen, default=None)
