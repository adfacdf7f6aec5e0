"""Hard negatives against a plain double loop, on ties, copies, several lengths, and in parts."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import hard_negatives as hn
from holdfast.llm.queries import QUERIES, SQL
from tests.oracle import compare, connect, folder


def plain(rows, every, positives=5, negatives=5, floor=80, ceiling=100):
    used = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (label, [float(np.float64(x)) for x in v])
            used[i] = min(used.get(i, row), row)
    used = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in used.items()}
    out = []
    for a, (label, v) in used.items():
        if a % every:
            continue
        scores = {i: max(-hn.EDGE, min(hn.EDGE, sum(x * y for x, y in zip(v, w)))) for i, (_, w) in used.items() if i != a and len(w) == len(v)}
        best = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in best if used[i][0] == label][:positives]:
            good = [i for i in best if used[i][0] != label and floor * scores[p] <= 100 * scores[i] <= ceiling * scores[p]]
            out += [(a, p, k + 1, i, scores[p], scores[i]) for k, i in enumerate(good[:negatives])]
    return sorted(out)


def mined(spark, rows, every, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("id", F.lit(1)).withColumn("key", F.lit("x"))  # further columns of names used within
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect())


def test_ties_copies_and_rows_that_take_no_part(spark):
    rng = random.Random(4)
    rows = [(k, [rng.randint(-2, 3) / 4 for _ in range(3)], rng.randint(0, 3)) for k in range(-20, 400)]
    rows += [(1000 + k, [0.5, 0.25, 0.75], 1) for k in range(300)]
    rows += [(5, [1.0, 1.0, 1.0], 0), (5, [1.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0), (2000, None, 0), (2005, [1.0, 1.0, 1.0], None),
             (2010, [1.0, None, 1.0], 0), (2015, [1.0, float("nan"), 0.0], 0), (2020, [float("inf"), 0.0, 0.0], 0),
             (2025, [1.0, 0.5], 0), (2026, [1.0, 0.5], 0), (2027, [1.0, 0.5], 1), (2030, [], 0), (2031, [], 0), (2032, [], 2)]
    assert mined(spark, rows, 5) == plain(rows, 5)
    assert mined(spark, rows, 5, anchors=30) == plain(rows, 5)
    assert mined(spark, rows, 25, positives=2, negatives=7, floor=50, ceiling=90) == plain(rows, 25, 2, 7, 50, 90)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 50)
    monkeypatch.setattr(hn, "SOME", 7)
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], rng.randint(0, 1)) for k in range(900)]
    assert mined(spark, rows, 9) == plain(rows, 9)


def test_huge_components(spark):
    rows = [(k, [1e300 if k % 2 else -1e7, 1.0], k % 3) for k in range(12)]
    assert mined(spark, rows, 2) == plain(rows, 2)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few(spark, n):
    rows = [(100 * k, [1.0], 0) for k in range(n)]
    assert mined(spark, rows, 100) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-2**63, 2**63 - 1)] * 2, st.integers(0, 1), st.integers(-2**63, 2**63 - 1)), max_size=20))
def test_keys(rows):
    a, s, k, i = (np.array(x, np.int64) for x in (zip(*rows) if rows else [()] * 4))
    keys = [key for n in range(len(rows)) for key in hn.packed(a[n:n + 1], s[n:n + 1], int(k[n]), i[n:n + 1]).to_pylist()]
    order = sorted(range(len(rows)), key=keys.__getitem__)
    assert [rows[n] for n in order] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    import pyarrow as pa
    assert list(zip(*hn.unpacked(pa.array(keys, pa.binary())))) == rows


def test_best_keeps_ties_to_the_smaller_id():
    rng = np.random.default_rng(3)
    best, every = hn.Best(4, 3), [[] for _ in range(4)]
    for _ in range(30):
        ids = np.sort(rng.choice(10**6, 20, replace=False))
        score = rng.integers(-3, 4, (2, 20))
        low = int(rng.integers(0, 3))
        best.offer(low, score, ids)
        for r in range(2):
            every[low + r] += [(-int(s), int(i)) for s, i in zip(score[r], ids)]
    for r in range(4):
        assert [(-int(s), int(i)) for s, i in zip(best.score[r], best.id[r])] == sorted(every[r])[:3]


def test_query(spark):
    assert compare(connect(folder()), QUERIES["op12_hard_negatives"](spark, folder()), SQL["op12_hard_negatives"]) is None
