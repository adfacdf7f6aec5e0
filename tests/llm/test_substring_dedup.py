"""Substring dedup against a brute-force version."""

import random

import pytest

from holdfast.llm import substring_dedup as S


def brute(rows, window):
    """(id, text) -> (n_words, n_removed, kept) of each row."""
    split = [(t or "").encode().split() for _, t in rows]
    order = [-2**63 if i is None else i for i, _ in rows]
    first = {}
    for i, words in zip(order, split):
        for k in range(len(words) - window + 1):
            x = tuple(words[k:k + window])
            first[x] = min(first.get(x, (2**63, 0)), (i, k))
    out = []
    for i, words in zip(order, split):
        gone = {k + j for k in range(len(words) - window + 1) if first[tuple(words[k:k + window])] < (i, k) for j in range(window)}
        out.append((len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 30))] for _ in range(8)]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < .6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 15))]
        rows.append((rng.randint(0, 400), rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [(5, None), (None, " ".join(passages[0] * 2)), (None, ""), (700, "x " * 500), (701, "x " * 30), (702, "é\x00 " * 25)]


@pytest.mark.parametrize(("seed", "common", "block", "window"), [(1, 20_000, 4 << 20, 5), (2, 2, 300, 5), (3, 20_000, 1, 8), (4, 2, 1, 5)])
def test_equals_brute_force(spark, monkeypatch, seed, common, block, window):
    monkeypatch.setattr(S, "COMMON", common)
    monkeypatch.setattr(S, "COMMON_IN_TASK", 1 if common == 2 else 16)
    monkeypatch.setattr(S, "BLOCK", block)
    rows = corpus(seed)
    rows += rows[:4]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string").repartition(7)
    got = S.deduplicated(df, keep=["doc_id", "kept"], window=window, seed=3).collect()
    want = [(i, *x) for (i, _), x in zip(rows, brute(rows, window))]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_stream_of_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = corpus(9, 60)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
        got = S.deduplicated(df, keep=["doc_id"], window=6, seed=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *x)) for (i, _), x in zip(rows, brute(rows, 6)))


def test_empty(spark):
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
