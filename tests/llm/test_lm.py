"""The language model against one of dictionaries, both ways of looking up words, and odd rows."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import lm
from holdfast.llm.eliasfano import EliasFano

TRAIN = ["the cat sat on the mat", "The cat sat", "the dog sat on the mat again", "a cat", None, "", "the cat sat on a mat"] * 3
TEST = ["the cat sat on the log", "", None, "zebra", "the the the", "a cat sat on the mat\nthe cat", "Ünknown cat sat"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=60).map(sorted), st.lists(st.integers(0, 600), max_size=30))
def test_elias_fano(values, asked):
    seq = EliasFano(np.array(values, np.int64), 501)
    assert seq[np.arange(len(values))].tolist() == values
    assert seq.index(np.array(asked, np.int64)).tolist() == [values.index(x) if x in values else -1 for x in asked]


def plain(train, test, least=2):
    """Base and back-off scores, word by word."""
    tokens = [(t or "").lower().split() + [None] for t in train]
    c1 = Counter(w for t in tokens for w in t)
    c2 = Counter(p for t in tokens for p in zip([None, *t], t))
    c2 = {p: n for p, n in c2.items() if n >= least}
    c3 = Counter((a, b, c) for t in tokens for a, b, c in zip([None, *t], t, t[1:]) if (a, b) in c2 and (b, c) in c2)
    c3 = {p: n for p, n in c3.items() if n >= least}
    total, size = c1.total(), len(c1)

    def p1(w):
        return (c1[w] + .5) / (total + .5 * (size + 1))

    def p2(a, w):
        if (a, w) in c2:
            return (c2[a, w] - lm.DISCOUNT) / c1[a]
        if a not in c1:
            return p1(w)
        kept = [b for x, b in c2 if x == a]
        return p1(w) * (1 - sum((c2[a, b] - lm.DISCOUNT) / c1[a] for b in kept)) / (1 - sum(map(p1, kept)))

    def p3(a, b, w):
        if (a, b, w) in c3:
            return (c3[a, b, w] - lm.DISCOUNT) / c2[a, b]
        if (a, b) not in c2:
            return p2(b, w)
        kept = [c for x, y, c in c3 if (x, y) == (a, b)]
        return p2(b, w) * (1 - sum((c3[a, b, c] - lm.DISCOUNT) / c2[a, b] for c in kept)) / (1 - sum(p2(b, c) for c in kept))
    out = []
    for t in test:
        t = (t or "").lower().split() + [None]
        logs = [math.log10(p2(None, t[0]) if k == 0 else p3(([None, *t])[k - 1], t[k - 1], w)) for k, w in enumerate(t)]
        out.append((len(t), sum(c1[w] > 0 for w in t), total, sum(math.log10(p1(w)) for w in t), sum(logs)))
    return out


@pytest.mark.parametrize(("known", "words"), [(1000, 1000), (3, 1000), (1000, 0), (3, 0)])
def test_scores(spark, known, words):
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3)
    test = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEST)], "doc_id long, text string, n_known string")
    model = lm.fit(train, known=known, words=words)
    got = [tuple(r)[1:] for r in sorted(lm.scored(test, model, ["doc_id", "n_known"]).collect(), key=lambda r: r["doc_id"])]
    want = plain(TRAIN, TEST)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-9
        if known == 1000:
            assert abs(g[4] - w[4]) < 1e-4, (g, w)
    assert lm.scored(test.limit(0), model, ["doc_id"]).count() == 0


def test_nothing_learnt(spark):
    empty = spark.createDataFrame([], "text string")
    out = lm.scored(spark.createDataFrame([("a b",)], "text string"), lm.fit(empty), []).first()
    assert (out["n_tokens"], out["n_known"], out["train_tokens"]) == (3, 0, 0) and out["score"] == out["base_score"]


def test_probabilities_add_up():
    words = np.sort(np.random.default_rng(0).integers(0, 2**62, 6)).astype(np.uint64)
    counts = np.array([50, 40, 30, 20, 10, 5])
    base = np.log10((counts + .5) / (155 + .5 * 7))
    pairs = np.array([1, 2, 6, 8, 13]), np.array([9, 4, 7, 3, 12])
    triples = np.array([0 * 6 + 2, 2 * 6 + 1, 3 * 6 + 1]), np.array([3, 5, 2])
    trie = lm.build(words, counts, base, 5, pairs, triples)
    for context in ((0, 1), (1, 0), (1, 2), (4, 4)):
        total = sum(10 ** trie.logs(np.array([*context, w]), np.zeros(2))[-1] for w in range(6))
        assert abs(total + 0.5 / 158.5 * 10 ** float(trie.logs(np.array([*context, -1]), np.zeros(2))[-1]) - 1) < 1e-4


def test_large_counts(spark):
    model = lm.fit(spark.createDataFrame([("many " * 1000 + "one",)], "text string"), known=1)
    out = lm.scored(spark.createDataFrame([("one many other",)], "text string"), model, []).first()
    assert out["n_known"] == 3 and abs(out["base_score"] - sum(
        math.log10((c + .5) / (1002 + .5 * 4)) for c in (1, 1000, 0, 1))) < 1e-9
    assert pa.array([1])


@pytest.mark.parametrize(("known", "grams", "words"), [(1, 1, 1000), (3, 2, 1000), (3, 2, 0), (1000, 3, 1000), (0, 0, 0)])
def test_the_whole_model(spark, known, grams, words):
    """What the trie has no room for is scored as well: the scores are those of all n-grams."""
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3)
    test = spark.createDataFrame(list(enumerate(TEST)), "doc_id long, text string")
    model = lm.fit(train, known=known, grams=grams, words=words)
    got = sorted(lm.scored(test, model, ["doc_id"]).collect(), key=lambda r: r["doc_id"])
    for g, w in zip(got, plain(TRAIN, TEST), strict=True):
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:3]
        assert abs(g["base_score"] - w[3]) < 1e-9 and abs(g["score"] - w[4]) < 1e-4, (g, w)


def test_bits(spark):
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 20_000)
    bits = lm.Bits.build(spark.createDataFrame([(int(k),) for k in keys], "key long"), len(keys))
    assert bits(keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 20_000).view(np.uint64)
    assert bits(other).mean() < 0.1


def test_many_parts(spark, monkeypatch):
    """N-grams dealt out to many parts, and the tables that lead to them let go."""
    monkeypatch.setattr(lm, "PART", 3)
    train = spark.createDataFrame([(t,) for t in TRAIN], "text string").repartition(3)
    test = spark.createDataFrame(list(enumerate(TEST)), "doc_id long, text string").repartition(2)
    folder = Path(lm.checkpoint_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    model = lm.fit(train, known=4, grams=2)
    assert model.parts > 8
    got = sorted(lm.scored(test, model, ["doc_id"]).collect(), key=lambda r: r["doc_id"])
    for g, w in zip(got, plain(TRAIN, TEST), strict=True):
        assert abs(g["base_score"] - w[3]) < 1e-9 and abs(g["score"] - w[4]) < 1e-4, (g, w)
    # The weights alone: words, pairs, triples and keys of texts do not stay on disk.
    assert len([f for f in set(folder.iterdir()) - before if f.is_dir()]) == 1


def test_parts(monkeypatch):
    monkeypatch.setattr(lm, "PART", 50)
    rng, want, rows = np.random.default_rng(3), Counter(), []
    for _ in range(30):
        x, y = rng.integers(-3, 4, (2, 40))
        want.update(zip(x.tolist(), y.tolist()))
        rows.append(lm._chunks(lm._part(lm._routed(x, y), 5), lm.GRAMS2, [x, y, np.ones(40, np.int64)]))
    table, got, met = pa.Table.from_batches(rows).sort_by("part"), Counter(), []
    for part, held in lm._parts(iter(table.to_batches(max_chunksize=7))):
        x, y, n = held[lm.GRAMS2]
        assert (lm._part(lm._routed(x, y), 5) == part).all()
        met.append(part)
        got.update(dict(zip(zip(x.tolist(), y.tolist()), n.tolist())))
    assert got == want and met == sorted(set(met))
