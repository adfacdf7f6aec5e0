"""Packing: ids against the tokenizer, places gapless, and as few sequences as a plain best fit."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from holdfast.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "Hello, world!", "L'été à Zürich: don't it's 12.5% é  x ﬁn Σας <|endoftext|> áb",
         "İstanbul ẞ ǅ 中文 字 🙂🙂 naïve -- 'tis 'S ... *** a's", "word\x1cword\x85tab\tend\n", "x" * 5000, "­ soft",
         "Straße" * 300, "mixed3digits 4you a_b-c{d}~`", "ªº µ×÷ ÀÿÞ"]


def brute(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_ids():
    ids, border = packing.tokens(PATH).encode(pa.array([*TEXTS, None]))
    assert packing.tokens(PATH).short
    assert [ids[a:b].tolist() for a, b in zip(border, border[1:])] == brute([*TEXTS, None])


def test_ids_after_forgetting(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 5)
    t = packing.Tokens(PATH)
    for text in TEXTS * 2:
        assert t.encode(pa.array([text]))[0].tolist() == brute([text])[0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert packing.tokens(PATH).encode(pa.array([text]))[0].tolist() == brute([text])[0]


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(capacity - n)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan(lengths):
    capacity = 30
    histogram = {n: lengths.count(n) for n in set(lengths)}
    places, ranks = {}, {n: [] for n in histogram}
    for r in packing.plan(histogram, capacity):
        ranks[r.length] += range(r.first, r.first + r.n)
        for k in range(r.n):
            places.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
    assert {n: len(x) for n, x in ranks.items()} == histogram
    assert all(sorted(x) == list(range(len(x))) for x in ranks.values())
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(spans[-1]) <= capacity
        assert sum(3 * n > capacity for _, n in spans) <= 2
    assert len(places) <= max(plain_best_fit(lengths, capacity) * 1.1, plain_best_fit(lengths, capacity) + 1)


def test_large_pieces_pair():
    assert len({r.sequence for r in packing.plan({20: 1, 10: 1, 15: 2}, 30)}) == 2


def test_packed(spark):
    rng = np.random.default_rng(5)
    words = ["alpha", "Béta,", "gamma.", "7", "don't"]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 3000, 60)] + [None, "", "", "same", "same"]
    df = spark.createDataFrame([(k // 2, t, k) for k, t in enumerate(texts)], "doc_id long, text string, `offset` int")
    rows = packing.packed(df.repartition(5), PATH, ["doc_id", "offset"]).collect()
    ids = brute(texts)
    want = sorted((k // 2, p, p * 2048, len(x[p * 2048:(p + 1) * 2048]),
                   zlib.crc32(np.array(x[p * 2048:(p + 1) * 2048], "<u4")))
                  for k, x in enumerate(ids) for p in range(-(-len(x) // 2048)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    total = sum(map(len, ids))
    assert len(bins) <= total / 2048 * 1.1 + 1


def test_no_documents(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH, ["doc_id"]).count() == 0
