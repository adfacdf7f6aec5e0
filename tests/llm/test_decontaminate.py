"""Decontamination against brute force; several passes; odd rows."""

import random
import re

import pytest

from holdfast.llm import decontaminate as D


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    windows = {}
    for i, text in items:
        w = split(text)
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                windows.setdefault(tuple(w[k:k + window]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for x, owners in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k:k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= owners
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def tables(seed):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "é", "İx", "9"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 20)))) for k in range(20)]
    items += [(3, items[4][1]), (77, items[5][1]), (None, "a b c"), (78, None), (79, "..."), (80, "the item of Words, that; is long enough")]
    docs = []
    for k in range(60):
        parts = [rng.choice(items)[1] or "" if rng.random() < .5 else " ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(3)]
        docs.append((k, rng.choice(["-", ", ", "\n"]).join(parts).upper() if k % 3 else " ".join(parts)))
    return docs + [(5, None), (None, "x the ITEM of words that is long enough"), (7, ""), (8, "a " * 50_000)], items


@pytest.mark.parametrize(("seed", "at_once"), [(1, 10_000), (2, 40)])
def test_equals_brute_force(spark, seed, at_once):
    docs, items = tables(seed)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, runs int").repartition(5)
    b = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id int, text string, words string")
    got = D.contamination(d, b, keep=["doc_id", "runs"], window=6, shingle=3, windows_at_once=at_once).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == \
        sorted((str(i), *x) for i, *x in brute(docs, items, 6))
    for r in got:
        runs = r["runs"]
        assert all(a < b for a, b in zip(runs, runs[1:])) and sum(runs[1::2]) - sum(runs[::2]) == r["n_hit"]


def test_a_share_of_the_shingles(spark):
    item = " ".join(f"w{k}" for k in range(10))
    near = item.replace("w9", "other")
    d = spark.createDataFrame([(1, f"x {near} y"), (2, item.replace("w4", "z"))], "doc_id int, text string")
    b = spark.createDataFrame([(1, item)], "item_id int, text string")
    got = {r["doc_id"]: r["n_hit"] for r in D.contamination(d, b, keep=["doc_id"], threshold=0.8).collect()}
    assert got == {1: 10, 2: 0}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    none = D.contamination(d, b.limit(0), keep=["doc_id"]).first()
    assert (none["n_words"], none["n_hit"], none["items"]) == (2, 0, [])
    assert D.contamination(d.limit(0), b, keep=["doc_id"]).count() == 0
