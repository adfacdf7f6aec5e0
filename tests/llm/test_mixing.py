"""Mixing: targets against plain dealing, the flight against its balance, and totals near their targets."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from holdfast.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Deals what is above a limit anew until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, full, rest = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        target |= {s: rest * weight[s] / total for s in open_} if total else {}
        above = [s for s in open_ if target[s] > most * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = most * sizes[s]
            rest -= target[s]
        full |= set(above)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0.01, 0.99), st.floats(0, 0.999)), min_size=1, max_size=30))
def test_flight_keeps_both_totals(docs):
    flight, decided = mixing.Flight(), {}
    for k, (size, part, chance) in enumerate(docs):
        decided |= dict(flight.take(k, size, part, chance))
        assert len(flight.held) <= 2
    now = decided | {h[0]: h[2] for h in flight.held}
    assert sorted(now) == list(range(len(docs)))
    assert all(p in (0.0, 1.0) for p in decided.values())
    assert sum(now.values()) == pytest.approx(sum(p for _, p, _ in docs), abs=1e-6)
    assert sum(p * docs[k][0] for k, p in now.items()) == pytest.approx(sum(s * p for s, p, _ in docs), abs=1e-5)


def test_landing_stays_near():
    rng = random.Random(2)
    for part in (0.1, 0.5, 0.8):
        landing, over = mixing.Landing(), 0.0
        for size in sorted((rng.randint(2**k, 2**(k + 1)) for k in range(15) for _ in range(8)), reverse=True):
            (_, value), = landing.take(0, size, part, rng.random())
            over += (value - part) * size
        assert abs(over) <= 2


def test_a_step_keeps_expectations():
    size, part = (5, 9, 2), (0.3, 0.6, 0.5)
    mean = [sum(mixing.move(size, part, (k + 0.5) / 20000)[j] for k in range(20000)) / 20000 for j in range(3)]
    assert mean == pytest.approx(part, abs=1e-3)


def rows(spark, docs):
    return spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, source string, text string, size int, target string")


def taken(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs = []
    for k in range(3000):
        source = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, "é", "zz", "empty"])
        n = 0 if source == "empty" else rng.choice([0, 1, rng.randint(1, 30), rng.randint(1, 300)])
        docs.append((k, source, " \t".join(["w"] * n) if n else rng.choice([None, "", " \n "])))
    docs.append((9000, "one", "w " * 8000))
    docs += [(77, "same", "a b c")] * 500
    return docs


def test_mix(spark, corpus):
    df = rows(spark, corpus).repartition(7)
    options = dict(keep=["doc_id", "source"], chunk=64)
    got = mixing.mixed(df, **options).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d[0] for d in corpus)
    sizes, words = {}, {}
    for _, source, text in corpus:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert rate - 1 < r["copies"] < rate + 1 and 0 <= r["copies"] <= 2
        words[r["source"]] = words.get(r["source"], 0) + r["size"] * r["copies"]
    for source, target in want.items():
        allowed = 8000 if source == "one" else 2
        assert abs(words[source] - target) <= allowed, (source, words[source], target)
    for source in ("hot", "a", "b", None):
        mine = [r for r in got if r["source"] == source]
        rate = mine[0]["target"] / mine[0]["source_size"]
        assert abs(sum(r["copies"] for r in mine) - rate * len(mine)) <= 0.05 * len(mine) + 10


def test_reruns_agree_however_rows_are_dealt(spark, corpus):
    options = dict(keep=["doc_id"], chunk=64)
    a, b = (mixing.mixed(rows(spark, corpus).repartition(n), **options) for n in (3, 11))
    assert taken(a) == taken(b)


def test_against_a_plain_cube(spark):
    """A source of a single chunk gives what plain loops over its documents give."""
    docs = [(k, "s" if k % 3 else "t", "w " * (k * 7 % 40)) for k in range(400)]
    df = rows(spark, docs)
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit(20240611))
    size = {k: len(t.split()) for k, _, t in docs}
    facts = spark.createDataFrame(list(size.items()), "doc_id long, size long").select(
        "doc_id", h, F.pmod(F.xxhash64(h, "size"), F.lit(1_000_000))).collect()
    hashes, drawn = {r[0]: r[1] for r in facts}, {r[0]: r[2] for r in facts}
    got = {r["doc_id"]: r for r in mixing.mixed(df).collect()}
    for source in "st":
        mine = [k for k, s, _ in docs if s == source]
        rate = got[mine[0]]["target"] / got[mine[0]]["source_size"]
        order = {k: (size[k] + 1).bit_length() for k in mine}
        back = {k for k in mine if drawn[k] * list(order.values()).count(order[k]) < mixing.KEPT * 1_000_000}
        assert 0 < len(back) < len(mine)

        def loop(flight, docs):
            out = {}
            for k, p in docs:
                out |= dict(flight.take(k, size[k], p, ((hashes[k] % 2**64) >> 11) * 2.0**-53))
            return out

        flight = mixing.Flight()
        decided = loop(flight, [(k, rate - int(rate)) for k in sorted(set(mine) - back, key=lambda k: hashes[k])])
        late = [(k, rate - int(rate)) for k in back] + [(k, p) for k, _, p in flight.held]
        decided |= loop(mixing.Landing(), sorted(late, key=lambda d: (-size[d[0]], hashes[d[0]])))
        assert {k: got[k]["copies"] for k in mine} == {k: int(rate) + int(p) for k, p in decided.items()}


def test_no_documents(spark):
    df = mixing.mixed(rows(spark, []))
    assert df.columns == ["doc_id", "size", "source_size", "target", "copies"] and df.collect() == []


def test_nothing_but_empty_texts(spark):
    got = mixing.mixed(rows(spark, [(1, "a", None), (2, None, ""), (None, None, None)])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in got] == [(0, 0.0, 0)] * 3


def test_whole_rates_need_no_chance(spark):
    got = mixing.mixed(rows(spark, [(k, "a", "x y") for k in range(10)]), share=2.0).collect()
    assert {r["copies"] for r in got} == {2}


def test_a_very_long_text(spark):
    got = mixing.mixed(rows(spark, [(1, "a", "word " * 1_000_000), (2, "a", "word"), (3, "b", "w " * 400_000)])).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {1: 1_000_000, 2: 1, 3: 400_000}
