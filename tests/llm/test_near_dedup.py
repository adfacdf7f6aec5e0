"""Near-duplicates against brute force over all pairs."""

import random
from bisect import bisect_left

import numpy as np
import pytest

from holdfast.llm import near_dedup as N


def words(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        k = rng.randrange(len(text))
        what = rng.random()
        if what < 0.6:
            text[k] = f"e{rng.randint(0, 10**6)}"
        elif what < 0.8 and len(text) > 2:
            del text[k]
        else:
            text.insert(k, f"e{rng.randint(0, 10**6)}")
    return text


def shingles(text):
    found, seen = [], {}
    for k in range(max(1, len(text) - 4)):
        x = tuple(text[k:k + 5])
        seen[x] = seen.get(x, 0) + 1
        found.append((x, seen[x]))
    return found


def plain_similarity(a, b):
    a, b = shingles(a), shingles(b)
    place = {x: k for k, x in enumerate(b)}
    tails = []
    for k in (place[x] for x in a if x in place):
        at = bisect_left(tails, k)
        tails[at:at + 1] = [k]
    return len(tails) / (len(a) + len(b) - len(tails))


def brute(texts, least=0.8):
    """Component (smallest place) of each text; None without words."""
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(texts)):
        for b in range(a):
            if texts[a] and texts[b] and (texts[a] == texts[b] or plain_similarity(texts[a], texts[b]) >= least):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(k) if texts[k] else None for k in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([1, 3, 8, 40, 200])) for _ in range(25)]
    passage = words(rng, 60)
    texts += [words(rng, 30) + passage + words(rng, 30) for _ in range(12)]
    for _ in range(60):
        base = rng.choice(texts)
        texts.append(edited(rng, base, rng.randint(0, max(1, len(base) // 25))))
    base = words(rng, 120)
    texts += [edited(rng, base, rng.randint(1, 4)) for _ in range(40)]
    rng.shuffle(texts)
    return texts + [[], []]


@pytest.mark.parametrize(("seed", "crowd"), [(1, 48), (2, 3)])
def test_equals_brute_force(spark, seed, crowd, monkeypatch):
    monkeypatch.setattr(N, "CROWD", crowd)
    texts = corpus(seed)
    df = spark.createDataFrame([(k, " ".join(t).upper() + "." if k % 2 else ", ".join(t)) for k, t in enumerate(texts)],
                               "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r for r in N.near_duplicates(df).collect()}
    want = brute(texts)
    assert [got[k]["class_id"] for k in range(len(texts))] == [k if w is None else w for k, w in enumerate(want)]
    assert all(got[k]["class_size"] == (1 if w is None else want.count(w)) for k, w in enumerate(want))
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, w in enumerate(want) if w in (None, k))


def test_similarity_equals_the_plain_one():
    rng = random.Random(7)
    ids = {}
    code = lambda t: np.array([ids.setdefault(x, len(ids) * 7919 + 13) for x in t], np.uint64)
    for _ in range(300):
        a = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(1, 60))]
        b = edited(rng, a, rng.randint(0, 6))
        real = plain_similarity(a, b)
        got = N.similarity(N.shingled(code(a)), N.shingled(code(b)))
        assert got == pytest.approx(real) if real >= 0.8 else got < 0.8


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g", 9), (1, "a b c d e f g", 9), (None, "A, b c d e f g!", 9), (2, None, 9), (2, "", 9), (3, "...", 9),
            (4, "x " * 100_000, 9), (5, "x " * 100_000 + "y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = sorted((str(r["doc_id"]), r["class_id"], r["class_size"]) for r in N.near_duplicates(df).collect())
    assert got == [("1", 1, 3), ("1", 1, 3), ("2", 2, 1), ("2", 2, 1), ("3", 3, 1), ("4", 4, 2), ("5", 4, 2), ("None", 1, 3)]
    assert sorted(str(r["doc_id"]) for r in N.one_of_each(df).collect()) == ["1", "2", "2", "3", "4"]
    assert N.near_duplicates(df.limit(0)).count() == 0 and N.one_of_each(df.limit(0)).count() == 0


def short_pairs(seed):
    """Pairs of 4 to 40 words of which one has a word more at an end, and pairs of 13 with a changed end word."""
    rng, texts = random.Random(seed), []
    for n in [8, 9] * 30 + list(range(4, 40)) * 3:
        text = words(rng, n)
        texts += [text, [*text, "more"] if rng.random() < 0.5 else ["more", *text]]
    for _ in range(60):
        text = words(rng, 13)
        texts += [text, [*text[:-1], "other"]]
    return texts


@pytest.mark.parametrize("crowd", [48, 1])
def test_short_pairs_are_never_missed(spark, crowd, monkeypatch):
    monkeypatch.setattr(N, "CROWD", crowd)
    texts = short_pairs(4)
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)
    assert got[1] == 0 and got[3] == 2  # 8 against 9 words, 9 against 10


def test_crowded_short_texts(spark):
    """A passage in texts that are not similar as a whole, and links between them by pairs: no pair is lost."""
    rng = random.Random(5)
    passage, texts = words(rng, 14), []
    for _ in range(90):
        text = words(rng, 4) + passage + words(rng, 4)
        texts += [text, [*text, "more"]]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for crowd in (48, 2):
        edges = N.linked(df, crowd=crowd).count()
        assert edges == sum(w != k for k, w in enumerate(brute(texts)))


def test_shared_shingles_are_counted():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, rng.choice([30, 4000]), rng.integers(1, 40))).astype(np.uint64) for _ in range(300)]
    shared = N._shared(sets)
    off = [(a, b) for a in range(300) for b in range(300) if a != b]
    assert [shared[a, b] for a, b in off] == [len(np.intersect1d(sets[a], sets[b])) for a, b in off]


def test_a_block_sends_a_forest_of_links_and_no_failures():
    """Copies of a text with 1 to 8 changed words: what is sent joins what plain links join, in fewer rows than texts."""
    import pyarrow as pa
    rng = random.Random(9)
    base = words(rng, 120)
    texts = [edited(rng, base, rng.randint(1, 8)) for _ in range(150)]
    ids = {}
    code = [np.array([ids.setdefault(w, len(ids) * 7919 + 13) for w in t], np.uint32) for t in texts]
    node = [b"%03d" % k for k in range(len(texts))]
    for part in (np.zeros(150, int), np.arange(150) % 2):
        table = pa.table({"node": node, "class": node, "words": [c.tobytes() for c in code], "part": part})
        links = list(zip(*(N._meet(0.8)(table).column(c).to_pylist() for c in "uv")))
        assert len(links) < len(texts) and all(u > v for u, v in links)
        real = {(a, b) for a in range(150) for b in range(a) if plain_similarity(texts[a], texts[b]) >= 0.8 and (not part.any() or part[a] != part[b])}
        assert {(int(u), int(v)) for u, v in links} <= real

        def classes(pairs):
            root = list(range(150))
            for a, b in list(pairs) * 150:
                root[a] = root[b] = min(root[a], root[b])
            return root
        assert classes((int(u), int(v)) for u, v in links) == classes(real)
        assert 0 < len(links)


def test_failing_pairs_of_a_crowd_are_not_written(spark):
    """Texts of 120 words with 5 changed words each: they share draws, and none is a link."""
    rng = random.Random(3)
    base = words(rng, 120)
    texts = []
    for _ in range(300):
        text = list(base)
        for at in rng.sample(range(5, 115), 5):
            text[at] = f"x{rng.random()}"
        texts.append(" ".join(text))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    links = N.linked(df).count()
    assert links == sum(w != k for k, w in enumerate(brute([t.split() for t in texts])))


@pytest.mark.parametrize("length", [33, 60, 120, 400, 2000])
def test_recall_of_near_copies(length):
    """Of pairs at 0.8 to 0.85, those that share a draw."""
    rng = np.random.default_rng(length)
    found = tried = 0
    while tried < 150:
        a = rng.integers(0, 2**62, length).astype(np.uint64)
        b = a.copy()
        at = np.sort(rng.choice(length, max(1, round(length * rng.uniform(0.015, 0.03))), replace=False))
        b[at] = rng.integers(0, 2**62, len(at)).astype(np.uint64)
        x, y = N.shingled(a), N.shingled(b)
        if 0.8 <= N.similarity(x, y) <= 0.85:
            tried += 1
            found += bool((N.draws(x) == N.draws(y)).any()) if min(len(x), len(y)) > N.SHORT else 1
        elif length < 60:
            length += 1
    assert found >= 0.95 * tried
