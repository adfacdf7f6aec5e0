"""Nearest neighbours: recall and order against brute force, copies, and rows that take no part."""

import numpy as np
import pyarrow as pa
import pytest

from holdfast.llm import ann
from tests.oracle import folder


def brute(rows, every, k):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        best[i] = min(best.get(i, v), v)
    size = max({len(v) for v in best.values()}, key=lambda n: (sum(len(v) == n for v in best.values()), n), default=0)
    best = {i: np.array(v, float) for i, v in best.items() if len(v) == size}
    out = {}
    for q in best:
        if q % every == 0:
            scores = sorted(((-float(best[q] @ v), i) for i, v in best.items() if i != q))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def result(df, **options):
    out = {}
    for r in sorted(ann.nearest(df, **options).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    return sum(hits) / sum(map(len, want.values()))


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet(f"{folder('/root/testdata/sf0.1')}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.select("vec_id", "embedding").collect()]
    got, want = result(df, list_size=20), brute(rows, 20, 20)
    assert recall(got, want) >= 0.9
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q in got for i, s in got[q])


def test_copies_lengths_and_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.integers(-3, 4, 3).astype(float).tolist()) for k in range(60)]
    rows += [(100 + k, [1.0, 2.0, 3.0]) for k in range(80)]
    rows += [(500, None), (505, [0.0, 0.0, 0.0]), (510, [1.0, None, 2.0]), (515, [1.0, float("nan"), 2.0]),
             (520, [1.0, float("inf"), 2.0]), (525, [1.0, 2.0]), (530, []), (None, [1.0, 1.0, 1.0]), (60, [9.0, 9.0, 9.0]), (60, [5.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = result(df, every=5, list_size=1000, k=7)
    assert got == {q: [(i, s) for i, s in x] for q, x in brute(rows, 5, 7).items()}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few(spark, n):
    df = spark.createDataFrame([(20 * k, [1.0, float(k)]) for k in range(n)], "vec_id long, embedding array<double>")
    assert {q: [i for i, _ in x] for q, x in result(df).items()} == ({0: [20], 20: [0]} if n == 2 else {})


def test_graph_finds_the_nearest_centroid():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(600, 16))
    x = rng.normal(size=(300, 16))
    ids, far = ann.search(ann.graph_of(centre), x, 10)
    real = np.sqrt(ann._squares(x, centre))
    assert (ids[:, 0] == real.argmin(1)).mean() > 0.95
    assert np.allclose(far[:, 0], real[np.arange(300), ids[:, 0]])


@pytest.mark.parametrize("dim", [2, 16])
def test_all_centroids_within_reach_are_found(dim):
    rng = np.random.default_rng(1)
    centre, x = rng.normal(size=(900, dim)), rng.normal(size=(300, dim)) * 0.5
    real = np.sqrt(ann._squares(x, centre))
    want = real <= real.min(1, keepdims=True) * 1.3
    row, node, far = ann.within(ann.graph_of(centre), x, 1.3)
    assert np.allclose(far, real[row, node])
    got = np.zeros_like(want)
    got[row, node] = True
    assert len(row) == got.sum()  # none twice
    assert (got & want).sum() >= 0.97 * want.sum() and (got & ~want).sum() <= 0.05 * want.sum()


def test_recall_on_many_lists(spark):
    """200,000 vectors without clusters in 1,000 lists: how far a query reads grows with the lists."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32).astype(float)
    ids = np.arange(len(x))
    table = pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))})
    got = result(spark.createDataFrame(table), every=1000)
    queries = ids[::1000]
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    want = {int(q): [(int(i), 0.0) for i in np.argsort(-score[k], kind="stable")[:20]] for k, q in enumerate(queries)}
    assert recall(got, want) >= 0.95


def test_lists_are_balanced():
    rng = np.random.default_rng(1)
    sample = np.concatenate([rng.normal(size=(1900, 8)) * 0.05, rng.normal(size=(100, 8)) * 5])
    centre = ann.centroids_of(sample, 40)
    size = np.bincount(ann._squares(sample, centre).argmin(1), minlength=40)
    assert size.max() < 0.25 * len(sample)
