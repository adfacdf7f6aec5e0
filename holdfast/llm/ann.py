"""Approximate nearest neighbours by balanced posting lists.

Largest inner products become smallest distances: every vector gets one more coordinate that lifts all
to the length of the longest, queries get 0 there. Centroids are fitted to a bounded sample, with
centroids taken from small clusters and given to large ones, so that the lists come out balanced. They
are searched through a graph of neighbours held in memory. A vector goes to the list of its nearest
centroid and, near a border, to a few more; a query reads all lists whose centroid is at most so many
times as far as its nearest, however many these are: the ratio alone decides. Scores are then exact.
The nearest lists are read first; of the others, only what beats a query's last place so far is sent on.

Equal vectors are one candidate with its smallest ids, as many as can be asked for, so copies cost
nothing. A list too long for a task is dealt in parts, and so are the queries of a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.frames import name
from holdfast.operators.ordering import top_per_group
from holdfast.scale import durable, skew_join

NEAREST = 20
# Rows the centroids are fitted to, chosen by a hash of the id.
SAMPLE = 20_000
# Vectors of a list on average, and the most lists: that many centroids and their graph are broadcast.
LIST = 200
LISTS = 4096
# Lists a vector may be in, and how much further than the nearest a centroid may be for that.
REPLICAS = 4
BORDER = 1.1
# How much further than the nearest a centroid may be for a query to read its list.
REACH = 1.18
# Lists a query reads before the others: they decide what the others have to beat, not what is read.
FIRST = 16
DEGREE = 24
# Vectors and queries that meet in one task.
PART = 4096
QUERIES = 1024


class Graph(NamedTuple):
    """Centroids, the neighbours of each, and where every search starts."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means in which, every round, the smallest clusters give their centroid to the largest."""
    rng = np.random.Generator(np.random.PCG64(3))
    lists = min(lists, len(sample))
    centre = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for turn in range(rounds):
        near = np.concatenate([_squares(sample[k:k + 4096], centre).argmin(1) for k in range(0, len(sample), 4096)])
        size = np.bincount(near, minlength=lists)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
        if turn < rounds - 3:
            order = np.argsort(size, kind="stable")
            for small, large in zip(order[:lists // 8], order[::-1]):
                if size[large] > 2 * len(sample) / lists and size[small] < len(sample) / lists / 2:
                    members = np.flatnonzero(near == large)
                    centre[small] = sample[members[rng.integers(len(members))]]
    return centre


def graph_of(centre: np.ndarray) -> Graph:
    """Each centroid's nearest, those it is nearest to as far as there is room, and a few far ones."""
    n = len(centre)
    k = min(DEGREE, n - 1)
    rng = np.random.Generator(np.random.PCG64(4))
    near = np.zeros((n, k), np.int64)
    for low in range(0, n, 512):
        d = _squares(centre[low:low + 512], centre)
        d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
        if k:
            part = np.argpartition(d, k - 1, axis=1)[:, :k]
            near[low:low + 512] = part
    back: list[list[int]] = [[] for _ in range(n)]
    for a in range(n):
        for b in near[a].tolist():
            if len(back[b]) < DEGREE // 2:
                back[b].append(a)
    width = k + DEGREE // 2 + 4
    neighbours = np.empty((n, width), np.int64)
    for a in range(n):
        links = list(dict.fromkeys([*near[a].tolist(), *back[a], *rng.integers(0, n, 4).tolist()]))[:width]
        neighbours[a] = links + [a] * (width - len(links))
    return Graph(centre, neighbours, np.unique(rng.integers(0, n, 16)))


def search(graph: Graph, x: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroids of every row of ``x`` found by walking the graph: (number, distance), nearest first.

    Rows have -1 and infinity where there are fewer than ``wanted``.
    """
    ids, far = np.full((len(x), wanted), -1, np.int64), np.full((len(x), wanted), np.inf)
    for low in range(0, len(x), 256):
        part = x[low:low + 256]
        rows = np.arange(len(part))[:, None]
        width = max(wanted, 24)
        start = np.broadcast_to(graph.entries, (len(part), len(graph.entries)))
        seen = np.zeros((len(part), len(graph.centroids)), bool)
        seen[rows, start] = True
        beam = np.full((len(part), width), -1, np.int64)
        dist, done = np.full((len(part), width), np.inf), np.ones((len(part), width), bool)

        def merge(new, d, beam, dist, done):
            beam, dist = np.concatenate([beam, new], 1), np.concatenate([dist, d], 1)
            done = np.concatenate([done, ~np.isfinite(d)], 1)
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            return beam[rows, order], dist[rows, order], done[rows, order]

        def distance(at):
            gap = graph.centroids[at] - part[:, None, :]
            return np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))

        beam, dist, done = merge(start, distance(start), beam, dist, done)
        while not done.all():
            at = np.argmin(done, axis=1)  # the nearest not yet expanded; rows that are through repeat their first
            node = np.maximum(beam[rows[:, 0], at], 0)
            done[rows[:, 0], at] = True
            new = graph.neighbours[node]
            fresh = ~seen[rows, new]
            seen[rows, new] = True
            beam, dist, done = merge(new, np.where(fresh, distance(new), np.inf), beam, dist, done)
        got = min(wanted, width)
        ids[low:low + 256, :got] = np.where(np.isfinite(dist[:, :got]), beam[:, :got], -1)
        far[low:low + 256, :got] = dist[:, :got]
    return ids, far


def within(graph: Graph, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``x``, number, distance) of every centroid found at most ``reach`` times as far as the row's nearest.

    A walk finds the nearest; from there the graph is flooded through all centroids that are near enough.
    """
    n, found = len(graph.centroids), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low in range(0, len(x), 256):
        part = x[low:low + 256]
        ids, far = search(graph, part, DEGREE)
        bound = far[:, 0] * reach + 1e-12
        seen = np.zeros(len(part) * n, bool)
        row, at = np.nonzero((ids >= 0) & (far <= bound[:, None]))
        node, far = ids[row, at], far[row, at]
        seen[row * n + node] = True
        while len(row):
            found.append((row + low, node, far))
            flat = np.unique((row[:, None] * n + graph.neighbours[node]).ravel())
            flat = flat[~seen[flat]]
            seen[flat] = True
            row, node = flat // n, flat % n
            far = np.zeros(len(flat))
            for k in range(0, len(flat), 8192):
                gap = graph.centroids[node[k:k + 8192]] - part[row[k:k + 8192]]
                far[k:k + 8192] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            near = far <= bound[row]
            row, node, far = row[near], node[near], far[near]
    rows, nodes, gaps = (np.concatenate(x) for x in zip(*found))
    return rows, nodes, gaps


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]], axis=1)


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector): one finite vector other than zero for each id, the smallest of several; of the most common length."""
    plain = vectors.select(name(id).cast("long").alias("id"), name(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = plain.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()
                        & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0.0))
    sizes = good.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return good.filter(F.size("vector") == (sizes["dim"] if sizes else 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def _posted(classes: DataFrame, graph, dim: int, longest: float) -> DataFrame:
    """(list, class, vector): each class in its nearest list and in those whose border it is near."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                ids, far = search(g, _lifted(_matrix(batch.column("vector"), dim), longest), REPLICAS * 2)
                kept = (ids >= 0) & (far <= far[:, :1] * BORDER + 1e-12)
                # A further list that lies closer to one already chosen than to the vector adds little.
                for k in range(1, ids.shape[1]):
                    for j in range(k):
                        gap = np.linalg.norm(g.centroids[ids[:, k]] - g.centroids[ids[:, j]], axis=1)
                        kept[:, k] &= ~kept[:, j] | (gap >= far[:, k] * 0.5)
                kept &= np.cumsum(kept, axis=1) <= REPLICAS
                row, at = np.nonzero(kept)
                rows = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, at].astype(np.int32)), rows.column("class"), rows.column("vector")],
                                                 names=["list", "class", "vector"])

    return classes.select("class", "vector").mapInArrow(assign, "list int, class long, vector array<double>")


def _probed(asked: DataFrame, graph, dim: int) -> DataFrame:
    """(query, vector, list, early): the lists each query reads, and whether one is of its FIRST nearest."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                x = _matrix(batch.column("vector"), dim)
                row, node, far = within(graph.value, np.concatenate([x, np.zeros((len(x), 1))], 1), REACH)
                order = np.lexsort((node, far, row))
                row, node = row[order], node[order]
                early = np.arange(len(row)) - np.searchsorted(row, row) < FIRST
                for k in range(0, len(row), 8192):
                    rows = batch.take(pa.array(row[k:k + 8192]))
                    yield pa.RecordBatch.from_arrays([rows.column("query"), rows.column("vector"), pa.array(node[k:k + 8192].astype(np.int32)),
                                                      pa.array(early[k:k + 8192])], names=["query", "vector", "list", "early"])

    return asked.mapInArrow(probe, "query long, vector array<double>, list int, early boolean")


def _meet(dim: int, k: int):
    """The k best classes of a part of a list for each of some queries, with exact scores of at least the query's floor."""
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            left, right = left.combine_chunks(), right.combine_chunks()
            v, q = (_matrix(t.column("vector").combine_chunks(), dim) for t in (left, right))
            classes, queries, floor = left.column("class").to_numpy(), right.column("query").to_numpy(), right.column("floor").to_numpy()
            found = []
            for low in range(0, len(q), 256):
                score = q[low:low + 256] @ v.T
                take = min(len(v), k + 8)  # a few more than asked, because these sums may differ in the last bit
                at = np.argpartition(-score, take - 1, axis=1)[:, :take]
                row = np.repeat(np.arange(low, low + len(at)), take)
                exact = np.einsum("ij,ij->i", v[at.ravel()], q[row])
                order = np.lexsort((classes[at.ravel()], -exact, row))
                order = order[np.arange(len(order)) % take < k]
                order = order[exact[order] >= floor[row[order]]]
                found.append((queries[row[order]], classes[at.ravel()[order]], exact[order]))
            out = [np.concatenate(x) for x in zip(*found)]
        return pa.table(out, names=["query", "class", "score"])
    return meet


def _met(posted: DataFrame, probed: DataFrame, dim: int, k: int) -> DataFrame:
    """(query, class, score): queries meet the lists they read, long lists and many queries of one in parts."""
    parts = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).join(
        probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares")), "list")
    parts = F.broadcast(parts)  # a row for each list, LISTS at most
    left = (posted.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            .select("list", "part", "share", "class", "vector"))
    right = (probed.join(parts, "list").withColumn("share", F.pmod(F.xxhash64("query"), F.col("shares")).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("list", "part", "share", "query", "vector", "floor"))
    keys = ["list", "part", "share"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(dim, k), "query long, class long, score double")


def _best(met: DataFrame, k: int) -> DataFrame:
    """The k best classes of each query, a class once."""
    each = met.groupBy("query", "class").agg(F.max("score").alias("score"))
    return top_per_group(each, ["query"], [F.desc("score"), F.col("class")], k, "_at").drop("_at")


def nearest(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = NEAREST,
            list_size: int = LIST, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every``, its ``k`` nearest other ids found.

    Nearest is the largest inner product, in double precision; ties go to the smaller id. Vectors that
    are NULL, zero, not finite throughout or of another than the most common length take no part, nor
    do rows without id. Rows of one id count once, with the smallest of their vectors.
    """
    spark = vectors.sparkSession
    rows = durable(usable(vectors, id, vector))
    first = top_per_group(rows, ["vector"], [F.col("id")], k + 1, "_at")
    classes = durable(first.groupBy("vector").agg(F.min("id").alias("class"), F.sort_array(F.collect_list("id")).alias("ids")))
    n, dim, longest = classes.agg(F.count(F.lit(1)), F.max(F.size("vector")),
                                  F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).first()
    asked_ids = rows.filter(F.col("id") % every == 0)
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                           F.lit(0.0).alias("score")).limit(0)
    draw = F.pmod(F.xxhash64("class"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n))
    picked = classes.filter(draw).select("class", "vector").toArrow()
    if not picked.num_rows:
        picked = classes.select("class", "vector").limit(1).toArrow()
    picked = picked.sort_by("class")
    fitted = _lifted(_matrix(picked.column("vector").combine_chunks(), dim), longest)
    lists = max(1, min(LISTS, -(-n // list_size)))
    graph = spark.sparkContext.broadcast(graph_of(centroids_of(fitted, lists)))

    owner = classes.select(F.col("class").alias("query"), "vector")
    asked = skew_join(asked_ids, owner, "vector").select("id", "query")
    asked = durable(asked)
    distinct = asked.select("query").distinct().join(owner, "query")
    posted = durable(_posted(classes, graph, dim, longest))
    probed = durable(_probed(distinct.select("query", "vector"), graph, dim))
    any_score = F.lit(float("-inf"))
    found = durable(_best(_met(posted, probed.filter("early").withColumn("floor", any_score), dim, k + 1), k + 1))
    floors = found.groupBy("query").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("floor"))
    later = probed.filter("not early").join(floors, "query", "left").withColumn("floor", F.coalesce("floor", any_score))
    best = _best(found.unionByName(_met(posted, later, dim, k + 1)), k + 1)
    members = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    members = durable(top_per_group(members, ["query"], [F.desc("score"), F.col("vec_id")], k + 1, "_at").drop("_at"))
    answers = skew_join(asked, members, "query").filter(F.col("vec_id") != F.col("id"))
    ranked = top_per_group(answers, ["id"], [F.desc("score"), F.col("vec_id")], k, "rank")
    return ranked.select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")
