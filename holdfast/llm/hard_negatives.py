"""Hard negatives by a secondary sort: one sorted pass over the scored pairs of each anchor.

Scored pairs are packed into keys of (anchor, descending score, kind, id) and go through one
``repartition`` by anchor and one ``sortWithinPartitions`` by key, the DataFrame form of
``repartitionAndSortWithinPartitions``. An iterator reads an anchor's pairs from the best score down:
a positive opens a window, which is as wide as its score allows, every negative goes into the windows
that are open, and a window ends when it is full or the scores leave it. So an anchor costs
its open windows, however many pairs it has.

Anchors meet all rows in blocks: so many at a time are sent to all tasks, which score them against the
rows of their partition. A pair that a task can tell is beaten by as many better ones of the same
task as are asked for cannot be in the result and is not sent on; so what is shuffled is at most a
full set of windows for each anchor and task. Positives first, because they set the windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.frames import name
from holdfast.scale import durable

POSITIVES = 5
NEGATIVES = 5
# A negative scores between FLOOR and CEILING per cent of the positive.
FLOOR, CEILING = 80, 100
# Each component is floor(SCALE * x).
SCALE = 256.0
# Anchors sent to all tasks at once: 20,000 of 64 components are 10 MB.
ANCHORS = 20_000
# Rows and anchors scored at once.
ROWS, SOME = 4096, 256
# Scores beyond are these.
EDGE = 9 * 10**16
_LOW = np.int64(-(2**63))
_KEY = np.dtype([("anchor", ">u8"), ("down", ">u8"), ("kind", "u1"), ("id", ">u8")])
_SIGN = np.uint64(1 << 63)


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, id: np.ndarray) -> pa.Array:
    """Keys whose order as bytes is that of (anchor, score from the largest, kind, id)."""
    keys = np.empty(len(anchor), _KEY)
    keys["anchor"], keys["id"] = anchor.view(np.uint64) ^ _SIGN, id.view(np.uint64) ^ _SIGN
    keys["down"], keys["kind"] = ~(score.view(np.uint64) ^ _SIGN), kind
    return pa.Array.from_buffers(pa.binary(_KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpacked(keys: pa.Array) -> tuple[list[int], list[int], list[int], list[int]]:
    """anchor, score, kind and id of each key."""
    found = np.frombuffer(b"".join(keys.to_pylist()), _KEY)
    signed = [(found[c].astype(np.uint64) ^ _SIGN).view(np.int64).tolist() for c in ("anchor", "id")]
    score = (~found["down"].astype(np.uint64) ^ _SIGN).view(np.int64).tolist()
    return signed[0], score, found["kind"].tolist(), signed[1]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact, no further from 0 than EDGE."""
    longest = [float(np.sqrt((x * x).sum(1).max(initial=0))) for x in (a, b)]
    if longest[0] * longest[1] < 2**52:  # then every partial sum of a product is a whole number below 2**53
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -EDGE, EDGE).astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each of ``n`` places, of all that were offered."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), _LOW), np.zeros((n, k), np.int64)

    def offer(self, low: int, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` of places from ``low`` on with ``ids``; _LOW where there is none. ``ids`` ascend."""
        places, n = score.shape
        held = slice(low, low + places)
        least = self.score[held, -1]
        if n > self.k:
            least = np.maximum(least, np.partition(score, n - self.k, axis=1)[:, n - self.k])
        row, at = np.nonzero((score >= least[:, None]) & (score > _LOW))
        if not len(row):
            return
        old_row, old = np.nonzero(self.score[held] > _LOW)
        row, value = np.concatenate([old_row, row]), np.concatenate([self.score[held][old_row, old], score[row, at]])
        id = np.concatenate([self.id[held][old_row, old], ids[at]])
        order = np.lexsort((id, ~value, row))
        row, value, id = row[order], value[order], id[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = rank < self.k
        self.score[low + row[first], rank[first]], self.id[low + row[first], rank[first]] = value[first], id[first]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """place, score, id of all that is held."""
        place, at = np.nonzero(self.score > _LOW)
        return place, self.score[place, at], self.id[place, at]


def usable(rows: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """(id, label, v): rows that take part, once an id (the smallest label, then vector), components whole."""
    v = name(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.filter(name(id).isNotNull() & name(label).isNotNull() & name(vector).isNotNull() & finite)
    used = used.select(name(id).cast("long").alias("id"), F.struct(name(label).cast("long").alias("label"), v.alias("v")).alias("row"))
    one = used.groupBy("id").agg(F.min("row").alias("row"))
    return one.select("id", F.col("row.label").alias("label"), F.col("row.v").alias("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids ascending, labels and whole components of the rows of each length of vector, ROWS at most."""
    ids, labels, v = (batch.column(c) for c in ("id", "label", "v"))
    ids, labels, lengths = ids.to_numpy(), labels.to_numpy(), np.diff(v.offsets.to_numpy())
    start, flat = v.offsets.to_numpy()[:-1], v.values.to_numpy()
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        for low in range(0, len(rows), ROWS):
            at = rows[low:low + ROWS]
            yield ids[at], labels[at], np.floor(SCALE * flat[start[at][:, None] + np.arange(length)])


class Anchors:
    """Anchors of one length of vector: ids ascending, labels, components, and their positives by rank where known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, positives: dict[int, list[int]] | None, most: int):
        self.ids, self.labels, self.v = ids, labels, v
        self.scores = np.full((len(ids), most), _LOW)
        for k, id in enumerate(ids.tolist() if positives else ()):
            found = positives.get(id, [])
            self.scores[k, :len(found)] = found


def _positives(sent, k: int):
    """Keys of the ``k`` best rows of an anchor's label in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(a.ids), k) for a in sent.value]
        for batch in batches:
            for ids, labels, v in _matrices(batch):
                for a, held in zip(sent.value, best):
                    if a.v.shape[1] != v.shape[1]:
                        continue
                    for low in range(0, len(a.ids), SOME):
                        part = slice(low, low + SOME)
                        here = np.isin(labels, a.labels[part])
                        score = products(a.v[part], v[here])
                        other = (a.labels[part, None] != labels[here]) | (a.ids[part, None] == ids[here])
                        score[other] = _LOW
                        held.offer(low, score, ids[here])
        for a, held in zip(sent.value, best):
            place, score, id = held.all()
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[place]), packed(a.ids[place], score, 0, id)], names=["anchor", "key"])
    return run


def _negatives(sent, k: int, floor: int, ceiling: int):
    """Keys of the rows of another label that are among the ``k`` best of this task in any window of an anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[Best(len(a.ids), k) for _ in range(a.scores.shape[1])] for a in sent.value]
        for batch in batches:
            for ids, labels, v in _matrices(batch):
                for a, windows in zip(sent.value, best):
                    if a.v.shape[1] != v.shape[1]:
                        continue
                    for low in range(0, len(a.ids), SOME):
                        part = slice(low, low + SOME)
                        score = products(a.v[part], v)
                        score[a.labels[part, None] == labels] = _LOW
                        for r, window in enumerate(windows):
                            of = a.scores[part, r, None]
                            # Floors of whole numbers: negative * 100 <= positive * ceiling, and so on.
                            open_ = (of > _LOW) & (score <= of * ceiling // 100) & (score >= -(-of * floor // 100))
                            window.offer(low, np.where(open_, score, _LOW), ids)
        for a, windows in zip(sent.value, best):
            found = [np.concatenate(x) for x in zip(*(w.all() for w in windows))]
            place, score, id = np.unique(np.stack(found, 1), axis=0).T if len(found[0]) else found
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[place]), packed(a.ids[place], score, 1, id)], names=["anchor", "key"])
    return run


def sorted_pairs(pairs: DataFrame) -> DataFrame:
    """Each anchor's keys in one partition, in order, copies next to each other."""
    return pairs.repartition("anchor").sortWithinPartitions("key").select("key")


def _first(k: int):
    """The first ``k`` keys of each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, n = None, 0
        for batch in batches:
            out = []
            for a, score, _, id in zip(*unpacked(batch.column("key"))):
                anchor, n = a, n + 1 if a == anchor else 1
                if n <= k:
                    out.append((a, n, id, score))
            yield _batch(out, ["anchor", "rank", "id", "score"])
    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


_MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def _mine(k: int, floor: int, ceiling: int):
    """Reads keys in order; positives open windows, negatives fill them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows, waiting, at = None, [], [], None
        for batch in batches:
            out = []
            for a, score, kind, id in zip(*unpacked(batch.column("key"))):
                if a != anchor:
                    anchor, windows = a, []
                if kind == 0:
                    windows.append([id, score, 0])  # a positive comes before negatives of its score
                    continue
                for window in windows:
                    positive, best, n = window
                    if n < k and floor * best <= 100 * score <= ceiling * best:
                        window[2] += 1
                        out.append((a, positive, n + 1, id, best, score))
                windows = [w for w in windows if w[2] < k and 100 * score >= floor * w[1]]
            yield _batch(out, _MINED)
    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, floor: int = FLOOR, ceiling: int = CEILING,
                   anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``id``. A score is the inner product of components floor(256 x), exact; rows
    of another length of vector than the anchor's have none with it. Higher scores first, ties to the
    smaller id. An anchor's positives are its first other rows of its label; each is given its first
    rows of other labels that score ``floor`` to ``ceiling`` per cent of it (at most 100). Rows without id,
    label or vector, or with a component that is NULL or not finite, take no part; of rows of one id
    the smallest label, then vector, counts. Anchors without positives, and positives without
    negatives, give no rows.
    """
    if not 0 <= floor <= ceiling <= 100:
        raise ValueError("a negative scores no more than its positive")
    spark = rows.sparkSession
    used = durable(usable(rows, id, vector, label))
    asked = durable(used.withColumn(id, F.col("id")).filter(is_anchor).select("id", "label", "v"))
    parts = max(1, -(-asked.count() // anchors))

    def sent(k: int, found: DataFrame | None = None):
        """A part of the anchors, with their positives, in every task; about ``anchors`` of them."""
        of = F.pmod(F.xxhash64("id"), F.lit(parts)) == k
        known: dict[int, list[int]] = {}
        if found is not None:
            known_rows = found.filter(F.pmod(F.xxhash64("anchor"), F.lit(parts)) == k).select("anchor", "score").toArrow()
            known_rows = known_rows.sort_by([("anchor", "ascending"), ("score", "descending")])
            for a, score in zip(*(known_rows.column(c).to_pylist() for c in ("anchor", "score"))):
                known.setdefault(a, []).append(score)
        blocks = asked.filter(of).toArrow().combine_chunks().to_batches()
        made = [Anchors(*m, known, positives) for b in blocks for m in _matrices(b)]
        return spark.sparkContext.broadcast(made)

    def every(work, found: DataFrame | None = None) -> DataFrame:
        keys = [used.mapInArrow(work(sent(k, found)), "anchor long, key binary") for k in range(parts)]
        return reduce(DataFrame.unionByName, keys)

    good = durable(sorted_pairs(every(lambda s: _positives(s, positives))).mapInArrow(
        _first(positives), "anchor long, rank long, id long, score long"))
    bad = every(lambda s: _negatives(s, negatives, floor, ceiling), good)
    opened = good.select("anchor", "id", "score").mapInArrow(_repacked, "anchor long, key binary")
    mined = sorted_pairs(bad.unionByName(opened)).mapInArrow(_mine(negatives, floor, ceiling), ", ".join(f"{c} long" for c in _MINED))
    return mined.withColumn("rank", F.col("rank").cast("int"))


def _repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, id, score = (batch.column(c).to_numpy() for c in ("anchor", "id", "score"))
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), packed(anchor, score, 0, id)], names=["anchor", "key"])
