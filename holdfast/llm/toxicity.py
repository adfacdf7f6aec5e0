"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are 64-bit hashes: words, their first letters (a crude stem), pairs of neighbours, and pairs
with one word between. A text has a feature or not. Per-coordinate rates let rare features learn
fast, and L1 keeps all but the telling ones at zero.

Learning takes two steps over a bounded sample of labelled rows. First, shards of the sample are
learnt side by side, over 2**22 buckets, only to see which features come out with a weight at all.
Then the same algorithm runs over the whole sample with those few features, which is small. The model
is the list of hashes with a weight, so no unseen word shares a bucket with a telling one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.frames import map_texts, name
from holdfast.llm.words import PLAIN, Words, blocks, mix
from holdfast.scale import durable

# Bound of the sample: rows of each label. Chosen by a hash of the id, the same on every run.
ROWS_PER_LABEL = 10_000
# Rows of a shard, which one task learns from.
SHARD_ROWS = 2_500
# Features in at least so many texts of a shard or, in the end, of the sample may get a weight.
LEAST_TEXTS = 3
# Features that the second step may start from, and so the bound of the model: 16 bytes each.
FEATURES = 1 << 16
STEMS = (4, 5, 6)
BUCKETS = 1 << 22


class Rates(NamedTuple):
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0
    epochs: int = 10


class Model(NamedTuple):
    """Sorted 64-bit feature hashes, their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of a block, a pair for each occurrence. Pairs of words stay within their row."""
    w = Words(column, PLAIN, stems=STEMS)
    row = w.row()
    rows, found = [row], [w.hash]
    for stem in w.stem.values():
        has = np.flatnonzero(stem)
        rows.append(row[has]), found.append(stem[has])
    for gap in (1, 2):
        same = np.flatnonzero(row[gap:] == row[:-gap])
        rows.append(row[same])
        found.append(mix(w.hash[same] * np.uint64(2 * gap + 1) + w.hash[same + gap] * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(rows), np.concatenate(found)


def _by_row(row: np.ndarray, feature: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct features of each of n rows."""
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    row, feature = row[new], feature[new]
    return np.split(feature, np.searchsorted(row, np.arange(1, n)))


def ftrl(texts: Sequence[np.ndarray], labels: Sequence[int], size: int, rates: Rates) -> np.ndarray:
    """Weights of ``size`` coordinates, of which coordinate 0 is the bias and bears no L1.

    ``texts`` are the coordinates present in each example. The order of examples is shuffled with a
    fixed seed in every epoch.
    """
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * rates.l1) / ((rates.beta + np.sqrt(ns)) / rates.alpha + rates.l2)
        return np.where(np.abs(zs) <= rates.l1, 0.0, w)

    def bias():
        return -z[0] / ((rates.beta + np.sqrt(n[0])) / rates.alpha)

    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(rates.epochs):
        for k in rng.permutation(len(texts)):
            at = texts[k]
            w, b = weights(at), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - labels[k]
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / rates.alpha * w
            n[at] += g * g
            z[0] += g - (np.sqrt(n[0] + g * g) - np.sqrt(n[0])) / rates.alpha * b
            n[0] += g * g
    out = np.zeros(size)
    for low in range(0, size, 1 << 16):  # in slices, as its steps take several arrays of the same length
        out[low:low + (1 << 16)] = weights(slice(low, low + (1 << 16)))
    out[0] = bias()
    return out


def _screen(rates: Rates):
    """Per shard: the features that get a weight in it, with the number of texts that have them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for block in blocks(batches):
            texts += _by_row(*features(block.column("text")), block.num_rows)
            labels += block.column("label").to_pylist()
        if not texts or len(set(labels)) < 2:
            return
        order = sorted(range(len(texts)), key=lambda k: (labels[k], texts[k].tobytes()))
        texts, labels = [texts[k] for k in order], [labels[k] for k in order]
        buckets = [1 + np.unique(t >> np.uint64(42)).astype(np.int64) for t in texts]
        kept = ftrl(buckets, labels, BUCKETS + 1, rates) != 0
        kept[0] = False
        live = [t[kept[1 + (t >> np.uint64(42)).astype(np.int64)]] for t in texts]
        found, n = np.unique(np.concatenate(live), return_counts=True)
        found, n = found[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS]
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["feature", "n"])
    return run


def fold(id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit(""))), F.lit(parts))


def training_rows(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
                  rows_per_label: int = ROWS_PER_LABEL, left_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """(text, label, shard key): of labelled ids outside one fold, about ``rows_per_label`` of each label.

    Ids are drawn by their hash, the same on every run. An id counts once for each label it bears; of
    several texts of an id the largest is taken. Ids without text, or labels other than 0 and 1, are
    left out.
    """
    parts, out = left_out
    marked = (labels.filter(name(id).isNotNull() & name(label).isin(0, 1) & (fold(name(id), parts) != out))
              .select(name(id).alias("id"), name(label).cast("int").alias("label")).distinct())
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    million = 1_000_000
    bound = F.lit(0)
    for value, n in counts.items():
        bound = F.when(F.col("label") == value, F.lit(int(million * min(1.0, rows_per_label / n)))).otherwise(bound)
    drawn = marked.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(million)) < bound)
    texts = docs.filter(name(text).isNotNull()).select(name(id).alias("id"), name(text).cast("string").alias("text"))
    return (texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
            .select("text", "label", F.xxhash64("id", F.lit(2)).alias("shard")))


def fit(rows: DataFrame, rates: Rates = Rates()) -> Model:
    """The model of a bounded sample (text, label, shard). Without both labels there are no weights."""
    spark = rows.sparkSession
    rows = durable(rows)
    n, share = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    none = np.zeros(0, np.uint64)
    if share in (None, 0.0, 1.0):
        return Model(none, np.zeros(0), -35.0 if not share else 35.0)
    shards = rows.repartition(max(1, round(n / SHARD_ROWS)), "shard").select("text", "label")
    screened = (shards.mapInArrow(_screen(rates), "feature long, n long").groupBy("feature")
                .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "feature").limit(FEATURES))
    keys = np.sort(np.array([r[0] for r in screened.select("feature").collect()], np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(keys)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = _by_row(*_known(sent.value, *features(block.column("text"))), block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("label"), pa.array(
                [t.astype(np.int32) for t in texts], pa.list_(pa.int32()))], names=["label", "at"])

    # Every text is now a short list of places, sorted so that the order of learning does not vary.
    table = shards.mapInArrow(known, "label int, at array<int>").toArrow()
    places = table.column("at").combine_chunks()
    border, flat = places.offsets.to_numpy(), places.values.to_numpy().astype(np.int64) + 1
    texts = [flat[a:b] for a, b in zip(border, border[1:])]
    labels = table.column("label").to_pylist()
    order = sorted(range(len(texts)), key=lambda k: (labels[k], texts[k].tobytes()))
    weights = ftrl([texts[k] for k in order], [labels[k] for k in order], len(keys) + 1, rates)
    some = np.flatnonzero(weights[1:])
    return Model(keys[some], weights[1:][some], float(weights[0]))


def _known(keys: np.ndarray, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose feature is in ``keys``, as (row, place in keys)."""
    if not len(keys):
        return row[:0], np.zeros(0, np.int64)
    table = np.zeros(1 << 20, bool)
    table[keys >> np.uint64(44)] = True
    maybe = np.flatnonzero(table[feature >> np.uint64(44)])
    at = np.minimum(np.searchsorted(keys, feature[maybe]), len(keys) - 1)
    real = keys[at] == feature[maybe]
    return row[maybe[real]], at[real]


def toxicity(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` of each row and ``score``, 0 to 1. NULL and empty texts get that of no feature at all."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array):
        model = sent.value
        row, at = _known(model.keys, *features(column))
        pairs = np.unique(row * (len(model.keys) + 1) + at)
        row, at = pairs // (len(model.keys) + 1), pairs % (len(model.keys) + 1)
        total = np.bincount(row, model.weights[at], len(column)) + model.bias
        return [pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))]

    return map_texts(docs, text, keep, "score double", work)
