"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is ``window`` consecutive words of an item (a shorter item is one window). Its shingles,
``shingle`` consecutive words each, are ordered by rarity over all documents. A document that holds
at least a share ``threshold`` of the window's shingles in place must hold one of the rarest
m - ceil(threshold * m) + 1 of them, so only those, the prefix, are looked up. The place of the
shingle in the window fixes where the window would lie; it must lie inside the document (length and
position bounds), and the item-sized window there is verified word for word.

The index of windows is broadcast, ``WINDOWS`` rows at most at a time; a larger benchmark is matched
in several passes over the documents, never cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.frames import map_texts, name
from holdfast.llm.words import PLAIN, TABLES, Words, at_grams, blocks, grams
from holdfast.scale import durable

WINDOW = 10
SHINGLE = 5
# Rows (window, item) of one broadcast index: some 200 bytes each, 50 MB.
WINDOWS = 250_000
_HITS = "n_words long, runs array<int>, items array<string>"


def windows_of(items: DataFrame, id: str, text: str, window: int = WINDOW) -> DataFrame:
    """(words, item): the distinct windows of every item. Items without id, text or words have none."""
    source = items.filter(name(id).isNotNull() & name(text).isNotNull()).select(
        name(id).cast("string").alias("item"), name(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            w = Words(block.column("text"), PLAIN, hashed=False)
            clean = TABLES[PLAIN][w.raw]
            ids = block.column("item").to_pylist()
            for row, (low, high) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                words = [clean[a:b].tobytes().decode() for a, b in zip(w.start[low:high], w.end[low:high])]
                if words:
                    found = list({" ".join(words[k:k + window]) for k in range(max(1, len(words) - window + 1))})
                    for at in range(0, len(found), 4096):
                        part = found[at:at + 4096]
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([ids[row]] * len(part))],
                                                         names=["words", "item"])

    return source.mapInArrow(cut, "words string, item string").distinct()


class Index:
    """Windows of a benchmark by the hash of a prefix shingle; small enough to be sent to every task."""

    def __init__(self, rows: list[tuple[str, str]], shingle: int, threshold: float):
        owners: dict[str, set[str]] = {}
        for words, item in rows:
            owners.setdefault(words, set()).add(item)
        self.words = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.words]
        column = pa.array(self.words, pa.string())
        w = Words(column, PLAIN)
        self.length = w.counts
        self.size = np.minimum(self.length, shingle)
        self.count = self.length - self.size + 1
        self.need = np.maximum(1, np.ceil(threshold * self.count - 1e-9).astype(np.int64))
        by_size = {s: grams(w.hash, s) for s in sorted(set(self.size.tolist()))}
        # Every shingle of every window: its hash, its window and its place in it.
        self.window = np.repeat(np.arange(len(self.words)), self.count)
        self.border = np.concatenate([[0], np.cumsum(self.count)])
        self.place = np.arange(len(self.window)) - self.border[self.window]
        self.shingle = np.zeros(len(self.window), np.uint64)
        for s, g in by_size.items():
            rows_ = self.size[self.window] == s
            self.shingle[rows_] = g[(w.first[:-1][self.window] + self.place)[rows_]]
        self.exact = threshold >= 1

    def vocabulary(self) -> dict[int, np.ndarray]:
        """The distinct shingles, by their number of words, sorted."""
        size = self.size[self.window]
        return {int(s): np.unique(self.shingle[size == s]) for s in np.unique(size)}

    def choose(self, seen: dict[int, int]) -> None:
        """Keep the prefix: of each window, the rarest shingles, as many as one of must be there."""
        often = np.array([seen.get(h, 0) for h in self.shingle.astype(np.int64).tolist()], np.int64)
        order = np.lexsort((self.place, often, self.window))
        rank = np.arange(len(order)) - self.border[self.window[order]]
        kept = order[rank < (self.count - self.need + 1)[self.window[order]]]
        self.prefix = {}
        for s in np.unique(self.size):
            mine = kept[self.size[self.window[kept]] == s]
            mine = mine[np.argsort(self.shingle[mine], kind="stable")]
            self.prefix[int(s)] = (self.shingle[mine], self.window[mine], self.place[mine])


def _lookup(keys: np.ndarray):
    """Places of an array whose value is among the sorted ``keys``; a bit table sorts out most."""
    bits = max(16, int(len(keys)).bit_length() + 5)
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[keys >> shift] = True

    def places(values: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(table[values >> shift])
        at = np.minimum(np.searchsorted(keys, values[maybe]), len(keys) - 1)
        return maybe[keys[at] == values[maybe]]

    return places


def _seen(docs: DataFrame, text: str, vocabulary: dict[int, np.ndarray]) -> dict[int, int]:
    """How often each shingle of the index occurs in all documents: one pass, summed in each task."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {s: (_lookup(keys), keys, np.zeros(len(keys), np.int64)) for s, keys in sent.value.items()}
        for block in blocks(batches):
            w = Words(block.column("text"), PLAIN)
            for s, (places, keys, total) in found.items():
                g = grams(w.hash, s)
                np.add.at(total, np.searchsorted(keys, g[places(g)]), 1)
        for _, keys, total in found.values():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].astype(np.int64)), pa.array(total[some])],
                                             names=["shingle", "n"])

    counted = docs.select(name(text).cast("string").alias("text")).mapInArrow(count, "shingle long, n long")
    return {r["shingle"]: r["n"] for r in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}


def match_block(index: Index, lookups: dict, column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The block's words; and of every verified window its document's row, first word and number."""
    w = Words(column, PLAIN)
    row_of = w.row()
    rows, starts, numbers = [], [], []
    for s, (keys, window, place) in index.prefix.items():
        g = grams(w.hash, s)
        at = lookups[s](g)
        low, high = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
        # In slices: a shingle that many windows and places share must not make one huge array.
        for a, b in _slices(high - low, 1 << 20):
            times = (high - low)[a:b]
            entry = np.repeat(low[a:b], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            number = window[entry]
            start = np.repeat(at[a:b], times) - place[entry]
            row = np.repeat(row_of[at[a:b]], times)
            fits = (start >= w.first[row]) & (start + index.length[number] <= w.first[row + 1])
            number, start, row = number[fits], start[fits], row[fits]
            same = np.zeros(len(start), np.int64)
            for k in range(int(index.count[number].max()) if len(number) else 0):
                has = np.flatnonzero(k < index.count[number])
                same[has] += at_grams(w.hash, start[has] + k, s) == index.shingle[index.border[number[has]] + k]
            good = same >= index.need[number]
            rows.append(row[good]), starts.append(start[good]), numbers.append(number[good])
    if not rows:
        none = np.zeros(0, np.int64)
        return w, none, none, none
    found = np.unique(np.stack([np.concatenate(rows), np.concatenate(starts), np.concatenate(numbers)]), axis=1)
    if index.exact and found.shape[1]:
        def spelled(start, number):
            words = [TABLES[PLAIN][w.raw[w.start[k]:w.end[k]]].tobytes() for k in range(start, start + index.length[number])]
            return b" ".join(words).decode() == index.words[number]
        found = found[:, [spelled(a, b) for a, b in zip(found[1].tolist(), found[2].tolist())]]
    return w, *found


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Disjoint runs that cover the same words, as start, end, start, end ..."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return np.stack([start[new], reach[np.concatenate([new[1:], [True]])]], axis=1).ravel()


def _match(docs: DataFrame, text: str, keep: list[str], index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    cache: dict = {}

    def work(column: pa.Array):
        index = sent.value
        if not cache:
            cache.update({s: _lookup(keys) for s, (keys, *_) in index.prefix.items()})
        w, row, start, number = match_block(index, cache, column)
        runs, items = [None] * len(column), [None] * len(column)
        border = np.searchsorted(row, np.arange(len(column) + 1))
        for r in np.unique(row):
            mine = slice(border[r], border[r + 1])
            first = start[mine] - w.first[r]
            runs[r] = _merged(first, first + index.length[number[mine]])
            items[r] = sorted({i for n in np.unique(number[mine]) for i in index.owners[n]})
        return [pa.array(w.counts), pa.array(runs, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]

    return map_texts(docs, text, keep, _HITS, work)


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                  threshold: float = 1.0, windows_at_once: int = WINDOWS) -> DataFrame:
    """``keep`` of each document, ``n_words``, ``n_hit``, ``runs`` of hit words and ``items`` found.

    One row for each row of ``docs``, repeated rows too. NULL and empty texts have no words and no
    hits; an empty benchmark hits nothing. Items without id or text take no part; rows of one item
    count as one item. ``runs`` are word positions, first and end, one after the other.
    """
    windows = durable(windows_of(items, id, item_text, window))
    rows = windows.count()
    passes = max(1, math.ceil(rows / windows_at_once))
    out = docs
    carried = list(keep)
    for k in range(passes):
        part = windows if passes == 1 else windows.filter(
            F.pmod(F.xxhash64("words"), F.lit(passes)) == k)
        index = Index([tuple(r) for r in part.select("words", "item").collect()], shingle, threshold)
        index.choose(_seen(docs, text, index.vocabulary()) if index.words else {})
        last = k == passes - 1
        out = _match(out, text, carried if last else [*carried, text], index)
        if not last:
            out = durable(out.withColumnsRenamed({"runs": f"_runs{k}", "items": f"_items{k}"}).drop("n_words"))
            carried += [f"_runs{k}", f"_items{k}"]
    old = range(passes - 1)
    none_run, none_item = F.array().cast("array<int>"), F.array().cast("array<string>")
    runs = F.concat(*[F.coalesce(c, none_run) for c in [F.col("runs"), *[F.col(f"_runs{k}") for k in old]]])
    found = F.array_sort(F.array_distinct(F.concat(
        *[F.coalesce(c, none_item) for c in [F.col("items"), *[F.col(f"_items{k}") for k in old]]])))
    if passes > 1:
        runs = _union(runs)
    kept = [c for c in keep if c not in ("n_words", "n_hit", "runs", "items")]
    hit = F.aggregate(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(1)), F.lit(0).cast("long"),
                      lambda total, i: total + F.when(i % 2 == 1, F.col("runs")[i]).otherwise(-F.col("runs")[i]))
    done = out.select(*[name(c) for c in kept], "n_words", runs.alias("runs"), found.alias("items"))
    return done.select(*[name(c) for c in kept], "n_words",
                       F.when(F.size("runs") > 0, hit).otherwise(F.lit(0).cast("long")).alias("n_hit"), "runs", "items")


def _union(runs):
    """Runs of several passes as disjoint runs again."""
    pairs = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(runs) - 1, F.lit(0))),
                                              lambda i: (i % 2 == 0) & (i < F.size(runs))),
                                     lambda i: F.struct(runs[i].alias("a"), runs[i + 1].alias("b"))))
    empty = F.array().cast("array<int>")

    def add(out, pair):
        last = F.element_at(out, -1)
        return (F.when(F.size(out) == 0, F.array(pair["a"], pair["b"]))
                .when(pair["a"] > last, F.concat(out, F.array(pair["a"], pair["b"])))
                .otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(last, pair["b"])))))

    return F.aggregate(pairs, empty, add)
