"""Best-fit packing of tokenised documents into sequences, by matching the large pieces first.

A piece above a third of the capacity shares a sequence with at most one other such piece, so these
are matched greedily, the largest with the largest that still fits. The smaller ones, largest first,
then go to the fullest sequence with room, which is best fit.

What a piece does depends on its length alone, and there are no more lengths than tokens in a
sequence. So the packing is planned for the histogram of lengths, on the driver, in bounded memory;
and every piece finds its place in the plan by its rank among the pieces of its length. The result
is that of packing the whole corpus at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.frames import map_texts, name
from holdfast.llm.words import RAW, Words
from holdfast.scale import durable

CAPACITY = 2048
END = 0
# Words kept by one Python worker: some 40 bytes each. More are forgotten and tokenised again.
CACHED = 500_000
BLOCK = 4 << 20


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if printable, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


class Tokens:
    """Token ids of words between white space, each distinct word tokenised once by a worker.

    The tokenizer must cut at ASCII white space and drop it; then a text's ids are those of its
    words. Letters of ASCII and Latin-1 followed by ASCII marks take a short way: normalising only
    lower-cases them, so the model is asked for the letters and for the marks alone. It is taken
    only if the tokenizer agrees on a set of probes.
    """

    _SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
    _PROBES = "The, HELLO; Straße. ÉTÉ! ñandú... word*** über! a- *** niño?! Çà;"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = {b: c for b, c in _byte_letters().items()}
        self.parts: dict[str, bytes] = {}
        self.short = True
        self.clear()
        self.short = all(self._simple(p) == self._full([p])[0] for p in self._PROBES.split())
        self.parts.clear()

    def clear(self) -> None:
        """Nothing known but the end of a document, at place 0 of the pool."""
        self.hash, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.full(1 << 16, END, np.uint32), 1

    def _full(self, words: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _part(self, part: str, letters: bool) -> bytes:
        known = self.parts.get(part)
        if known is None:
            if letters:
                spelled = "".join(map(self.letters.__getitem__, part.encode()))
                known = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()
            else:
                known = self._full([part])[0]
            if len(self.parts) > 60_000:
                self.parts.clear()
            self.parts[part] = known
        return known

    def _simple(self, word: str) -> bytes | None:
        m = self._SIMPLE.fullmatch(word) if self.short else None
        if not m:
            return None
        head, tail = m.groups()
        return (self._part(head.lower(), True) if head else b"") + (self._part(tail, False) if tail else b"")

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """``hashes`` are sorted and new."""
        ids = [self._simple(w) for w in words]
        rest = [k for k, found in enumerate(ids) if found is None]
        for low in range(0, len(rest), 4096):
            part = rest[low:low + 4096]
            for k, found in zip(part, self._full([words[k] for k in part])):
                ids[k] = found
        count = np.array([len(i) // 4 for i in ids], np.int64)
        new = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(self.used, 2 * len(new)), np.uint32)])
        self.pool[self.used:self.used + len(new)] = new
        start = self.used + np.cumsum(count) - count
        self.used += len(new)
        where = np.searchsorted(self.hash, hashes)
        self.hash, self.at, self.count = (np.insert(old, where, more) for old, more in
                                          ((self.hash, hashes), (self.at, start), (self.count, count)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END; and the offsets of the texts in them."""
        w = Words(column, RAW)
        if len(self.hash) > CACHED:
            self.clear()
        distinct, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hash, distinct), max(0, len(self.hash) - 1))
        new = self.hash[at] != distinct if len(self.hash) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(distinct[new], [w.bytes(k).decode() for k in first[new].tolist()])
            at = np.searchsorted(self.hash, distinct)
        ends = w.first[1:]
        count = np.insert(self.count[at][which], ends, 1)
        start = np.insert(self.at[at][which], ends, 0)
        before = np.cumsum(count)
        ids = self.pool[np.repeat(start - before + count, count) + np.arange(before[-1] if len(before) else 0)]
        return ids, np.concatenate([[0], before[ends + np.arange(len(ends))]])


_LOADED: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def _pieces(docs: DataFrame, text: str, keep: Sequence[str], path: str, capacity: int) -> DataFrame:
    def work(column: pa.Array):
        ids, border = tokens(path).encode(column)
        ids = ids.astype("<u4", copy=False)
        lengths, sums = [], []
        for low, high in zip(border[:-1].tolist(), border[1:].tolist()):
            cuts = [*range(low, high, capacity), high]
            lengths.append([b - a for a, b in zip(cuts, cuts[1:])])
            sums.append([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])])
        return [pa.array(lengths, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.int64()))]

    cut = map_texts(docs, text, keep, "_lengths array<bigint>, _sums array<bigint>", work, BLOCK)
    kept = [name(c) for c in cut.columns if c not in ("_lengths", "_sums")]
    return cut.select(*kept, F.posexplode(F.arrays_zip("_lengths", "_sums")).alias("piece", "_p")).select(
        *kept, "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("_p._lengths").alias("length"),
        F.col("_p._sums").alias("ids_crc32"))


class Range(NamedTuple):
    """``n`` pieces of one length, from rank ``first`` on: ``each`` to a sequence, from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    n: int
    sequence: int
    each: int
    offset: int


def plan(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[Range]:
    """Where the pieces of each length go. Time and memory depend on the capacity, not on the counts."""
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] += n
    given = [0] * (capacity + 1)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: sequences (first, how many)
    out: list[Range] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        out.append(Range(length, given[length], n, sequence, each, offset))
        given[length] += n
        left[length] -= n

    third = capacity // 3
    for large in range(capacity, third, -1):
        partner = min(large, capacity - large)
        while left[large]:
            while partner > third and not left[partner]:
                partner -= 1
            n = left[large]
            if partner > third:
                n = min(n, left[partner]) if partner != large else n // 2
            if partner > third and n:
                put(large, n, sequences, 1, 0)
                put(partner, n, sequences, 1, large)
                gaps[capacity - large - partner].append((sequences, n))
            else:
                if partner > third:  # one is left over with itself: look further down
                    partner -= 1
                    continue
                n = left[large]
                put(large, n, sequences, 1, 0)
                gaps[capacity - large].append((sequences, n))
            sequences += n
    for small in range(min(third, capacity), 0, -1):
        room = small
        while left[small]:
            while room <= capacity and not gaps[room]:
                room += 1
            if room > capacity:
                room = capacity
                n = -(-left[small] // (capacity // small))
                gaps[capacity].append((sequences, n))
                sequences += n
            first, n = gaps[room].pop()
            each = room // small
            full = min(n, left[small] // each)
            if full:
                put(small, full * each, first, each, capacity - room)
                gaps[room - each * small].append((first, full))
            if full < n:
                rest = left[small]
                if rest:  # fewer than would fill one more
                    put(small, rest, first + full, rest, capacity - room)
                    gaps[room - rest * small].append((first + full, 1))
                    full += 1
                if full < n:
                    gaps[room].append((first + full, n - full))
    return out


def packed(docs: DataFrame, path: str, keep: Sequence[str], text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: ``keep``, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is a document, repeated rows too. A NULL or empty text is the end token
    alone. No documents, no pieces. Which of equal pieces takes which place is any choice, but one
    that stays: the pieces are written before they are ranked. A kept column named as a result gives way.
    """
    made = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    cut = _pieces(docs, text, [c for c in keep if c not in made], path, capacity)
    pieces = durable(cut.withColumn("_part", F.spark_partition_id()).withColumn("_uid", F.monotonically_increasing_id()))
    # The rank in a length: that in the part it was written in, after those of earlier parts. So a
    # length that a third of all pieces have is never in one task.
    counts = pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    local = Window.partitionBy("length", "_part").orderBy("_uid")
    ranked = (pieces.withColumn("_at", F.row_number().over(local) - 1)
              .join(before, ["length", "_part"]).withColumn("_at", F.col("_at") + F.col("_before")))
    ranges = docs.sparkSession.createDataFrame(
        plan(histogram, capacity), "_length long, _first long, _n long, _sequence long, _each long, _offset long")
    inside = ((F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_first"))
              & (F.col("_at") < F.col("_first") + F.col("_n")))
    nth = F.col("_at") - F.col("_first")
    return ranked.join(F.broadcast(ranges), inside).select(
        *[name(c) for c in cut.columns],
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_each") * F.col("length")).alias("offset"))
