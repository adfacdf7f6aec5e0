"""Language-model scoring with an Elias-Fano n-gram trie.

All training texts are counted: every word, then all pairs and triples, of which those with a count of
``LEAST`` make the model. Its commonest words, pairs and triples are in the trie, which holds, for each known
word, its successors, and for each pair the words that follow it; pointers and children are monotone and
stored as Elias-Fano sequences. The child of a pair (a, b) is not stored as a word but by its place
among the successors of b, which is the smaller number: a triple is found by looking up the pair
(b, c), taking its place relative to b, and searching that among the children of (a, b).

Probabilities are discounted absolutely and back off to the next shorter context; they and the
back-off weights are quantised to 256 values a level. A word alone has the base probability, which is
exact, for known and unknown words alike. The levels lie in one file that every executor gets once and
its workers map into memory.

The log probability of a text is a sum over its words, pairs and triples, so what the trie has no room for
is a table of one weight an n-gram: a text adds those of its n-grams by a join. Back-off weights, in the trie
and beside it, are those of the whole model. A bit table of bounded size tells tasks which n-grams cannot be in
the table; it spares rows and decides nothing.

N-grams are counted, weighted and asked for in parts: an n-gram's key starts with a hash of its context, and a
part is a range of keys. Spark deals the n-grams out to as many parts as the words ask for, a block of texts as one
row a part whose columns are packed numbers (``_chunks``), so that a part's task works on arrays (``_parts``).
Whatever shares a context that is not among the commonest words is in one part; what starts with a common word is
dealt by its first two words, and what is summed over a common word is summed over the parts.

The counts of all distinct words go into a second file, 5 bytes a word, while they are at most
``WORDS``; beyond that, unknown words are looked up by a join, and nothing else changes.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.eliasfano import EliasFano
from holdfast.llm.frames import name, schema
from holdfast.llm.words import LOWER, Words, blocks
from holdfast.scale import checkpoint_folder, durable, skew_join

# Sizes of the trie, chosen by frequency from counts over all training texts: known words, and
# n-grams of each longer length. They bound what every executor maps, not the model.
KNOWN = 1 << 16
GRAMS = 1 << 20
LEAST = 2
DISCOUNT = 0.75
# Distinct words whose counts are sent to every executor, 5 bytes each.
WORDS = 16_000_000
BLOCK = 8 << 20
# Bits for each n-gram beside the trie, and the most of them, as a power of 2.
BITS, TOP_BITS = 16, 30
# Training tokens for each part of the n-grams.
PART = 2_000_000
#: Stands for the end of a text among word hashes, and before its first word.
END = np.uint64(0x0123456789ABCDEF)
_TOP, _LOW = 22, 32


def streams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an END before each and one after the last; and the row borders.

    Row r has the tokens from ``first[r] + 1`` to ``first[r + 1]``, its end included.
    """
    w = Words(column, LOWER)
    hashes = np.insert(w.hash, w.first, END)
    return hashes, w.first + np.arange(len(w.first))


def _written(df: DataFrame) -> DataFrame:
    """``durable``, after which the shuffle files of the written rows are let go: no step needs them again."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return durable(df)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _counted(source: DataFrame, make) -> DataFrame:
    """(key, n): counts of the 64-bit keys that ``make`` finds in a block of texts, over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for block in blocks(batches, limit=BLOCK):
            keys, n = np.unique(find(block.column("text")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["key", "n"])

    return source.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _mixed(*ids: np.ndarray) -> np.ndarray:
    """64 bits of one, two or three ids, alike for every row of the same ids."""
    h = np.full(len(ids[0]), len(ids), np.uint64)
    for x in ids:
        h = (h ^ x.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _routed(*ids: np.ndarray) -> np.ndarray:
    """Keys of n-grams. The top 16 bits, by which they are dealt, are of the first word, or of the first two
    where the first is known: a common word's n-grams are too many for one part."""
    route = _mixed(ids[0])
    if len(ids) > 1:
        route = np.where(ids[0] < 0, route, _mixed(ids[0], ids[1]))
    return (route >> np.uint64(48) << np.uint64(48)) | (_mixed(*ids) >> np.uint64(16))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, which is a range of keys."""
    return ((keys >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.uint16)


# What a row of packed columns holds, and the types of its columns: n-grams and counts; pairs with the counts of
# their words; triples with the probability of their last two words; weights by key; pairs and triples of the
# trie; keys that rows ask for; sums that rows get. The halves of a row number are packed apart.
GRAMS2, GRAMS3, PAIRS, TRIPLES, WEIGHTS, TOP2, TOP3, ASKED, SUMS = range(9)
_TYPES = {GRAMS2: ("<i8", "<i8", "<i8"), GRAMS3: ("<i8",) * 4, PAIRS: ("<i8",) * 5, TRIPLES: ("<i8", "<i8", "<i8", "<i8", "<f8"),
          WEIGHTS: ("<u8", "<f4"), TOP2: ("<i8", "<i8", "<i8", "<f4"), TOP3: ("<i8",) * 4,
          ASKED: ("<u8", "<u4", "<i4"), SUMS: ("<u4", "<i4", "<f4")}
_COLUMNS = "abcde"
_CHUNKS = "part int, kind int, " + ", ".join(f"{c} binary" for c in _COLUMNS)


def _chunks(part: np.ndarray, kind: int, columns: Sequence[np.ndarray]) -> pa.RecordBatch:
    """Numbers dealt out: one row for each part that gets any, with its share of each column as bytes."""
    order = np.argsort(part, kind="stable")
    which, at = np.unique(part[order], return_index=True)
    at = np.append(at, len(part))
    bodies = []
    for c, t in zip(columns, _TYPES[kind], strict=True):
        c = c[order].astype(t, copy=False)
        bodies.append(pa.array([c[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()))
    bodies += [pa.nulls(len(which), pa.binary())] * (len(_COLUMNS) - len(bodies))
    return pa.RecordBatch.from_arrays(
        [pa.array(which.astype(np.int32)), pa.array(np.full(len(which), kind, np.int32)), *bodies], names=["part", "kind", *_COLUMNS])


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "part").sortWithinPartitions("part")


def _summed(columns: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Distinct n-grams and the sums of their counts, which are the last column."""
    *ids, n = columns
    if not len(n):
        return list(columns)
    key = _mixed(*ids)
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [*[x[order[start]] for x in ids], np.add.reduceat(n[order], start)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[np.ndarray]]]]:
    """The columns of each kind of a part, part by part, of rows sorted by part.

    N-grams are summed up as they come, so a part's memory depends on its distinct ones.
    """
    def joined(pieces: list, kind: int) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*pieces)]
        return _summed(columns) if kind in (GRAMS2, GRAMS3) else columns

    def empty() -> tuple[dict, dict, dict]:
        return defaultdict(list), defaultdict(int), defaultdict(int)

    part, (held, size, least) = None, empty()
    for batch in batches:
        columns = [batch.column(c) for c in _COLUMNS]
        for i, (p, kind) in enumerate(zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist())):
            if p != part:
                if held:
                    yield part, {k: joined(pieces, k) for k, pieces in held.items()}
                part, (held, size, least) = p, empty()
            held[kind].append([np.frombuffer(c[i].as_buffer(), t) for c, t in zip(columns, _TYPES[kind])])
            size[kind] += len(held[kind][-1][0])
            if kind in (GRAMS2, GRAMS3) and size[kind] > max(PART, 2 * least[kind]):
                held[kind] = [joined(held[kind], kind)]
                size[kind] = least[kind] = len(held[kind][0][0])
    if held:
        yield part, {k: joined(pieces, k) for k, pieces in held.items()}


def _unpacked(df: DataFrame, kind: int) -> list[np.ndarray]:
    """The columns of all rows of a kind, on the driver: for what is bounded."""
    got = df.filter(F.col("kind") == kind).toArrow()
    return [np.concatenate([np.zeros(0, t), *[np.frombuffer(x.as_buffer(), t) for x in got.column(c)]])
            for c, t in zip(_COLUMNS, _TYPES[kind])]


def _grams(source: DataFrame, kind: int, make, parts: int) -> DataFrame:
    """The n-grams of ids that ``make`` finds in a block of texts, counted for some blocks, for the part of their last two words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = make(), []

        def chunks() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            *ids, n = _summed([*columns, np.ones(len(columns[0]), np.int64)])
            return _chunks(_part(_routed(*ids[-2:]), parts), kind, [*ids, n])

        for block in blocks(batches):
            held.append(find(block.column("text")))
            if sum(len(ids[0]) for ids in held) > PART // 2:
                yield chunks()
        if held:
            yield chunks()

    return source.mapInArrow(run, _CHUNKS)


def _let_go(*tables: DataFrame) -> None:
    """Deletes tables that ``_written`` wrote here and no later step reads."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            place = context._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _steps(n: np.ndarray) -> np.ndarray:
    """The bin of each count, in powers of 2**(1/8)."""
    return np.floor(np.log2(n) * 8).astype(np.int64)


def _binned(df: DataFrame, kind: int, count: Callable[[list[np.ndarray]], np.ndarray]) -> list:
    """How many counts, of those that ``count`` picks in the rows of a kind, are in each bin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _parts(batches):
            b, k = np.unique(_steps(count(held[kind])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(k)], names=["b", "k"])

    return df.mapInArrow(run, "b long, k long").groupBy("b").agg(F.sum("k").alias("k")).collect()


def _bound(bins: list, size: int) -> int | None:
    """The lowest bin of counts above which there are about ``size`` keys at most."""
    total, bound = 0, None
    for b, k in sorted(((r["b"], r["k"]) for r in bins), reverse=True):
        if total + k > size and total:
            break
        total, bound = total + k, b
    return bound


def _frequent(counts: DataFrame, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys and their counts, sorted by key: what is known to the trie."""
    level = F.floor(F.log2("n") * 8).cast("int")
    bound = _bound(counts.filter(F.col("n") >= least).groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("k")).collect(), size)
    if bound is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = counts.filter((F.col("n") >= least) & (level >= bound)).toArrow()
    key, n = kept.column("key").to_numpy(), kept.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


class Counts:
    """Counts of distinct words by 54 bits of their hash: 2**22 buckets, and 32 bits and a count in each."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.border, self.low, self.n = parts["border"], parts["low"], parts["n"]
        self.more, self.more_n = parts["more"], parts["more_n"]

    @classmethod
    def build(cls, counts: DataFrame) -> Counts:
        """Each range of hashes is packed by the task that has it; only the packed parts are collected."""
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = batch.column("key").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
                n = batch.column("n").to_numpy()
                bucket = np.unique((u >> np.uint64(64 - _TOP)).astype(np.int32), return_counts=True)
                large = n >= 255
                pieces = [bucket[0], bucket[1].astype(np.int32), (u >> np.uint64(64 - _TOP - _LOW)).astype(np.uint32),
                          np.minimum(n, 255).astype(np.uint8), u[large], n[large].astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(batch.column("key")[0].as_py())], pa.int64()),
                     *[pa.array([x.tobytes()], pa.binary()) for x in pieces]], names=["key", *"abcdef"])

        packed = counts.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(
            pack, "key long, a binary, b binary, c binary, d binary, e binary, f binary").toArrow().sort_by("key")
        got = [np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_py(), kind) for x in packed.column(c)]])
               for c, kind in zip("abcdef", (np.int32, np.int32, np.uint32, np.uint8, np.uint64, np.int64))]
        sizes = np.zeros(1 << _TOP, np.int32)
        np.add.at(sizes, got[0], got[1])
        border = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return cls({"border": border, "low": got[2], "n": got[3], "more": got[4], "more_n": got[5]})

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        u = hashes ^ np.uint64(1 << 63)
        bucket = (u >> np.uint64(64 - _TOP)).astype(np.int64)
        at, stop = self.border[bucket].astype(np.int64), self.border[bucket + 1]
        want = (u >> np.uint64(64 - _TOP - _LOW)).astype(np.uint32)
        out = np.zeros(len(u), np.int64)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            hit = self.low[at[todo]] == want[todo]
            out[todo[hit]] = self.n[at[todo[hit]]]
            at[todo] += 1
            todo = todo[~hit]
            todo = todo[at[todo] < stop[todo]]
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = self.more_n[np.searchsorted(self.more, u[large])]
        return out


class Trie:
    """Levels over known words 0 .. k-1; ``base`` are the log10 probabilities of the words alone."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.words, self.number = parts["words"], parts["number"]
        self.count, self.base, self.back1 = parts["count"], parts["base"], parts["back1"]
        self.pairs, self.heads, self.places, self.triples = (
            EliasFano.over({k.partition(".")[2]: v for k, v in parts.items() if k.startswith(f"{x}.")})
            for x in ("pairs", "heads", "places", "triples"))

    def value(self, level: str, at: np.ndarray) -> np.ndarray:
        """Quantised logarithms of a level at some places."""
        return self.parts[f"{level}.book"][self.parts[f"{level}.code"][at]]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word; -1 for words not known."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.number[at], -1)

    def logs(self, number: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the ones before it; ``unknown`` is that of words not known.

        ``number`` starts with an END; what is returned has one element less. A context does not
        reach beyond an END.
        """
        return self.found(number, unknown)[0]

    def found(self, number: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``logs`` returns, and whether the trie has the pair and the triple that end in each token."""
        size = len(self.base)
        if not size:
            return unknown, np.zeros(len(unknown), bool), np.zeros(len(unknown), bool)
        before, word = number[:-1], number[1:]
        alone = np.where(word >= 0, self.base[np.maximum(word, 0)], unknown)
        out = alone + np.where(before >= 0, self.back1[np.maximum(before, 0)], 0.0)
        pair = np.full(len(word), -1, np.int64)
        both = np.flatnonzero((before >= 0) & (word >= 0))
        pair[both] = self.pairs.index(before[both] * size + word[both])
        has = pair >= 0
        out[has] = self.value("pair", pair[has])
        # The pair before, unless an END stands between the two words of it and this one.
        context = np.concatenate([[-1], np.where(before[1:] != self.end, pair[:-1], -1)])[:len(pair)]
        whole = np.zeros(len(word), bool)
        place = np.flatnonzero(context >= 0)
        j = context[place]
        out[place] += self.value("back2", j)
        full = np.flatnonzero(has[place])
        if len(full) and len(self.triples):
            place, j = place[full], j[full]
            relative = pair[place] - self.heads[before[place]]
            found = self.triples.index(self.places[j] + relative)
            out[place[found >= 0]] = self.value("triple", found[found >= 0])
            whole[place[found >= 0]] = True
        return out, has, whole

    @property
    def end(self) -> int:
        return int(self.parts["end"][0])


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """256 representative values, each the mean of as many neighbours, and the number of each value's."""
    if not len(values):
        return np.zeros(256, np.float32), np.zeros(0, np.uint8)
    order = np.argsort(values, kind="stable")
    code = np.empty(len(values), np.uint8)
    code[order] = np.arange(len(values)) * 256 // len(values)
    n = np.bincount(code, minlength=256)
    return (np.bincount(code, values, 256) / np.maximum(n, 1)).astype(np.float32), code


def build(words: np.ndarray, counts: np.ndarray, base: np.ndarray, end: int,
          pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray],
          backs: tuple[np.ndarray, np.ndarray] | None = None) -> Trie:
    """The trie of known words (hash, count, log10 probability) and kept n-grams.

    ``backs`` are the back-off weights of the words and pairs, where the model has more n-grams than these.

    ``pairs`` are (a * k + b, count), sorted; ``triples`` (pair * k + c, count), sorted, where pair is
    a place in ``pairs`` and the pair (b, c) is there as well.
    """
    k = max(1, len(words))
    order = np.argsort(words)
    key, n = pairs
    a, b = key // k, key % k
    p = (n - DISCOUNT) / counts[a] if len(key) else np.zeros(0)
    if backs is None:
        mass, shorter = np.bincount(a, p, k), np.bincount(a, 10.0 ** base[b] if len(key) else [], k)
        back1 = np.log10(np.maximum(1 - mass, 1e-9) / np.maximum(1 - shorter, 1e-9))
    heads = np.searchsorted(key, np.arange(k + 1) * k)
    degree = np.diff(heads)
    j, c = triples[0] // k, triples[0] % k
    q = (triples[1] - DISCOUNT) / n[j] if len(j) else np.zeros(0)
    suffix = np.searchsorted(key, b[j] * k + c) if len(j) else np.zeros(0, np.int64)
    if backs is None:
        mass2 = np.bincount(j, q, len(key)) if len(key) else np.zeros(0)
        shorter2 = np.bincount(j, p[suffix], len(key)) if len(key) else np.zeros(0)
        back2 = np.log10(np.maximum(1 - mass2, 1e-9) / np.maximum(1 - shorter2, 1e-9))
    else:
        back1, back2 = backs
    places = np.concatenate([[0], np.cumsum(degree[b])]) if len(key) else np.zeros(1, np.int64)
    children = places[j] + suffix - heads[b[j]] if len(j) else np.zeros(0, np.int64)
    parts = {"words": words[order], "number": order, "count": counts.astype(np.int64), "base": base.astype(np.float64),
             "back1": np.zeros(0, np.float32) if not len(words) else back1.astype(np.float32),
             "end": np.array([end], np.int64)}
    for level, values in (("pair", np.log10(p)), ("back2", back2), ("triple", np.log10(q))):
        parts[f"{level}.book"], parts[f"{level}.code"] = _quantised(values)
    for level, values, universe in (("pairs", key, k * k), ("heads", heads, len(key) + 1),
                                    ("places", places, int(places[-1]) + 1), ("triples", children, int(places[-1]) + 1)):
        for part, array in EliasFano(values, universe).parts.items():
            parts[f"{level}.{part}"] = array
    return Trie(parts)


def publish(spark: SparkSession, parts: dict[str, np.ndarray]) -> tuple[str, list]:
    """The arrays as one file in the shared folder, which every executor fetches once. What ``mapped`` needs."""
    index, chunks, at = [], [], 0
    for key, array in parts.items():
        body = np.ascontiguousarray(array).tobytes()
        index.append((key, array.dtype.str, len(array), at))
        body += bytes(-len(body) % 64)
        chunks.append(body)
        at += len(body)
    file = f"{uuid.uuid4().hex}.levels"
    path = f"{checkpoint_folder(spark)}/{file}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    whole = b"".join(chunks)
    for low in range(0, len(whole), 4 << 20):
        out.write(bytearray(whole[low:low + (4 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return file, index


def mapped(file: str, index: list) -> dict[str, np.ndarray]:
    """The arrays of a published file, mapped into memory."""
    whole = np.memmap(SparkFiles.get(file), np.uint8, "r")
    return {key: whole[at:at + n * np.dtype(kind).itemsize].view(kind) if n else np.zeros(0, kind)
            for key, kind, n, at in index}


class Bits:
    """A bit for the top bits of each key of a table: no key of the table is without its bit."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts, self.bits = parts, parts["bits"]
        self.shift = np.uint64(64 - (len(self.bits) * 8).bit_length() + 1)

    @classmethod
    def build(cls, keys: DataFrame, n: int) -> Bits:
        """Each of 64 slices is set by the task that has its keys; the slices are collected, 128 MB in all at most.

        ``key`` is a long, or many keys packed.
        """
        power = min(TOP_BITS, max(16, (BITS * n - 1).bit_length() if n else 0))

        inside = np.uint64((1 << (power - 6)) - 1)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("key")
                for piece in [column.to_numpy()] if pa.types.is_integer(column.type) else [x.as_buffer() for x in column]:
                    at = np.unique(np.frombuffer(piece, np.uint64) >> np.uint64(64 - power))
                    which, first = np.unique(at >> np.uint64(power - 6), return_index=True)
                    own = [x.astype(np.uint32).tobytes() for x in np.split(at & inside, first[1:])][:len(which)]
                    yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array(own, pa.binary())], names=["k", "at"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slices: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, piece in zip(batch.column("k").to_pylist(), batch.column("at")):
                    own = np.frombuffer(piece.as_buffer(), np.uint32)
                    flags = slices.setdefault(k, np.zeros(1 << (power - 9), np.uint8))
                    np.bitwise_or.at(flags, own >> np.uint32(3), (1 << (own & np.uint32(7))).astype(np.uint8))
            for k, flags in slices.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([flags.tobytes()], pa.binary())], names=["k", "flags"])

        dealt = keys.select("key").mapInArrow(cut, "k long, at binary").repartition("k").mapInArrow(pack, "k long, flags binary").toArrow()
        bits = np.zeros((64, 1 << (power - 9)), np.uint8)
        for k, flags in zip(dealt.column("k").to_pylist(), dealt.column("flags")):
            bits[k] = np.frombuffer(flags.as_buffer(), np.uint8)
        return cls({"bits": bits.ravel()})

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Model(NamedTuple):
    """A published trie, and the published counts or, where they are too many, their table.

    ``rest`` has the weight of each n-gram that is not in the trie, in ``parts``; ``bits`` are published for it.
    """

    trie: tuple[str, list]
    counts: tuple[str, list] | None
    table: DataFrame | None
    total: int
    distinct: int
    bits: tuple[str, list] | None = None
    rest: DataFrame | None = None
    parts: int = 1


def _ids(number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of a known word; of others 63 bits of the hash, below zero."""
    return np.where(number >= 0, number, -(hashes >> np.uint64(1)).view(np.int64) - 1)


def _log_left(mass: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(1 - mass, 1e-9) / np.maximum(1 - shorter, 1e-9))


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted keys, and where those are."""
    at = np.searchsorted(keys, wanted)
    found = np.flatnonzero(at < len(keys))
    found = found[keys[at[found]] == wanted[found]]
    return found, at[found]


def fit(texts: DataFrame, text: str = "text", known: int = KNOWN, grams: int = GRAMS, words: int = WORDS,
        least: int = LEAST) -> Model:
    """The model of all rows of ``texts``. NULL and empty texts are an end alone."""
    spark = texts.sparkSession
    source = texts.select(name(text).cast("string").alias("text"))
    table = _written(_counted(source, lambda: lambda column: streams(column)[0][1:]))
    distinct, total = (x or 0 for x in table.agg(F.count(F.lit(1)), F.sum("n")).first())
    key, n = _frequent(table, known, 1)
    if len(key) and not (key == END.astype(np.int64)).any():  # the end is always known
        ends = table.filter(F.col("key") == int(END)).first()
        key, n = np.append(key, int(END)), np.append(n, ends["n"])
    hashes = key.view(np.uint64)
    share = total + 0.5 * (distinct + 1)
    base = np.log10((n + 0.5) / share)
    order = np.argsort(hashes)
    vocabulary = spark.sparkContext.broadcast((hashes[order], order, n))
    end = int(np.flatnonzero(hashes == END)[0]) if len(hashes) else -2
    few = distinct <= words
    counts = publish(spark, Counts.build(table).parts) if few else None
    if few:
        _let_go(table)

    def numbered(h: np.ndarray) -> np.ndarray:
        words_, numbers, _ = vocabulary.value
        if not len(words_):
            return _ids(np.full(len(h), -1, np.int64), h)
        at = np.minimum(np.searchsorted(words_, h), len(words_) - 1)
        return _ids(np.where(words_[at] == h, numbers[at], -1), h)

    def counted(ids: np.ndarray, seen: Counts) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        inside = ids >= 0
        out[inside] = vocabulary.value[2][ids[inside]]
        rare, which = np.unique(ids[~inside], return_inverse=True)
        out[~inside] = seen((-(rare + 1)).view(np.uint64) << np.uint64(1))[which]
        return out

    def frequent(h: np.ndarray, seen: Counts | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and which may be in an n-gram that is counted ``least`` times."""
        ids = numbered(h)
        return ids, np.ones(len(ids), bool) if seen is None else (ids >= 0) | (counted(ids, seen) >= least)

    def pairs():
        seen = Counts(mapped(*counts)) if counts else None

        def find(column: pa.Array) -> list[np.ndarray]:
            ids, may = frequent(streams(column)[0], seen)
            both = may[:-1] & may[1:]
            return [ids[:-1][both], ids[1:][both]]
        return find

    def triples():
        seen = Bits(mapped(*bits))

        def find(column: pa.Array) -> list[np.ndarray]:
            ids = numbered(streams(column)[0])
            pair = seen(_routed(ids[:-1], ids[1:]))
            full = pair[:-1] & pair[1:] & (ids[1:-1] != end)
            return [ids[:-2][full], ids[1:-1][full], ids[2:][full]]
        return find

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbered(batch.column("key").to_numpy().view(np.uint64))), batch.column("n")], names=["id", "c"])

    def sorted_pairs(part: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(_routed(*columns[:2]))
        return _chunks(np.full(len(order), part, np.uint16), PAIRS, [c[order] for c in columns])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counts(mapped(*counts))
        for part, held in _parts(batches):
            x, y, n = (c[held[GRAMS2][2] >= least] for c in held[GRAMS2])
            yield sorted_pairs(part, [x, y, n, counted(x, seen), counted(y, seen)])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c[held[GRAMS2][2] >= least]) for c in held[GRAMS2]], names=["x", "y", "n"])

    def repacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("x", "y", "n", "cx", "cy")]
            yield _chunks(_part(_routed(*columns[:2]), parts), PAIRS, columns)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _parts(batches):
            yield sorted_pairs(part, held[PAIRS])

    parts = min(1 << 16, max(spark.sparkContext.defaultParallelism, math.ceil(total / PART)))
    both = _dealt(_grams(source, GRAMS2, pairs, parts), parts)
    if few:
        two = _written(both.mapInArrow(looked_up, _CHUNKS))
    else:
        each = _written(table.mapInArrow(named, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")))
        rows = joined = _written(both.mapInArrow(plain, "x long, y long, n long"))
        for c in ("x", "y"):
            joined = skew_join(joined, each.withColumnsRenamed({"id": c, "c": f"c{c}"}), c)
        joined = joined.select("x", "y", "n", "cx", "cy").mapInArrow(repacked, _CHUNKS)
        two = _written(_dealt(joined, parts).mapInArrow(merged, _CHUNKS))
        _let_go(each, rows)

    def alone(c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / share

    def keys_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([_routed(*held[PAIRS][:2]).tobytes()], pa.binary())], names=["key"])

    def known_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _parts(batches):
            x, _, n, cx, cy = (c[held[PAIRS][0] >= 0] for c in held[PAIRS])
            x, which = np.unique(x, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x), *[pa.array(np.bincount(which, v, len(x)).astype(float)) for v in ((n - DISCOUNT) / cx, alone(cy))]],
                names=["x", "mass", "shorter"])

    def packed(df: DataFrame, c: str) -> int:
        return int(df.agg(F.sum(F.length(c))).first()[0] or 0) // 8

    bits = publish(spark, Bits.build(two.mapInArrow(keys_of_pairs, "key binary"), packed(two, "a")).parts)
    size = max(1, len(hashes))
    back1 = np.zeros(size)
    got = two.mapInArrow(known_heads, "x long, mass double, shorter double").groupBy("x").agg(
        F.sum("mass").alias("mass"), F.sum("shorter").alias("shorter")).toArrow()
    back1[got.column("x").to_numpy()] = _log_left(got.column("mass").to_numpy(), got.column("shorter").to_numpy())
    backs = spark.sparkContext.broadcast(back1)

    def with_last_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _parts(batches):
            if GRAMS3 in held and PAIRS in held:
                x, y, z, n = (c[held[GRAMS3][3] >= least] for c in held[GRAMS3])
                a, b, ab, ca, _ = held[PAIRS]
                found, at = _places(_routed(a, b), _routed(y, z))
                x, y, z, n = (c[found] for c in (x, y, z, n))
                yield _chunks(_part(_routed(x, y), parts), TRIPLES, [x, y, z, n, (ab[at] - DISCOUNT) / ca[at]])

    three = _written(_dealt(_grams(source, GRAMS3, triples, parts).unionByName(two), parts).mapInArrow(with_last_two, _CHUNKS))

    # What goes into the trie; a triple's pairs are as frequent as it is, so they are there as well.
    def own(columns: Sequence[np.ndarray], n: np.ndarray, low: int | None) -> np.ndarray:
        return np.logical_and.reduce([np.full(len(n), low is not None), *[c >= 0 for c in columns]]) & (_steps(n) >= (low or 0))

    low = _bound(_binned(two, PAIRS, lambda c: c[2][own(c[:2], c[2], 0)]), grams)
    low3 = None if low is None else _bound(_binned(three, TRIPLES, lambda c: c[3][own(c[:3], c[3], low)]), grams)
    high3 = None if low3 is None else max(low, low3)

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _parts(batches):
            def chunk(kind, columns):
                return _chunks(np.full(len(columns[0]), part, np.uint16), kind, columns)

            if PAIRS not in held:
                continue
            x, y, n, cx, cy = held[PAIRS]
            a, b, c, abc, bc = held.get(TRIPLES) or [np.zeros(0, t) for t in _TYPES[TRIPLES]]
            keys = _routed(x, y)
            found, j = _places(keys, _routed(a, b))
            a, b, c, abc, bc = (v[found] for v in (a, b, c, abc, bc))
            q, p = (abc - DISCOUNT) / n[j], (n - DISCOUNT) / cx
            back2 = _log_left(np.bincount(j, q, len(x)), np.bincount(j, bc, len(x)))
            heads, which = np.unique(x, return_inverse=True)
            back = _log_left(np.bincount(which, p, len(heads)), np.bincount(which, alone(cy), len(heads)))
            back[heads >= 0] = backs.value[heads[heads >= 0]]
            w2 = np.log10(p) - np.log10(alone(cy)) - back[which] + np.where(y != end, back2, 0.0)
            w3 = np.log10(q) - np.log10(bc) - back2[j]
            in2, in3 = own((x, y), n, low), own((a, b, c), abc, high3)
            rare = heads < 0
            key = np.concatenate([_routed(heads[rare]), keys[~in2], _routed(a[~in3], b[~in3], c[~in3])])
            order = np.argsort(key)
            yield chunk(WEIGHTS, [key[order], np.concatenate([back[rare], w2[~in2], w3[~in3]])[order]])
            yield chunk(TOP2, [x[in2], y[in2], n[in2], back2[in2]])
            yield chunk(TOP3, [a[in3], b[in3], c[in3], abc[in3]])

    levels = _written(_dealt(three.unionByName(two), parts).mapInArrow(weighted, _CHUNKS))
    _let_go(two, three)
    x, y, pair_n, back2 = _unpacked(levels, TOP2)
    pair = x * size + y
    by = np.argsort(pair)
    pair, pair_n, back2 = pair[by], pair_n[by], back2[by]
    x, y, z, triple_n = _unpacked(levels, TOP3)
    triple = np.searchsorted(pair, x * size + y) * size + z
    by = np.argsort(triple)
    trie = publish(spark, build(hashes, n, base, end, (pair, pair_n), (triple[by], triple_n[by]), (back1, back2)).parts)
    weights = levels.filter(F.col("kind") == WEIGHTS)
    more = packed(weights, "a")
    return Model(trie, counts, None if few else table, int(total), int(distinct),
                 publish(spark, Bits.build(weights.select(F.col("a").alias("key")), more).parts) if more else None,
                 weights if more else None, parts)


_SCORES = "n_tokens long, known long, base_score double, score double, unknown array<long>"
# What scored rows travel as, among packed columns.
SCORED = -1


def _lists(keys: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The keys of each of ``n`` texts; ``owner`` does not decrease."""
    at = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(keys))


def score_block(trie: Trie, counts: Counts | None, bits: Bits | None, total: int, distinct: int, column: pa.Array) -> list:
    """n_tokens, tokens seen in training, base score and score of each text; its words not yet scored. Then the keys of
    n-grams that may be beside the trie, and the text of each."""
    hashes, first = streams(column)
    number = trie.numbers(hashes)
    share = math.log10(total + 0.5 * (distinct + 1))
    seen = np.where(number >= 0, trie.count[np.maximum(number, 0)] if len(trie.count) else 0, 0)
    unknown = np.flatnonzero(number < 0)
    if counts is not None:
        distinct_words, which = np.unique(hashes[unknown], return_inverse=True)
        seen[unknown] = counts(distinct_words)[which]
    alone = np.log10(seen + 0.5) - share
    if counts is None:
        alone[unknown] = 0.0
    whole, has, full = trie.found(number, alone[1:])
    n = np.diff(first)
    # Sums over single texts, not differences of long sums, so that a text's score does not vary with its block.
    row = np.repeat(np.arange(len(n)), n)
    known, base, score = (np.bincount(row, x, len(n)) for x in ((seen > 0)[1:], alone[1:], whole))
    nothing = np.zeros(0, np.int64)
    left = _lists(nothing, nothing, len(n))
    if counts is None and len(unknown):
        left = _lists(hashes[unknown].view(np.int64), row[unknown - 1], len(n))
    keys, owner = np.zeros(0, np.uint64), nothing
    if bits is not None:
        ids = _ids(number, hashes)
        word, pair = np.flatnonzero(ids[:-1] < 0), np.flatnonzero(~has)
        triple = np.flatnonzero(~full[1:] & (hashes[1:-1] != END))
        keys = np.concatenate([_routed(ids[word]), _routed(ids[pair], ids[pair + 1]), _routed(ids[triple], ids[triple + 1], ids[triple + 2])])
        may = bits(keys)
        keys, owner = keys[may], row[np.concatenate([word, pair, triple + 1])[may]]
    return [n, known.astype(np.int64), base, score, left, keys, owner]


def scored(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` of each row, n_tokens, n_known, train_tokens, base_score and score.

    A NULL or empty text is an end alone: one token. Without training texts every token has the
    probability 1.
    """
    lean = model._replace(table=None, rest=None)
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in keep if c not in made]
    row = F.struct(*[name(c).alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("z"))
    source = docs.select(F.monotonically_increasing_id().alias("_row"), row.alias("row"), name(text).cast("string").alias("text"))
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in source.schema[:2]], *schema(_SCORES), *schema(_CHUNKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, parts = Trie(mapped(*lean.trie)), lean.parts
        counts, bits = (Counts(mapped(*lean.counts)) if lean.counts else None), (Bits(mapped(*lean.bits)) if lean.bits else None)
        asked: list = []

        def chunks(like: pa.RecordBatch) -> pa.RecordBatch:
            keys, rows = (np.concatenate(x) for x in zip(*asked))
            asked.clear()
            return _beside(_chunks(_part(keys, parts), ASKED, [keys, rows & 0xFFFFFFFF, rows >> 32]), like)

        done = None
        for block in blocks(batches):
            rows = block.column("_row").to_numpy()
            n, known, base, score, left, keys, owner = score_block(trie, counts, bits, lean.total, lean.distinct, block.column("text"))
            home = _part(_mixed(rows), parts).astype(np.int32)
            done = pa.RecordBatch.from_arrays(
                [*block.columns[:2], pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score), left,
                 pa.array(home), pa.array(np.full(len(n), SCORED, np.int32)), *[pa.nulls(len(n), pa.binary())] * len(_COLUMNS)],
                names=out.names)
            yield done
            asked.append((keys, rows[owner]))
            if sum(len(k) for k, _ in asked) > PART:
                yield chunks(done)
        if asked:
            yield chunks(done)

    found = source.mapInArrow(run, out)
    if model.rest is not None:
        found = _with_rest(found, model.rest, model.parts)
    if model.table is not None:
        found = _with_unknown(_written(found), model)
    return found.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "n_tokens", F.col("known").alias("n_known"),
                        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def _beside(chunks: pa.RecordBatch, like: pa.RecordBatch) -> pa.RecordBatch:
    """Packed columns as rows of the schema of scored rows."""
    return pa.RecordBatch.from_arrays(
        [chunks.column(f.name) if f.name in chunks.schema.names else pa.nulls(len(chunks), f.type) for f in like.schema], schema=like.schema)


def _with_unknown(out: DataFrame, model: Model) -> DataFrame:
    """Adds what the words not known to the trie contribute, by a join with the counts of all words."""
    words = (out.select("_row", F.explode("unknown").alias("key")).groupBy("_row", "key").agg(F.count(F.lit(1)).alias("times")))
    share = math.log10(model.total + 0.5 * (model.distinct + 1))
    found = skew_join(words, model.table, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    each = found.groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum((F.log10(F.col("n") + 0.5) - share) * F.col("times")).alias("_log"))
    zero = F.lit(0.0)
    return (out.drop("unknown").join(each, "_row", "left")
            .withColumn("known", F.col("known") + F.coalesce("_known", F.lit(0)))
            .withColumn("base_score", F.col("base_score") + F.coalesce("_log", zero))
            .withColumn("score", F.col("score") + F.coalesce("_log", zero)))


def _with_rest(found: DataFrame, rest: DataFrame, parts: int) -> DataFrame:
    """Adds the weights of the n-grams beside the trie, once for each time one occurs.

    Keys are asked for in the part that has their weights; what a row gets there is one sum, which goes to the
    part of the row. None of the n-grams is common: what is as frequent as the bound of the trie is in the trie.
    """
    def apart(batches: Iterator[pa.RecordBatch], rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The packed rows; the scored ones are put by."""
        for batch in batches:
            own = pc.equal(batch.column("kind"), SCORED)
            rows.append(batch.filter(own))
            yield batch.filter(pc.invert(own))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        for _, held in _parts(apart(batches, rows)):
            like = rows[-1]
            yield from rows
            rows[:] = [like.slice(0, 0)]
            if ASKED in held and WEIGHTS in held:
                keys, low, high = held[ASKED]
                hit, at = _places(held[WEIGHTS][0], keys)
                row, which = np.unique((high[hit].astype(np.int64) << 32) | low[hit], return_inverse=True)
                w = np.bincount(which, held[WEIGHTS][1][at], len(row))
                yield _beside(_chunks(_part(_mixed(row), parts), SUMS, [row & 0xFFFFFFFF, row >> 32, w]), like)
        yield from rows

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[pa.RecordBatch] = []
        sums = [(np.zeros(0, np.int64), np.zeros(0))]
        for _, held in _parts(apart(batches, rows)):
            low, high, w = held[SUMS]
            row, which = np.unique((high.astype(np.int64) << 32) | low, return_inverse=True)
            sums.append((row, np.bincount(which, w, len(row))))
        row, w = (np.concatenate(x) for x in zip(*sums))
        order = np.argsort(row)
        for batch in rows:
            score = batch.column("score").to_numpy().copy()
            here, at = _places(row[order], batch.column("_row").to_numpy())
            score[here] += w[order][at]
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(score))

    weights = rest.select(*[F.col(c) if c in rest.columns else F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns])
    sums = _dealt(found.unionByName(weights), parts).mapInArrow(answered, found.schema)
    return _dealt(sums, parts).mapInArrow(added, found.schema)
