"""Substring dedup by relative Lempel-Ziv parsing against the whole corpus.

The reference of a document is everything that starts before it: earlier documents, and its own
earlier words. It is indexed in blocks, and a document is factored against every block that can hold
a factor of it:

* the blocks of texts that a task reads at once: each is parsed against itself, on the spot;
* the blocks of an index over all documents, dealt by the hash of a seed of ``SEED`` words. Each
  window of ``window`` words belongs to the seed with the smallest hash inside it, a choice that
  equal windows share, so equal windows always meet in one block, whatever lies around them.

A factor is a run of windows that have an earlier equal. A greedy factor ends where its source parts
from the text, and another source may take over from any word on; as every window is looked up on
its own, those that straddle the border of two factors are too. Joined, the factors of at least
``window`` words are the spans to remove.

Only windows that are new to their block travel, packed by seed, so a passage in a third of all
documents is sent once a block. Seeds that are common in many blocks stand before many different
texts; their windows are dealt one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.frames import name
from holdfast.llm.words import RAW, Words, blocks, grams, mix, windowed_min

WINDOW = 20
SEED = 8
BLOCK = 4 << 20
# A seed this common in one task is reported; one this common in all is dealt window by window. How
# windows are dealt never changes the result, so neither number does, nor the bound of the list.
COMMON_IN_TASK = 16
COMMON = 20_000
COMMON_SEEDS = 100_000
# Bytes kept of the hash of a window, beside the 8 of its seed.
PRINT = 5
_ROWS = "key long, doc long, tag int, start int, span int, prints binary"


class Windows:
    """The windows of a block of texts: place of the first word, row, hash, and place of the seed."""

    def __init__(self, column: pa.Array, window: int, seed: int):
        self.words = Words(column, RAW)
        first = self.words.first
        count = np.maximum(0, self.words.counts - window + 1)
        self.row = np.repeat(np.arange(len(count)), count)
        self.start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # in its row
        at = self.start + first[self.row]
        self.hash = grams(self.words.hash, window)[at]
        seeds = grams(self.words.hash, seed)
        self.seed_at = windowed_min(seeds, window - seed + 1)[at]
        self.seed = seeds[self.seed_at]

    def repeated(self, order: np.ndarray) -> np.ndarray:
        """Which windows have an equal earlier in the block; ``order`` is the rank of each row."""
        key = (order[self.row].astype(np.int64) << 32) | self.start
        by = np.lexsort((key, self.hash))
        new = np.ones(len(by), bool)
        new[1:] = self.hash[by][1:] != self.hash[by][:-1]
        first = key[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        out = np.zeros(len(by), bool)
        out[by] = key[by] > first
        return out


def _runs(*breaks: np.ndarray) -> np.ndarray:
    """Where a run begins: at 0 and wherever a value differs from that before, or is not one more (first array)."""
    steps, *same = breaks
    new = np.ones(len(steps), bool)
    new[1:] = steps[1:] != steps[:-1] + 1
    for values in same:
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _table(key, doc, tag, start, span, prints=None, sizes=None) -> pa.RecordBatch:
    if prints is None:
        packed = pa.array([None] * len(key), pa.binary())
    else:
        data = np.ascontiguousarray(prints.view(np.uint8).reshape(-1, 8)[:, :PRINT])
        offsets = np.concatenate([[0], np.cumsum(sizes * PRINT)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(start.astype(np.int32)),
         pa.array(span.astype(np.int32)), packed], names=["key", "doc", "tag", "start", "span", "prints"])


def _columns(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return block.column("doc").to_numpy(), block.column("tag").to_numpy()


def _common_seeds(source: DataFrame, window: int, seed: int) -> DataFrame:
    """(seed): those that belong to many windows new to their block, in many tasks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for block in blocks(batches, limit=BLOCK):
            w = Windows(block.column("text"), window, seed)
            new = ~w.repeated(np.argsort(np.argsort(_columns(block)[0], kind="stable"), kind="stable"))
            at = w.seed_at[new]
            run = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)
            seeds, n = np.unique(w.seed[new][run], return_counts=True)
            found.append(np.repeat(seeds[n > 1], n[n > 1]))  # within a block first: most are single
        seeds, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        seeds, n = seeds[n >= COMMON_IN_TASK], n[n >= COMMON_IN_TASK]
        yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(n)], names=["seed", "n"])

    counted = source.select("doc", "tag", "text").mapInArrow(count, "seed long, n long")
    total = counted.groupBy("seed").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    return total.orderBy(F.desc("n"), "seed").limit(COMMON_SEEDS).select("seed")


def _parse_blocks(source: DataFrame, window: int, seed: int) -> DataFrame:
    """Spans found inside a block of texts (``span`` > 0), and the windows new to it, for the index."""
    common = sorted(r[0] for r in _common_seeds(source, window, seed).collect())
    sent = source.sparkSession.sparkContext.broadcast(np.array(common, np.int64))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = sent.value.view(np.uint64)
        hot = np.sort(hot)
        for block in blocks(batches, limit=BLOCK):
            doc, tag = _columns(block)
            w = Windows(block.column("text"), window, seed)
            old = w.repeated(np.unique(doc, return_inverse=True)[1])
            if old.any():
                row, start = w.row[old], w.start[old]
                at = _runs(start, row)
                last = np.concatenate([at[1:], [len(row)]]) - 1
                yield _table(mix(row[at].astype(np.uint64) + w.hash[old][at]), doc[row[at]], tag[row[at]],
                             start[at], start[last] - start[at] + window)
            new = np.flatnonzero(~old)
            alone = np.zeros(len(new), bool)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, w.seed[new]), len(hot) - 1)
                alone = hot[place] == w.seed[new]
            one = new[alone]
            if len(one):
                yield _table(mix(w.hash[one]), doc[w.row[one]], tag[w.row[one]], w.start[one],
                             np.zeros(len(one)), w.hash[one], np.ones(len(one), np.int64))
            new = new[~alone]
            if len(new):
                at = _runs(w.start[new], w.row[new], w.seed_at[new])
                sizes = np.diff(np.concatenate([at, [len(new)]]))
                head = new[at]
                yield _table(w.seed[head], doc[w.row[head]], tag[w.row[head]], w.start[head],
                             np.zeros(len(head)), w.hash[new], sizes)

    return source.select("doc", "tag", "text").mapInArrow(parse, _ROWS)


def _parse_index(window: int):
    """One block of the index, sorted by key and order of the corpus: the spans with an earlier equal.

    Rows stream by. Of the key that may go on in the next batch, the windows seen and where each was
    first are kept.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, seen = None, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy().view(np.uint64)
            doc, tag = _columns(batch)
            start, span = batch.column("start").to_numpy(), batch.column("span").to_numpy()
            done = span > 0
            if done.any():
                yield _found(doc[done], tag[done], start[done], (start + span)[done])
            # Keys on one row only cannot repeat, unless they were in the batch before or may be in the next.
            twin = np.zeros(len(key), bool)
            twin[1:] = key[1:] == key[:-1]
            twin[:-1] |= twin[1:]
            twin[key == key[-1]] = True
            if last_key is not None:
                twin |= key == last_key
            at = np.flatnonzero(twin & ~done)
            if not len(at):
                last_key, seen = (last_key, seen) if last_key == key[-1] else (key[-1], tuple(s[:0] for s in seen))
                continue
            rows = batch.column("prints").take(pa.array(at))
            offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset:rows.offset + len(rows) + 1]
            data = np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].reshape(-1, PRINT)
            prints = np.zeros((len(data), 8), np.uint8)
            prints[:, :PRINT] = data
            prints = prints.view(np.uint64).ravel()
            sizes = np.diff(offsets) // PRINT
            owner = np.repeat(at, sizes)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            begin = start[owner].astype(np.int64) + np.arange(len(prints)) - first
            here, docs = key[owner], doc[owner]
            if last_key is not None and (key[at] == last_key).any():  # what is carried comes first
                here = np.concatenate([np.full(len(seen[0]), last_key, np.uint64), here])
                prints, docs = np.concatenate([seen[0], prints]), np.concatenate([seen[1], docs])
                begin = np.concatenate([seen[2], begin])
                owner = np.concatenate([np.full(len(seen[0]), -1), owner])
            by = np.lexsort((np.arange(len(prints)), prints, here))
            new = np.ones(len(by), bool)
            new[1:] = (here[by][1:] != here[by][:-1]) | (prints[by][1:] != prints[by][:-1])
            head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            old = np.zeros(len(by), bool)
            old[by] = (docs[by] != docs[head]) | (begin[by] != begin[head])
            kept = by[new]
            kept = kept[here[kept] == key[-1]]
            last_key, seen = key[-1], (prints[kept], docs[kept], begin[kept])
            old &= owner >= 0
            if old.any():
                owner, begin = owner[old], begin[old]
                at = _runs(begin, owner)
                last = np.concatenate([at[1:], [len(owner)]]) - 1
                yield _found(doc[owner[at]], tag[owner[at]], begin[at], begin[last] + window)
    return parse


def _found(doc, tag, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(start.astype(np.int32)),
                                       pa.array(end.astype(np.int32))], names=["doc", "tag", "start", "end"])


def _identified(docs: DataFrame, id: str, text: str) -> DataFrame:
    """The rows with ``doc``, their place in the order, and ``tag``, which tells rows of one id apart."""
    body = name(text).cast("string")
    return docs.select(
        F.struct(*[name(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text], F.lit(0).alias("z")).alias("row"),
        F.coalesce(name(id).cast("long"), F.lit(-2**63)).alias("doc"),
        (F.coalesce(F.crc32(body.cast("binary")), F.lit(0)) - 2**31).cast("int").alias("tag"), body.alias("text"))


def duplicate_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW,
                    seed: int = SEED) -> DataFrame:
    """(doc, tag, spans): start and end words, one after the other, of what to remove from each text."""
    source = _identified(docs, id, text)
    indexed = _parse_blocks(source, window, min(seed, window))
    dealt = indexed.repartition("key").sortWithinPartitions("key", "doc", "start")
    found = dealt.mapInArrow(_parse_index(window), "doc long, tag int, start int, end int")
    return (found.groupBy("doc", "tag").agg(F.collect_set(F.array("start", "end")).alias("spans"))
            .select("doc", "tag", F.flatten("spans").alias("spans")))


def factors(spans: Sequence[int]) -> list[tuple[int, int]]:
    """Greedy parse over what the blocks found: from each open word on, as far as any span reaches."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW,
                 seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` of each row, ``n_words``, ``n_removed`` and ``kept``: the words left, one space between.

    The order is that of the integer ``id``, then of the words. A NULL id comes before all others. Rows
    of one id are one document of several texts: a window at the same place of two of them is earlier
    in neither. A NULL text has no words and stays; ``kept`` is then empty, as for an empty text.
    """
    source = _identified(docs, id, text)
    spans = duplicate_spans(docs, id, text, window, seed)
    both = source.join(spans, ["doc", "tag"], "left").select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            texts = [(t or "").encode() for t in block.column("text").to_pylist()]
            n, removed, kept = [], [], []
            for body, found in zip(texts, block.column("spans").to_pylist()):
                words = body.split()
                n.append(len(words))
                for start, end in reversed(factors(found or ())):
                    del words[start:end]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    schema = T.StructType([both.schema["row"], *T.StructType.fromDDL("n_words long, n_removed long, kept string")])
    names = {c: f"row.c{i}" for i, c in enumerate(docs.columns) if c != text}
    kept_names = [c for c in keep if c not in ("n_words", "n_removed", "kept")]
    return both.mapInArrow(cut, schema).select(*[F.col(names[c]).alias(c) for c in kept_names],
                                               "n_words", "n_removed", "kept")
