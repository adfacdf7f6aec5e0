"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Each tokenizer says where its tokens end: one by character offsets, the other by the byte spans of its
proto (the installed library has replaced the immutable proto by this one). These are coarse cuts: the
tokens of a character cut into several share its offsets, and of the tokens a character falls back to
bytes for only the last has a span. Between two cuts that are sure the ends follow from the bytes of
the tokens as decoded. Where both tokenizers end at a byte, a group ends.

Neither tokenizer joins anything across a space that follows something else, so a text is cut there into
units, and both tokenizers and the alignment are asked once for each distinct unit a worker meets. This
is checked for the two files when they are loaded; where it does not hold, a unit is a whole text.

A link is a pair of overlapping tokens. Links are counted over the corpus by pair of ids, pre-aggregated
in each task. Texts are tokenised once: their ids and lengths are written, and both the counting and the
scoring of links read these.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain
from operator import attrgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.frames import map_texts, name, rows_per_batch
from holdfast.llm.packing import _byte_letters
from holdfast.llm.words import blocks, text_bytes
from holdfast.scale import bounded_rows, broadcast_if_small, durable, skew_join

# Units known to a worker: some 300 bytes each. More are forgotten and tokenised again.
CACHED = 400_000
# Characters of units tokenised at once, and bytes of a block of texts.
JOINED, BLOCK = 1 << 16, 2 << 20
# Bytes of ids whose links are looked at at once, unless one text has more.
TOKENS = 1 << 20
# Pairs of ids a task adds up before it sends them on.
HELD = 500_000
# Pairs of ids, 17 bytes each, that may be sent to every task; more are joined.
PAIRS = 4_000_000

# A space after something that is no white space, and before anything at all: a model asked for nothing says nothing.
_CUT = re.compile(r"(?<=\S) (?=[\s\S])")
# Without these, every space is such a one.
_ODD = re.compile(r"\s |^ | $")
_ID, _END = attrgetter("id"), attrgetter("end")
_PROBE = " Don't  stop\n  the naïve 你好 \U0001F600x  y 12,5%\t z a　 b"


def refined(end: np.ndarray, sure: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Ends of tokens: ``end`` where it is ``sure``, else the last sure end before and the decoded bytes since."""
    total = np.cumsum(length)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(end)), -1))
    return np.where(last >= 0, end[last] + total - total[last], total)


class Bytes(NamedTuple):
    """Tokens in order, the byte each ends at, and all their decoded bytes."""

    ids: np.ndarray
    end: np.ndarray
    decoded: bytes


class Byte:
    """A byte-level tokenizer of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in _byte_letters().items()}
        self.decoded = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, id in self.tokenizer.get_vocab().items():
            known = all(c in letters for c in token)
            self.decoded[id] = bytes(letters[c] for c in token) if known else token.encode()
        self.length = np.array([len(b) for b in self.decoded])
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = said.get("pre_tokenizer") or {}
        self.cuts = said.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)

    def encode(self, text: str) -> Bytes:
        made = self.tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(made.ids, np.int64)
        begin, end = np.fromiter(chain.from_iterable(made.offsets), np.int64, 2 * len(ids)).reshape(-1, 2).T
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the byte at which each character begins
        # A character that the next token begins in is not over yet.
        sure = np.append(begin[1:] >= end[:-1], True)[:len(ids)]
        return Bytes(ids, refined(at[end], sure, self.length[ids]), b"".join(map(self.decoded.__getitem__, ids.tolist())))


class Piece:
    """A sentencepiece model that puts a space before the text and falls back to bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(k) for k in range(n)]
        self.is_byte = np.array([self.model.is_byte(k) for k in range(n)])
        self.decoded = [bytes([int(p[3:5], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, self.is_byte.tolist())]
        self.length = np.array([len(b) for b in self.decoded])
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def encode(self, text: str) -> Bytes:
        """``text`` begins with the space that the model puts there itself."""
        pieces = self.model.encode(text[1:], return_type="proto", num_threads=1).pieces
        ids = np.fromiter(map(_ID, pieces), np.int64, len(pieces))
        end = np.fromiter(map(_END, pieces), np.int64, len(pieces)) + 1
        return Bytes(ids, refined(end, ~self.is_byte[ids], self.length[ids]), b"".join(map(self.decoded.__getitem__, ids.tolist())))


def overlaps(a_end: np.ndarray, a_length: np.ndarray, b_end: np.ndarray, b_length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all tokens that share a byte, in order."""
    first = np.searchsorted(b_end, a_end - a_length, "right")
    count = np.where(a_length > 0, np.searchsorted(b_end - b_length, a_end, "left") - first, 0)
    before = np.cumsum(count)
    a = np.repeat(np.arange(len(a_end)), count)
    return a, np.arange(len(a)) - np.repeat(before - count - first, count)


def group_texts(a: Bytes, b: Bytes, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """``a1,a2|b1;a3|b2`` of each unit, of which ``ends`` are the last bytes, and its number of groups."""
    both = a.end[b.end[np.minimum(np.searchsorted(b.end, a.end), len(b.end) - 1)] == a.end]
    group = np.concatenate([np.searchsorted(both, t.end) for t in (a, b)])
    side = np.repeat([0, 1], [len(a.ids), len(b.ids)])
    order = np.argsort(group * 2 + side, kind="stable")
    group, side = group[order], side[order]
    after = np.full(len(order), 2)  # a group ends: ';'
    after[:-1][(group[1:] == group[:-1])] = 0
    after[:-1][(group[1:] == group[:-1]) & (side[1:] != side[:-1])] = 1
    last = np.searchsorted(group, np.searchsorted(both, ends), "right") - 1
    after[last] = 3
    marks = (",", "|", ";", "\n")
    ids = np.concatenate([a.ids, b.ids])[order].tolist()
    texts = "".join([f"{i}{marks[m]}" for i, m in zip(ids, after.tolist())]).split("\n")[:-1]
    return texts, np.diff(np.searchsorted(both, ends, "right"), prepend=0)


class Pool:
    """Arrays of several lengths, one after another."""

    def __init__(self):
        self.data, self.used = np.zeros(1 << 16, np.int32), 0

    def add(self, values: np.ndarray) -> int:
        """Where they begin."""
        if self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data[:self.used], np.zeros(max(self.used, 2 * len(values)), np.int32)])
        self.data[self.used:self.used + len(values)] = values
        self.used += len(values)
        return self.used - len(values)

    def take(self, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        before = np.cumsum(count)
        return self.data[np.repeat(start - before + count, count) + np.arange(before[-1] if len(before) else 0)]


class Aligner:
    """Tokens and groups of texts; what is known of units is kept."""

    #: Columns of ``facts``: tokens of a and b, where they begin in the pools, groups, 1 if the bytes are those of the unit.
    NA, NB, A, B, GROUPS, SAME = range(6)

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = Byte(byte_path), Piece(piece_path)
        self.cuts = self.a.cuts and self.b.cuts
        self.clear()
        if self.cuts:  # does cutting agree with not cutting?
            whole = [t.encode(_PROBE) for t in (self.a, self.b)]
            parts = [[t.encode(" " + u) for u in _CUT.split(_PROBE[1:])] for t in (self.a, self.b)]
            self.cuts = all(w.ids.tolist() == [i for p in ps for i in p.ids.tolist()] for w, ps in zip(whole, parts))

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.facts, self.groups = np.zeros((1024, 6), np.int64), []
        self.pools = [Pool() for _ in range(4)]  # ids and lengths of a, ids and lengths of b

    def units(self, text: str) -> list[str]:
        """The text in units, each without the space before it."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        return _CUT.split(text) if _ODD.search(text) else text.split(" ")

    def _learn(self, units: Sequence[str]) -> None:
        """All at once where the bytes come back as they were, else by halves down to the unit where they do not."""
        text = " " + " ".join(units)
        a, b = self.a.encode(text), self.b.encode(text)
        raw = text.encode()
        same = a.decoded == raw and b.decoded == raw
        if not same and len(units) > 1:
            half = len(units) // 2
            self._learn(units[:half])
            self._learn(units[half:])
            return
        n = len(self.groups)
        while n + len(units) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        fact = self.facts[n:n + len(units)]
        lengths = [self.a.length[a.ids], self.b.length[b.ids]]
        if same:
            ends = np.cumsum([len(u.encode()) + 1 for u in units])
            texts, groups = group_texts(a, b, ends)
            past = [np.searchsorted(t.end, ends, "right") for t in (a, b)]
        else:
            texts, groups, past = [""], [0], [np.array([len(t.ids)]) for t in (a, b)]
        at = [pool.add(v) for pool, v in zip(self.pools, (a.ids, lengths[0], b.ids, lengths[1]))]
        for count, start, first, p in ((self.NA, self.A, at[0], past[0]), (self.NB, self.B, at[2], past[1])):
            fact[:, count] = np.diff(p, prepend=0)
            fact[:, start] = first + p - fact[:, count]
        fact[:, self.GROUPS], fact[:, self.SAME] = groups, same
        self.groups += texts
        self.known.update(zip(units, range(n, n + len(units))))

    def align(self, texts: Sequence[str | None]) -> list[np.ndarray | list[str]]:
        """n_a, n_b, groups of each text and its group text; ids and lengths of all tokens of a, and of b."""
        if len(self.groups) > CACHED:
            self.clear()
        cut = [self.units(t or "") for t in texts]
        border = np.cumsum([0, *map(len, cut)])
        units = list(chain.from_iterable(cut))
        places = list(map(self.known.get, units))
        missing = [k for k, p in enumerate(places) if p is None]
        new = list(dict.fromkeys([units[k] for k in missing]))
        # A space joined to white space is no cut, so units that end in white space are asked for alone.
        for unit in [u for u in new if u[-1:].isspace()]:
            self._learn([unit])
        new = [u for u in new if not u[-1:].isspace()]
        low, size = 0, 0
        for k, unit in enumerate(new):
            size += len(unit) + 1
            if size > JOINED:
                self._learn(new[low:k + 1])
                low, size = k + 1, 0
        if low < len(new):
            self._learn(new[low:])
        for k in missing:
            places[k] = self.known[units[k]]
        places = np.array(places, np.int64)
        flat = self.facts[places]
        differ = np.unique(np.searchsorted(border, np.flatnonzero(flat[:, self.SAME] == 0), "right") - 1).tolist()
        for k in differ:
            self._check(" " + texts[k], flat[border[k]:border[k + 1]])
            flat[border[k]:border[k + 1]] = 0
        total = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(flat, axis=0)])
        per = total[border[1:]] - total[border[:-1]]
        known = [self.groups[p] for p in places.tolist()]
        shown = ["" if k in differ else ";".join(known[low:high]) for k, (low, high) in enumerate(zip(border, border[1:]))]
        tokens = [pool.take(flat[:, start], flat[:, count]) for pool, start, count in zip(
            self.pools, (self.A, self.A, self.B, self.B), (self.NA, self.NA, self.NB, self.NB))]
        return [per[:, self.NA], per[:, self.NB], per[:, self.GROUPS], shown, *tokens]

    def _check(self, text: str, fact: np.ndarray) -> None:
        """Refuses tokenizers whose bytes differ from a text's unit by unit, but not in all."""
        ids = self.pools[0].take(fact[:, self.A], fact[:, self.NA]), self.pools[2].take(fact[:, self.B], fact[:, self.NB])
        if all(b"".join(t.decoded[i] for i in x.tolist()) == text.encode() for t, x in zip((self.a, self.b), ids)):
            raise NotImplementedError("a tokenizer that moves bytes from one unit to another")


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One per worker process and pair of files."""
    key = (byte_path, piece_path)
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


_ALIGNED = "n_a long, n_b long, n_groups long, groups_sha256 string, a binary, a_length binary, b binary, b_length binary"


def _narrow(most: int) -> np.dtype:
    """Of the whole numbers up to ``most``."""
    return np.dtype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _aligned(byte_path: str, piece_path: str, kinds: Sequence[np.dtype]):
    def work(column: pa.Array) -> list[pa.Array]:
        n_a, n_b, groups, shown, *tokens = aligner(byte_path, piece_path).align(column.to_pylist())
        digest = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]
        bodies = []
        for count, kind, values in zip((n_a, n_a, n_b, n_b), kinds, tokens):
            offsets = np.concatenate([[0], np.cumsum(count * kind.itemsize)]).astype(np.int32)
            bodies.append(pa.Array.from_buffers(pa.binary(), len(count), [None, *map(pa.py_buffer, (offsets, values.astype(kind)))]))
        return [pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(digest), *bodies]
    return work


def _links(batch: pa.RecordBatch, kinds: Sequence[np.dtype]) -> tuple[np.ndarray, np.ndarray]:
    """Row and pair of ids (a << 32 | b) of every link of a batch."""
    raw = [text_bytes(batch.column(c)) for c in ("a", "a_length", "b", "b_length")]
    a, a_length, b, b_length = (body.view(kind).astype(np.int64) for (body, _), kind in zip(raw, kinds))
    # Texts with tokens have as many bytes of a as of b, so the lengths of all add up in step.
    x, y = overlaps(np.cumsum(a_length), a_length, np.cumsum(b_length), b_length)
    row = np.repeat(np.arange(batch.num_rows), np.diff(raw[0][1]) // kinds[0].itemsize)
    return row[x], a[x] << 32 | b[y]


def _counted(kinds: Sequence[np.dtype]):
    """(pair, n): links of a task by pair, added up as far as HELD pairs go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

        for batch in blocks(batches, "a", TOKENS):
            new, n = np.unique(_links(batch, kinds)[1], return_counts=True)
            every, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(every)).astype(np.int64)
            keys = every
            if len(keys) > HELD:
                yield sent()
                keys, counts = keys[:0], counts[:0]
        yield sent()
    return run


def link_counts(tokens: DataFrame, kinds: Sequence[np.dtype]) -> DataFrame:
    """(pair, n, best), a row for each pair of ids that is linked anywhere; ``best`` where no pair of its b has more."""
    counts = durable(tokens.select("a", "a_length", "b", "b_length").mapInArrow(_counted(kinds), "pair long, n long")
                     .groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.join(broadcast_if_small(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_SCORED = "n_links long, n_best long, count_sum long"


def _scored(sent, kinds: Sequence[np.dtype]):
    """Links of each row, with the counts of all pairs at hand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in blocks(batches, "a", TOKENS):
            row, pair = _links(batch, kinds)
            at = np.searchsorted(keys, pair)
            border = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[border]) for v in (best[at].astype(np.int64), n[at])]
            made = [pa.array(v) for v in (np.diff(border), *sums)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], names=["row", "n_links", "n_best", "count_sum"])
    return run


def _row_pairs(kinds: Sequence[np.dtype]):
    """(at, pair, times) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "a", TOKENS):
            row, pair = _links(batch, kinds)
            by = np.lexsort((pair, row))
            row, pair = row[by], pair[by]
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (pair[1:] != pair[:-1]))) if len(row) else row
            times = np.diff(np.append(new, len(row)))
            yield pa.RecordBatch.from_arrays([batch.column("at").take(pa.array(row[new])), pa.array(pair[new]), pa.array(times)],
                                             names=["at", "pair", "times"])
    return run


def aligned(docs: DataFrame, byte_path: str, piece_path: str, keep: Sequence[str], text: str = "text",
            pairs: int = PAIRS) -> DataFrame:
    """``keep`` of each row; n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256.

    Tokens of a are those of a space and the text by ``byte_path``, of b those of the text by ``piece_path``,
    which adds the space. Groups are told in ``a1,a2|b1;a3|b2`` order of ids. ``n_best`` links have a pair
    that is linked as often in the corpus as any of its b; ``count_sum`` adds up how often theirs is. Texts that
    are NULL or empty, or whose tokens do not give the bytes of the text again, have no tokens: zeros, and
    an empty digest. Repeated rows count each. ``pairs`` bounds the pairs sent to every task: beyond, links
    meet their counts by a join.
    """
    spark = docs.sparkSession
    row = F.struct(*[name(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("z")).alias("row")
    here = aligner(byte_path, piece_path)
    kinds = [_narrow(n) for t in (here.a, here.b) for n in (len(t.decoded), int(t.length.max()))]
    made = map_texts(docs.select(row, name(text).alias("text")), "text", ["row"], _ALIGNED, _aligned(byte_path, piece_path, kinds), BLOCK)
    with rows_per_batch(spark, 2000):
        tokens = durable(made.withColumn("at", F.monotonically_increasing_id()))
    plain = F.struct("row", "n_a", "n_b", "n_groups", "groups_sha256").alias("row")
    counts = durable(link_counts(tokens, kinds))
    if bounded_rows(counts, pairs) is not None:
        table = counts.toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
        source = tokens.select(plain, "a", "a_length", "b", "b_length")
        scored = source.mapInArrow(_scored(sent, kinds), f"row {source.schema['row'].dataType.simpleString()}, {_SCORED}")
    else:
        links = tokens.select("at", "a", "a_length", "b", "b_length").mapInArrow(_row_pairs(kinds), "at long, pair long, times long")
        links = durable(links)
        met = skew_join(links, counts, "pair", probe=links).groupBy("at").agg(
            F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        scored = tokens.select("at", plain).join(met, "at", "left").na.fill(0, ["n_links", "n_best", "count_sum"])
    kept = [F.col(f"row.row.c{i}").alias(c) for i, c in enumerate(keep)]
    return scored.select(*kept, "row.n_a", "row.n_b", "row.n_groups", "n_links", "n_best", "count_sum", "row.groups_sha256")
