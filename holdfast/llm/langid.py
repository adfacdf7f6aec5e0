"""Language identification by words first, then ever shorter character n-grams.

A word that was learnt scores by its log frequency in every language. An unseen one falls back to
its character n-grams with a border on either side: the longest length of which any n-gram was
learnt counts, as the mean log frequency of those n-grams. A language in which a word or n-gram was
not seen gets a fixed penalty. The text's score is the sum over all its words; the probability of the
best language under equal priors is its confidence.

The model is learnt from a bounded sample of texts per language, and keeps the most frequent words
and n-grams of each, so its size is bounded: it is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.frames import map_texts, name
from holdfast.llm.words import _BASE, _INVERSE, _powers, blocks, mix
from holdfast.scale import broadcast_if_small, durable

UNKNOWN = "und"
# Bounds of the model: texts learnt from, words and n-grams of each length kept, per language.
TEXTS = 5_000
WORDS = 50_000
GRAMS = 20_000
# Longest n-gram. Order 0 below stands for whole words.
LONGEST = 5
# Of a word or n-gram not seen in a language: as if it were this rare, in natural logarithms.
PENALTY = -16.0
_SPACE = np.uint64(0x2545F4914F6CDD1D)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter (Unicode categories L*)."""
    if not _LETTER:
        _LETTER.append(np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool))
    return _LETTER[0]


class Spelled:
    """The words of a block of texts, lower-cased: row of each, distinct hashes, and n-grams of some."""

    def __init__(self, texts: Sequence[str | None]):
        lower = [(t or "").lower() for t in texts]
        points = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        borders = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower])])
        inside = _letters()[points]
        start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.start, self.end = start, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.row = np.searchsorted(borders, start, "right") - 1
        value = np.where(inside, mix(points.astype(np.uint64) + np.uint64(1)), _SPACE)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value * _powers("up", _BASE, len(points) + 1)[:len(points)], out=self.sums[1:])
        self.down = _powers("down", _INVERSE, len(points) + 1)
        word = self._hash(self.start, self.end, 0)
        self.distinct, self.first, self.which = np.unique(word, return_index=True, return_inverse=True)

    def _hash(self, start: np.ndarray, end: np.ndarray, order: int) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + np.uint64(order))

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``words``, hash) of every n-gram of some distinct words, one border on either side."""
        start, end = self.start[self.first[words]] - 1, self.end[self.first[words]] + 1
        count = np.maximum(0, end - start - n + 1)
        owner = np.repeat(np.arange(len(words)), count)
        at = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return owner, self._hash(at, at + n, n)


class Model(NamedTuple):
    """Languages in order; for order 0 (words) and 1 to LONGEST: sorted hashes and log frequencies."""

    languages: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]


def training_texts(docs: DataFrame, id: str, text: str, lang: str, texts: int = TEXTS) -> DataFrame:
    """(lang, text): about ``texts`` rows of each language, by a hash of the id; NULLs are left out."""
    known = docs.filter(name(lang).isNotNull() & name(text).isNotNull()).select(
        F.coalesce(name(id).cast("string"), F.lit("")).alias("id"), name(lang).cast("string").alias("lang"),
        name(text).cast("string").alias("text"))
    million = 1_000_000
    share = (known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .select("lang", F.least(F.lit(1.0), F.lit(float(texts)) / F.col("n")).alias("share")))
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(million)) < F.col("share") * million
    # A row for each language: counted before it is broadcast, so that no text travels to be drawn.
    return known.join(broadcast_if_small(durable(share)), "lang").filter(draw).select("lang", "text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, limit=8 << 20):
        langs = np.array(block.column("lang").to_pylist(), object)
        texts = block.column("text").to_pylist()
        for lang in sorted(set(langs)):
            spelled = Spelled([t for t, own in zip(texts, langs) if own == lang])
            times = np.bincount(spelled.which, minlength=len(spelled.distinct))
            every = np.arange(len(spelled.distinct))
            for order in range(LONGEST + 1):
                if order:
                    owner, hashes = spelled.grams(every, order)
                    found, which = np.unique(hashes, return_inverse=True)
                    n = np.bincount(which, times[owner], len(found)).astype(np.int64)
                else:
                    found, n = spelled.distinct, times.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), order, np.int32)),
                     pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "order", "key", "n"])


def fit(texts: DataFrame, words: int = WORDS, grams: int = GRAMS) -> Model:
    """The model of labelled texts (lang, text): frequencies among all, of the most frequent kept."""
    counts = (texts.select("lang", "text").mapInArrow(_count, "lang string, order int, key long, n long")
              .groupBy("lang", "order", "key").agg(F.sum("n").alias("n")))
    every = Window.partitionBy("lang", "order")
    kept = (counts.withColumn("total", F.sum("n").over(every))
            .withColumn("rank", F.row_number().over(every.orderBy(F.desc("n"), "key")))
            .filter(F.col("rank") <= F.when(F.col("order") == 0, F.lit(words)).otherwise(F.lit(grams)))
            .select("lang", "order", "key", F.log(F.col("n") / F.col("total")).cast("float").alias("log"))).toArrow()
    lang = np.array(kept.column("lang").to_pylist(), object)
    order, key = kept.column("order").to_numpy(), kept.column("key").to_numpy().view(np.uint64)
    log = kept.column("log").to_numpy()
    languages = sorted(set(lang))
    number = np.searchsorted(languages, lang) if languages else np.zeros(0, np.int64)
    keys, logs = [], []
    for k in range(LONGEST + 1):
        mine = order == k
        found, at = np.unique(key[mine], return_inverse=True)
        table = np.full((len(found), len(languages)), PENALTY, np.float32)
        table[at, number[mine]] = log[mine]
        keys.append(found), logs.append(table)
    return Model(languages, keys, logs)


def _known(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return keys[at] == hashes, at


def word_scores(model: Model, spelled: Spelled) -> np.ndarray:
    """A row for each distinct word: its log score in every language. No known n-gram: the same in all."""
    out = np.zeros((len(spelled.distinct), len(model.languages)))
    seen, at = _known(model.keys[0], spelled.distinct)
    out[seen] = model.logs[0][at[seen]]
    rest = np.flatnonzero(~seen)
    for n in range(LONGEST, 0, -1):
        if not len(rest):
            break
        owner, hashes = spelled.grams(rest, n)
        seen, at = _known(model.keys[n], hashes)
        owner, at = owner[seen], at[seen]
        times = np.bincount(owner, minlength=len(rest))
        hit = times > 0
        for k in range(len(model.languages)):
            total = np.bincount(owner, model.logs[n][at, k], len(rest))
            out[rest[hit], k] = total[hit] / times[hit]
        rest = rest[~hit]
    return out


def identify(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` of each row, ``lang_pred`` and ``score``.

    ``und`` with score 0 where the text is NULL, empty or without a letter, or nothing was learnt.
    Among languages of one score the first in alphabetical order wins.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array):
        model = sent.value
        spelled = Spelled(column.to_pylist())
        each = word_scores(model, spelled)
        n, size = len(column), len(model.languages)
        has = np.bincount(spelled.row, minlength=n) > 0
        if not size:
            return [pa.array([UNKNOWN] * n), pa.array(np.zeros(n))]
        total = np.stack([np.bincount(spelled.row, each[spelled.which, k], n) for k in range(size)], axis=1)
        best = total.argmax(axis=1)
        sure = 1 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700)).sum(axis=1)
        return [pa.array([model.languages[b] if h else UNKNOWN for b, h in zip(best, has)]),
                pa.array(np.where(has, sure, 0.0))]

    return map_texts(docs, text, keep, "lang_pred string, score double", work)
