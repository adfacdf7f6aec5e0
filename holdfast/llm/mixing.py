"""Mixing sources to target weights by the cube method.

Every document of a source has the same expected number of copies, target over size of the source. The
whole part of it is taken of every document; the rest is an inclusion probability, and the cube method
turns these into 0 and 1 without changing two totals of the source: its words and its documents.

Flight: of any three undecided documents there is a direction in which their probabilities can move
with both totals unchanged. They move along it, one way or the other by chance, until one of them is 0
or 1 and so decided; then the next document takes its place. Three at a time are all that is held. A
source is dealt into chunks by a hash, each flies on its own and leaves two documents at most; those of
all chunks fly again, until few are left of any source.

Landing: what is left, and a few documents of each order of size that were kept back for this. The
number of documents is given up; from the longest on, each is decided so that the words stay nearest to
what they should be, the first by chance. So the words of a source miss its target by no more than its
shortest documents.

Every chance is a hash of the document, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.frames import map_texts, name
from holdfast.llm.words import RAW, Words
from holdfast.operators.ordering import position
from holdfast.scale import broadcast_if_small, durable

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
# Documents of a chunk, on average; each chunk leaves two at most for the next round.
CHUNK = 1024
# Undecided documents of a source that need no further flight.
FEW = 128
# Documents of each source and order of size (a power of two) that wait for the landing, on average.
KEPT = 8
# A probability this near to 0 or 1 is that: what is left of rounding.
NEAR = 1e-9


def direction(a: int, b: int, c: int) -> tuple[float, ...]:
    """How documents of three sizes move with their words and their number unchanged."""
    return (float(b - c), float(c - a), float(a - b)) if a != b or b != c else (1.0, -1.0, 0.0)


def move(size: Sequence[int], part: Sequence[float], chance: float) -> list[float]:
    """The probabilities after one step; their expectation is what they were, and one at least is decided."""
    along = direction(*size)
    up = min(((1 - p) / d if d > 0 else p / -d) for p, d in zip(part, along) if d)
    down = min((p / d if d > 0 else (1 - p) / -d) for p, d in zip(part, along) if d)
    step = up if chance * (up + down) < down else -down
    moved = [p + step * d for p, d in zip(part, along)]
    return [0.0 if p < NEAR else 1.0 if p > 1 - NEAR else p for p in moved]


class Flight:
    """The undecided documents of a chunk, two at most between calls: places, sizes, probabilities."""

    def __init__(self):
        self.held: list[tuple[int, int, float]] = []

    def take(self, place: int, size: int, part: float, chance: float) -> list[tuple[int, float]]:
        """Adds a document; (place, 0 or 1) of those that are decided by it."""
        self.held.append((place, size, part))
        if len(self.held) < 3:
            return []
        places, sizes, parts = zip(*self.held)
        moved = move(sizes, parts, chance)
        self.held = [h for h in zip(places, sizes, moved) if 0 < h[2] < 1]
        return [(place, p) for place, p in zip(places, moved) if not 0 < p < 1]


class Landing:
    """Decides at once; ``over`` is by how many words more than expected were taken so far."""

    held: list[tuple[int, int, float]] = []

    def __init__(self):
        self.over: float | None = None

    def take(self, place: int, size: int, part: float, chance: float) -> list[tuple[int, float]]:
        if self.over is None:
            self.over, value = 0.0, float(chance < part)
        else:
            value = float(abs(self.over + (1 - part) * size) < abs(self.over - part * size))
        self.over += (value - part) * size
        return [(place, value)]


_FLOWN = ["row", "source", "size", "rate", "part", "h"]


def _with_part(batch: pa.RecordBatch, part: np.ndarray) -> pa.RecordBatch:
    at = batch.schema.get_field_index("part")
    return batch.set_column(at, batch.schema.field(at), pa.array(part))


def _flown(land: bool):
    """Takes rows by (source, chunk) and gives them ``part`` after the flight of each chunk, or its landing.

    A document is sent on when it is decided or its chunk ends; only those held wait for the next batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, flight, waiting = None, None, None
        for batch in batches:
            if waiting is not None:
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            n, size = len(flight.held) if flight else 0, batch.column("size").to_pylist()
            if n:
                flight.held = [(k, *h[1:]) for k, h in enumerate(flight.held)]  # those that waited come first
            part = batch.column("part").to_numpy().copy()
            chance = (batch.column("h").to_numpy().view(np.uint64) >> np.uint64(11)) * 2.0 ** -53
            undecided = ((part > 0) & (part < 1)).tolist()
            keys = list(zip(batch.column("source").to_pylist(), batch.column("chunk").to_pylist()))

            for k in range(n, len(part)):
                if keys[k] != key:
                    for h in flight.held if flight else ():
                        part[h[0]] = h[2]
                    key, flight = keys[k], Landing() if land else Flight()
                if undecided[k]:
                    for place, value in flight.take(k, size[k], float(part[k]), float(chance[k])):
                        part[place] = value
            stay = [h[0] for h in flight.held] if flight else []
            part[stay] = [h[2] for h in flight.held] if flight else []
            batch = _with_part(batch, part)
            go = np.ones(len(part), bool)
            go[stay] = False
            waiting = batch.take(pa.array(stay, pa.int64())) if stay else None
            yield batch.filter(pa.array(go)).select(_FLOWN)
        if waiting is not None:
            yield waiting.select(_FLOWN)
    return run


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size, ...) with ``target``: ``share`` of all sizes by weight, ``most`` times its size at most.

    Sources by code point, NULL last, get ``weights`` in turn. What is above the limit is dealt anew by
    weight; in the end every source below it has the same share a weight. Only sums reach the driver.
    """
    if share > most:
        raise ValueError("the sources cannot give that much")
    ranked = position(sources, [], [F.asc_nulls_last("source")], "_place", start=0)
    turn = F.array(*[F.lit(int(w)) for w in weights])
    ranked = durable(ranked.withColumn("weight", F.element_at(turn, (F.col("_place") % len(weights) + 1).cast("int"))).drop("_place"))
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.lit(most) * F.col("size")
        total, capped, left, n = ranked.agg(
            F.sum("size"), F.sum(F.when(over, F.col("size")).otherwise(0)),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.sum(over.cast("long"))).first()
        if n == full or not total or not left:
            break
        level, full = (share * total - most * capped) / left, n
    target = F.least(F.col("weight") * F.lit(level), F.lit(most) * F.col("size")).cast("double")
    return ranked.withColumn("target", target).drop("weight")


def mixed(docs: DataFrame, keep: Sequence[str] = ("doc_id",), id: str = "doc_id", text: str = "text", source: str = "source",
          weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, chunk: int = CHUNK) -> DataFrame:
    """``keep`` of each row, ``size``, ``source_size``, ``target`` of its source, and ``copies``, how often the mix takes it.

    Size is the number of words between white space, 0 for NULL and empty texts; those have copies
    too, which weigh nothing. A NULL source is a source. Repeated rows are documents of their own; rows of
    one id and size are interchangeable, and so are their copies. A source without words has target 0 and
    gives no copies. Every document is taken as often as its source's rate, rounded down or up.
    """
    row = F.struct(*[name(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("z")).alias("row")
    h = F.xxhash64(name(id).cast("string"), F.lit(20240611)).alias("h")
    plain = docs.select(row, name(source).cast("string").alias("source"), h, name(text).alias("text"))
    rows = durable(map_texts(plain, "text", ["row", "source", "h"], "size long",
                             lambda column: [pa.array(Words(column, RAW, hashed=False).counts)]))
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    goals = durable(targets(sources, weights, share, most).select(
        "source", "n", F.col("size").alias("source_size"), "target",
        F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("rate")))

    def of_source(left: DataFrame, facts: DataFrame) -> DataFrame:
        facts = broadcast_if_small(facts.withColumnRenamed("source", "_source"))
        return left.join(facts, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def flight(left: DataFrame, land: bool = False) -> DataFrame:
        """``left``, with the number ``n`` of rows of its source, after the flight of chunks of that many, or the landing."""
        chunks = F.lit(1) if land else F.greatest(F.lit(1), F.ceil(F.col("n") / chunk))
        left = left.withColumn("chunk", F.pmod(F.xxhash64("h", "size", "n"), chunks.cast("long")))
        order = [F.desc("size"), F.col("h")] if land else [F.col("h"), F.col("size")]
        left = left.repartition("source", "chunk").sortWithinPartitions("source", "chunk", *order)
        return durable(left.select(*_FLOWN, "chunk").mapInArrow(_flown(land), left.select(*_FLOWN).schema))

    # A rate that is a whole number but for rounding leaves no part.
    part = F.col("rate") - F.floor(F.col("rate") + NEAR)
    part = F.when(F.abs(part) < NEAR, 0.0).otherwise(part)
    order = F.floor(F.log2(F.col("size") + F.lit(1))).cast("int").alias("order")
    orders = broadcast_if_small(rows.groupBy(F.col("source").alias("_s"), order).agg(F.count(F.lit(1)).alias("alike")))
    rated = of_source(rows, goals.select("source", "n", "rate")).withColumn("part", part)
    rated = rated.join(orders, F.col("source").eqNullSafe(F.col("_s")) & (order == F.col("order")))
    back = F.pmod(F.xxhash64("h", "size"), F.lit(1_000_000)) * F.col("alike") < KEPT * 1_000_000
    undecided = (F.col("part") > 0) & (F.col("part") < 1)
    landing = rated.filter(back & undecided).select(*_FLOWN)
    flown = flight(rated.filter(~(back & undecided)))
    done, left = [flown.filter(~undecided)], flown.filter(undecided)
    while True:
        facts = left.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        if (facts.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
        flown = flight(of_source(left, facts))
        done, left = [*done, flown.filter(~undecided)], flown.filter(undecided)
    done.append(flight(left.unionByName(landing).withColumn("n", F.lit(0)), land=True))
    whole = reduce(DataFrame.unionByName, done)
    out = of_source(whole, goals.select("source", "source_size", "target"))
    copies = (F.floor(F.col("rate") + NEAR) + F.col("part")).cast("int")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target",
                      copies.alias("copies"))
