"""Near-duplicates by Order MinHash, verified by banded alignment.

The k-mers of a text are its shingles of ``SHINGLE`` words, each labelled with its occurrence, so that
no two are equal. A draw takes the ``PICKS`` labelled shingles with the smallest hashes and keeps
them in the order of the text; two texts share a draw when they share these shingles in that order,
which follows how much of one can be aligned with the other. Texts that share any of ``DRAWS`` draws
are candidates.

Draws of few shingles say little, so pairs of which one has at most ``SHORT`` are found without chance,
by a prefix filter: the shingles of such texts are ordered by how many texts have them, the rarest
first, and two texts that reach the threshold share one among the first of each, as many as may stay
unaligned and one more.

Similarity is that of an alignment: the longest common subsequence of the labelled shingles, over all
shingles of both less those aligned. It is at most the Jaccard similarity of the shingles, and equal
to it where nothing was moved. To reach the threshold the two places of an aligned shingle cannot lie
further apart than the shingles that may stay unaligned, so aligning inside that band loses nothing.

Texts of equal words are one node, so any number of copies costs as much as one. In a bucket of a
shared draw every member is first compared with the one that shares most draws with others, not with
every other. What is linked by then needs no more comparing; only members of buckets that still span
several classes are compared further, each pair of them. In larger buckets that is done in blocks of the
members' words: all pairs of a block are counted at once for the shingles they share, those that share
as many as the threshold asks for are aligned until their classes are one, and only the links that
joined two classes are sent on, fewer than a block has members. So nothing is lost there, and what
fails is never written.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.frames import map_texts, name, rows_per_batch
from holdfast.llm.words import PLAIN, Words, grams, mix
from holdfast.operators.entity import connected
from holdfast.scale import bounded_rows, durable, skew_join

SHINGLE = 5
SIMILAR = 0.8
DRAWS = 40
PICKS = 6
# Shingles of a text up to which its pairs are found by single shingles and not by draws.
SHORT = 32
# Members of a bucket that are paired as rows; those of larger ones meet in blocks.
CROWD = 12
# Members of a block, and words of theirs: two blocks meet in a task.
BLOCK, WORDS = 1024, 1 << 20
# Paired nodes, 16 bytes each, that may be broadcast; more are joined by a shuffle of all words.
PAIRED = 500_000
_SALTS = mix(np.arange(1, DRAWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct: the second of a kind gets another hash than the first, and so on."""
    by = np.argsort(shingles, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = shingles[by][1:] != shingles[by][:-1]
    if new.all():
        return shingles
    nth = np.zeros(len(by), np.int64)
    nth[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return np.where(nth > 0, mix(shingles + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), shingles)


def shingled(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Labelled shingles of a text, in order; a text of fewer words is one shingle."""
    return labelled(grams(words, min(size, len(words)))) if len(words) else np.zeros(0, np.uint64)


def draws(shingles: np.ndarray) -> np.ndarray:
    """One hash for each draw: of its smallest labelled shingles, in the order of the text."""
    n, picks = len(shingles), min(PICKS, len(shingles))
    out = np.zeros(DRAWS, np.uint64)
    step = max(1, (1 << 21) // max(1, n))
    for low in range(0, DRAWS, step):
        salts = _SALTS[low:low + step, None]
        values = shingles[None, :] * salts
        values ^= values >> np.uint64(29)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.argpartition(values, picks - 1, axis=1)[:, :picks] if picks < n else \
            np.broadcast_to(np.arange(n), (len(salts), n))
        chosen = shingles[np.sort(at, axis=1)]
        total = np.broadcast_to(salts[:, 0], len(salts)).copy()
        for k in range(picks):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + chosen[:, k])
        out[low:low + step] = total
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Aligned shingles over all, for two texts' labelled shingles; 0.0 where below ``least`` for certain."""
    both = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    need = int(np.ceil(least / (1 + least) * both - 1e-9))
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at_a) < need:
        return 0.0
    near = np.abs(at_a - at_b) <= max(len(a), len(b)) - need
    at = at_b[near][np.argsort(at_a[near])]
    if len(at) and (at[1:] > at[:-1]).all():
        aligned = len(at)
    else:
        tails: list[int] = []
        for place in at.tolist():
            k = bisect_left(tails, place)
            if k == len(tails):
                tails.append(place)
            else:
                tails[k] = place
        aligned = len(tails)
    return aligned / (both - aligned)


def _nodes(w: Words) -> list[bytes | None]:
    """16 bytes that stand for each row's sequence of words; None without words."""
    return [hashlib.blake2b(w.hash[a:b], digest_size=16).digest() if b > a else None
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]


def with_nodes(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` of each row and its ``node``."""
    return map_texts(docs, text, keep, "node binary", lambda column: [pa.array(_nodes(Words(column, PLAIN)), pa.binary())])


def _per_node(docs: DataFrame, text: str, result: str, make, kind: pa.DataType) -> DataFrame:
    """(node, result): what ``make`` makes of the word hashes; copies within a block of rows are left out."""
    def work(column: pa.Array):
        w = Words(column, PLAIN)
        seen: set[bytes] = set()
        nodes, made = _nodes(w), []
        for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
            if nodes[k] is None or nodes[k] in seen:
                nodes[k] = None
                made.append(None)
            else:
                seen.add(nodes[k])
                made.append(make(w.hash[a:b]))
        return [pa.array(nodes, pa.binary()), pa.array(made, kind)]

    found = map_texts(docs, text, [], f"node binary, made {result}", work)
    return found.filter(F.col("node").isNotNull())


def _partner(least: float) -> int:
    """The most shingles of a text that can be similar to one of SHORT."""
    return int(SHORT / least + 1e-9)


def _sketch(least: float):
    """The number of shingles of a text; its draws if these are more than SHORT; the shingles if one of SHORT can be similar."""
    def sketch(words: np.ndarray) -> np.ndarray:
        shingles = shingled(words)
        parts = [np.array([len(shingles)], np.int64)]
        if len(shingles) > SHORT:
            parts.append(draws(shingles).view(np.int64))
        if len(shingles) <= _partner(least):
            parts.append(shingles.view(np.int64))
        return np.concatenate(parts)
    return sketch


def _sketches(docs: DataFrame, text: str, least: float) -> DataFrame:
    """(node, n, draws, shingles), a row for each node; no draws of short texts, no shingles of long ones."""
    made = _per_node(docs, text, "array<long>", _sketch(least), pa.list_(pa.int64()))
    n, none = F.col("made")[0], F.array().cast("array<long>")
    after = F.when(n > SHORT, DRAWS + 2).otherwise(2)
    return (made.groupBy("node").agg(F.first("made").alias("made"))
            .select("node", n.alias("n"), F.when(n > SHORT, F.slice("made", 2, DRAWS)).otherwise(none).alias("draws"),
                    F.when(n <= _partner(least), F.slice("made", after, n.cast("int"))).otherwise(none).alias("shingles")))


def _prefixes(sketches: DataFrame, least: float) -> DataFrame:
    """(key, node, n): the shingles of short texts and their possible partners by which similar ones must meet.

    Of n shingles those that less than ``least`` of n can do without, and one more, in the order of
    (texts that have it, hash). Those of one text come first and meet nothing, so they are only counted.
    """
    every = sketches.filter(F.size("shingles") > 0).select("node", "n", F.explode("shingles").alias("key"))
    times = durable(every.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    met = skew_join(every, times, "key", probe=every).groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("times", "key"))).alias("met"))
    own = F.col("n") - F.size("met")
    first = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1 - own).cast("int")
    return met.select("node", "n", F.explode(F.slice("met", 1, F.greatest(first, F.lit(0)))).alias("at")).select(
        F.col("at.key").alias("key"), "node", "n")


def _bodies(ends: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, words) of the nodes ``ends``, written. The words of these alone travel."""
    if bounded_rows(ends, PAIRED) is not None:  # then the texts of all others need not travel at all
        ends = F.broadcast(ends)
    bodies = _per_node(docs, text, "binary", lambda words: words.astype(np.uint32).tobytes(), pa.binary())
    return durable(bodies.join(ends, "node", "left_semi").groupBy("node").agg(F.first("made").alias("words")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node"))


class _Bodies:
    """Labelled shingles by words, some of them remembered."""

    def __init__(self):
        self.known: dict[bytes, np.ndarray] = {}

    def __call__(self, body: bytes) -> np.ndarray:
        if body not in self.known:
            if len(self.known) >= 64:
                self.known.clear()
            self.known[body] = shingled(np.frombuffer(body, np.uint32).astype(np.uint64))
        return self.known[body]


def _verified(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose alignment reaches ``least``, written."""
    first = bodies.select(F.col("node").alias("u"), F.col("words").alias("words_u"))
    second = bodies.select(F.col("node").alias("v"), F.col("words").alias("words_v"))
    joined = skew_join(skew_join(pairs, first, "u"), second, "v", probe=pairs)

    def compare(batches):
        of = _Bodies()
        for batch in batches:
            words = zip(batch.column("words_u").to_pylist(), batch.column("words_v").to_pylist())
            good = [similarity(of(a), of(b), least) >= least for a, b in words]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    with rows_per_batch(bodies.sparkSession, 256):
        return durable(joined.select("u", "v", "words_u", "words_v").mapInArrow(compare, "u binary, v binary"))


def _ordered(a: str, b: str):
    """A pair as (larger, smaller), which is how components want an edge."""
    return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")


def _fits(a: str, b: str, least: float):
    return F.least(a, b) >= F.greatest(a, b) * least


def _classes(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with ``class``, the smallest node of theirs so far."""
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    joined = skew_join(members, roots, "node", "left") if "key" in members.columns else members.join(roots, "node", "left")
    return joined.withColumn("class", F.coalesce("class", "node"))


def _spanning(members: DataFrame) -> DataFrame:
    """Buckets that hold several classes, with the blocks they are parted into, 0 for small ones."""
    size, words = F.col("size"), F.col("total") + (SHINGLE - 1) * F.col("size")
    return (members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"),
                                       F.min("class").alias("a"), F.max("class").alias("b"))
            .filter(F.col("a") != F.col("b")).select("key", "size", F.greatest(
                F.ceil(size / BLOCK), F.ceil(words / WORDS)).cast("int").alias("parts")))


def _rest(members: DataFrame, tried: DataFrame, docs: DataFrame, text: str, least: float, crowd: int) -> DataFrame:
    """Links (u, v) between different classes among members (key, node, n, class) of a bucket, but those ``tried``."""
    spanning = durable(skew_join(members, _spanning(members), "key", probe=members))
    small = spanning.filter(F.col("size") <= crowd)
    left, right = (small.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("class").alias(f"c{x}"))
                   for x in ("a", "b"))
    pairs = (left.join(right, "key").filter((F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & _fits("na", "nb", least))
             .select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    pairs = durable(pairs.join(tried, ["u", "v"], "left_anti"))
    large = spanning.filter(F.col("size") > crowd)
    bodies = _bodies(durable(_ends(pairs).unionByName(large.select("node")).distinct()), docs, text)
    links = _verified(pairs, bodies, least)
    if large.isEmpty():
        return links
    # Two blocks, or one with itself, are a group; a member is in as many as its bucket has blocks.
    dealt = (skew_join(large, bodies, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
                     "part", "node", "class", "words"))
    met = dealt.groupBy("key", "low", "high").applyInArrow(_meet(least), "u binary, v binary")
    return links.unionByName(durable(met.distinct()))


def _shared(shingles: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of some texts have in common."""
    n = len(shingles)
    rows = np.repeat(np.arange(n), [len(x) for x in shingles])
    kind = np.unique(np.concatenate(shingles), return_inverse=True)[1]
    by = np.argsort(kind, kind="stable")
    rows, kind = rows[by], kind[by]
    many = np.bincount(kind)[kind] > 64
    shared = np.zeros((n, n), np.float32)
    # Shingles of many rows by products of 0 and 1, the others by their pairs.
    dense, place = rows[many], np.unique(kind[many], return_inverse=True)[1]
    for start in range(0, int(place.max()) + 1 if len(place) else 0, 1024):
        here = (place >= start) & (place < start + 1024)
        has = np.zeros((n, 1024), np.float32)
        has[dense[here], place[here] - start] = 1
        shared += has @ has.T
    rows, kind = rows[~many], kind[~many]
    for step in range(1, 64):
        same = np.flatnonzero(kind[step:] == kind[:-step])
        if not len(same):
            break
        flat = np.bincount(rows[same] * n + rows[same + step], minlength=n * n).reshape(n, n)
        shared += flat + flat.T
    return shared


def _meet(least: float):
    """Links between members of a block, or of two, that join classes not joined by then: a forest."""
    def meet(table: pa.Table) -> pa.Table:
        nodes, words = table.column("node").to_pylist(), table.column("words").to_pylist()
        part = np.array(table.column("part").to_pylist())
        alone = len(np.unique(part)) == 1
        classes = np.unique(np.array(table.column("class").to_pylist(), object), return_inverse=True)[1]
        shingles = [shingled(np.frombuffer(w, np.uint32).astype(np.uint64)) for w in words]
        n = np.array([len(x) for x in shingles], float)
        shared = _shared(shingles)
        need = np.ceil(least / (1 + least) * (n[:, None] + n) - 1e-9)
        good = (shared >= need) & (classes[:, None] != classes) & (np.minimum(n[:, None], n) >= least * np.maximum(n[:, None], n))
        if not alone:
            good &= part[:, None] != part
        first, second = np.nonzero(np.tril(good, -1))
        # Those that share most come first, so classes are one after few alignments.
        order = np.argsort(-(shared[first, second] / need[first, second]), kind="stable")
        root = list(range(int(classes.max()) + 1))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        us, vs, of = [], [], classes.tolist()
        for k in order.tolist():
            a, b = int(first[k]), int(second[k])
            x, y = find(of[a]), find(of[b])
            if x != y and similarity(shingles[a], shingles[b], least) >= least:
                root[x] = y
                us.append(max(nodes[a], nodes[b])), vs.append(min(nodes[a], nodes[b]))
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})
    return meet


def linked(docs: DataFrame, text: str = "text", least: float = SIMILAR, crowd: int | None = None) -> DataFrame:
    """(u, v): every node that is not the smallest of its class, with the smallest."""
    sketches = durable(_sketches(docs, text, least))
    drawn = sketches.select(F.explode(F.array_distinct("draws")).alias("key"), "node", "n")
    # A draw and a shingle of equal hash are two buckets.
    single = F.col("single").cast("long")
    every = drawn.withColumn("single", F.lit(False)).unionByName(_prefixes(sketches, least).withColumn("single", F.lit(True)))
    every = durable(every.withColumn("key", F.col("key").bitwiseAND(F.lit(-2)).bitwiseOR(single)))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    members = durable(skew_join(every, shared, "key", probe=every))
    # The member that meets most others leads its buckets: the text that most copies were made from.
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = members.drop("size", "single").join(weight, "node")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("lead")).select(
        "key", F.col("lead.node").alias("leader"), F.col("lead.n").alias("of"))
    stars = (skew_join(members.select("key", "node", "n"), leaders, "key", probe=members)
             .filter((F.col("node") != F.col("leader")) & _fits("n", "of", least))
             .select(*_ordered("node", "leader")).distinct())
    tried = durable(stars)
    edges = _verified(tried, _bodies(durable(_ends(tried).distinct()), docs, text), least)
    roots = connected(edges)
    more = _rest(_classes(roots, members.select("key", "node", "n")), tried, docs, text, least,
                 CROWD if crowd is None else crowd)
    return connected(edges.unionByName(more))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """Each row's ``id``, ``class_id``, the smallest id of its class, and ``class_size`` in rows.

    A class is everything connected by links of at least ``least``; rows of equal words are of one
    class. Rows without words (NULL, empty, marks only) are of no class: ``class_id`` is their own id,
    ``class_size`` 1. A class whose ids are all NULL has a NULL ``class_id``.
    """
    rows = durable(with_nodes(docs, [id], text).select(name(id).alias("id"), "node"))
    roots = linked(docs, text, least).select(F.col("u").alias("node"), F.col("v").alias("class"))
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    of = durable(nodes.join(roots, "node", "left").withColumn("class", F.coalesce("class", "node")))
    classes = of.groupBy("class").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    found = of.select("node", "class").join(classes, "class").select("node", "class_id", "class_size")
    with_class = skew_join(rows, found, "node", "left", probe=rows)
    alone = F.col("node").isNull()
    return with_class.select(
        F.col("id").alias(id), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, one of each class: that of the smallest id, any one of repeated rows. Rows without words stay.

    Decided on ids and nodes alone; the texts are read once more and only the rows to drop are looked up.
    """
    if "node" in docs.columns:
        return one_of_each(docs.withColumnRenamed("node", "_own_node"), id, text, least).withColumnRenamed("_own_node", "node")
    ids = durable(with_nodes(docs, [id], text).filter(F.col("node").isNotNull()).select(name(id).alias("id"), "node"))
    if not ids.groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return _one_row_of_each(docs, id, text, least)
    roots = linked(docs, text, least).select(F.col("u").alias("node"), F.col("v").alias("class"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    of = durable(ids.join(roots, "node", "left").withColumn("class", F.coalesce("class", "node")))
    first = of.groupBy("class").agg(F.min(rank).alias("first"))
    dropped = durable(skew_join(of, first, "class").filter(rank != F.col("first")).select(
        F.col("id").alias("_id"), F.col("node").alias("_node")))
    if bounded_rows(dropped, PAIRED) is not None:
        dropped = F.broadcast(dropped)
    same = F.col("node").eqNullSafe(F.col("_node")) & name(id).eqNullSafe(F.col("_id"))
    rows = with_nodes(docs, [c for c in docs.columns if c != "node"], text)
    return rows.join(dropped, same, "left_anti").select(*[name(c) for c in docs.columns])


def _one_row_of_each(docs: DataFrame, id: str, text: str, least: float) -> DataFrame:
    """``one_of_each`` where rows repeat an id and its words: they are told apart by a number in a written copy."""
    rows = durable(with_nodes(docs, docs.columns, text).withColumn("_row", F.monotonically_increasing_id()))
    roots = linked(docs, text, least).select(F.col("u").alias("node"), F.col("v").alias("class"))
    first = F.min(F.struct(name(id).isNull().alias("none"), name(id).alias("id"), F.col("_row").alias("row")))
    nodes = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(first.alias("first"))
    kept = (nodes.join(roots, "node", "left").groupBy(F.coalesce("class", "node").alias("class"))
            .agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row")))
    chosen = rows.join(kept, "_row", "left_semi").unionByName(rows.filter(F.col("node").isNull()))
    return chosen.select(*[name(c) for c in docs.columns])
