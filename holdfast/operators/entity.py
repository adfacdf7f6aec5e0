"""Records into organisations: components, display names, classes, and who must be withheld."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast import scale
from holdfast.functions.text import first_rule, personal_shape
from holdfast.operators.ordering import best, position
from holdfast.scale import durable, skew_join

# Fixed value: a holder of more licences than this is never taken for a person by its name.
PERSON_MAX_LICENCES = 5


def components(records: DataFrame, id: str, keys: Sequence[Column], root: str = "root") -> DataFrame:
    """(id, root): records that share any key, transitively; the root is the smallest id.

    A NULL key joins nothing. Every key contributes a star (member, smallest member), never
    a clique. The stars are contracted by alternating large-star and small-star steps
    (Kiveris et al., 2014), which need a logarithmic number of rounds on long chains too.
    Each round is written; joins that meet a hot centre are salted.
    """
    members = records.select(F.col(id).alias("id"), F.explode(F.array_compact(F.array(*[
        F.when(k.isNotNull(), F.struct(F.lit(i).alias("kind"), k.cast("string").alias("key")))
        for i, k in enumerate(keys)]))).alias("k")).select("id", "k.kind", "k.key")
    centres = (members.groupBy("kind", "key")
               .agg(F.min("id").alias("v"), F.max("id").alias("_max"))
               .filter(F.col("v") != F.col("_max")).drop("_max"))
    edges = (skew_join(members, centres, ["kind", "key"]).filter(F.col("id") != F.col("v"))
             .select(F.col("id").alias("u"), "v").distinct())
    found = connected(edges).select(F.col("u").alias(id), F.col("v").alias(root))
    return (records.select(id).join(found, id, "left")
            .select(id, F.coalesce(F.col(root), F.col(id)).alias(root)))


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): every vertex of the edges (u, v) but the roots, with the smallest of its component.

    Needs v < u on every edge. Alternating large-star and small-star steps, which converge whatever
    the shape of the graph: the loop ends when the edges are stars.
    """
    while True:
        edges = durable(edges)
        settled, wide = _inspect(edges)
        if settled:
            return edges
        edges = _large_star(edges, wide)
        edges = _small_star(durable(edges) if wide else edges, wide)


def _inspect(edges: DataFrame) -> tuple[bool, bool]:
    """Are the edges a forest of stars already, and is any star too wide for one task?

    They are a forest when every vertex has one edge up and no vertex has edges both up and down;
    another round would then change nothing. One pass over the edges just written.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    degrees = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    bad = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))
    row = degrees.agg(F.count_if(bad).alias("bad"), F.max(F.col("up") + F.col("down")).alias("widest")).first()
    return not row["bad"], (row["widest"] or 0) > scale.HOT_ROWS


def _with_smallest(edges: DataFrame, wide: bool) -> DataFrame:
    """Every edge with m, the smallest neighbour of its u.

    A round moves a vertex to no more edges than it has, so while the widest neighbourhood is known
    to fit a task one shuffle does. Otherwise the smallest are found map-side and joined back, with
    the hot vertices salted.
    """
    if not wide:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return skew_join(edges, low, "u")


def _large_star(edges: DataFrame, wide: bool) -> DataFrame:
    """Connect every larger neighbour of u to the smallest vertex of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_smallest(both, wide).filter(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, wide: bool) -> DataFrame:
    """Connect u and its smaller neighbours to the smallest of them. Here u > v on every edge."""
    ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                   F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return (_with_smallest(edges, wide).select(F.explode(ends).alias("e")).select("e.u", "e.v")
            .filter(F.col("u") != F.col("v")).distinct())


def person_flag(type_is_person: Column, has_company_number: Column, licences: Column, key: Column,
                not_words: Sequence[str] = (), max_licences: int = PERSON_MAX_LICENCES) -> Column:
    """The register's own flag, or: no company number, few licences and a personal-looking name."""
    second = ~has_company_number & (licences <= max_licences) & personal_shape(key, not_words)
    return F.coalesce(type_is_person, F.lit(False)) | F.coalesce(second, F.lit(False))


def entities(clients: DataFrame, *, id: str, root: str, name: str, type: str, person: str,
             licences: str) -> DataFrame:
    """One row per merged entity: display name, records, record types, person flag, licences.

    The name is that of the record with most licences (smallest id among equals); one
    flagged record flags the whole entity.
    """
    kinds = clients.groupBy(root, type).agg(
        best(name, F.col(licences), id).alias("_name"),
        F.min(F.struct((-F.col(licences)).alias("s"), F.col(id).alias("t"))).alias("_rank"),
        F.count(F.lit(1)).alias("_records"), F.bool_or(person).alias("_person"),
        F.sum(licences).alias("_licences"))
    return kinds.groupBy(root).agg(
        F.min_by("_name", "_rank").alias("name"), F.sum("_records").alias("records"),
        F.count(type).alias("types"), F.bool_or("_person").alias("person"),
        F.sum("_licences").alias("licences"))


def classify(df: DataFrame, key: str, person: str, dictionary: DataFrame, rules: Sequence[tuple[str, str]],
             name: str = "class", person_class: str = "INDIVIDUAL",
             default: str = "UNCLASSIFIED") -> DataFrame:
    """Person → fixed class; else the dictionary's exact key; else the first rule; else ``default``.

    ``dictionary`` has the columns (key, class), one row a key.
    """
    looked_up = dictionary.select(F.col("key").alias(key), F.col("class").alias("_listed"))
    by_rule = first_rule(F.col(key), rules, default)
    return (df.join(looked_up, key, "left")
            .withColumn(name, F.when(F.col(person), F.lit(person_class))
                        .otherwise(F.coalesce(F.col("_listed"), by_rule)))
            .drop("_listed"))


def dense_ids(df: DataFrame, size: str, key: str, person: str | None = None, name: str = "entity_id",
              rows_per_task: int | None = None) -> DataFrame:
    """(key, id): publishable entities numbered from 0 by descending size, then key."""
    kept = df if person is None else df.filter(~F.col(person))
    thin = durable(kept.select(key, size))
    extra = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    return position(thin, [], [F.col(size).desc(), F.col(key).asc()], name, start=0, **extra).drop(size)


def resolve_ids(df: DataFrame, key: str, ids: DataFrame, ids_key: str, name: str = "entity_id",
                probe: DataFrame | None = None) -> DataFrame:
    """Add the published id of a reference; -1 when the entity is withheld."""
    numbered = ids.select(F.col(ids_key).alias(key), F.col(name))
    return skew_join(df, numbered, key, "left", probe=probe).withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def record_types(clients: DataFrame, root: str, type: str) -> DataFrame:
    """(root, types): the sorted set of record types of every entity. Reduced to one row a type first."""
    kinds = clients.filter(F.col(type).isNotNull()).select(root, type).distinct()
    return kinds.groupBy(root).agg(F.array_sort(F.collect_list(type)).alias("types"))


def withheld_totals(entity_totals: DataFrame, person: str, sums: Mapping[str, str]) -> DataFrame:
    """Counts, and nothing but counts, of the entities that may not be named: one row."""
    return entity_totals.filter(F.col(person)).agg(
        F.count(F.lit(1)).alias("entities"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])
