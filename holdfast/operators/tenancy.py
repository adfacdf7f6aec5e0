"""Who shares a site with whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.scale import broadcast_if_small

# Up to so many classes a site's signature is a 64-bit mask, one bit a class; beyond that, an array.
MASK_CLASSES = 62


def class_signatures(tenants: DataFrame, site: str, numbered: DataFrame) -> DataFrame:
    """(mask, same, sites): how many sites have exactly this set of classes.

    ``mask`` has a bit for every class present at the site, ``same`` a bit for every class with
    two or more holders there. A site is 16 bytes of state however many tenants it has, and the
    pairs are made from the distinct signatures rather than from the sites.
    """
    per_class = tenants.groupBy(site, "class").agg(F.count(F.lit(1)).alias("n"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i"))
    joined = per_class.join(F.broadcast(numbered), "class").withColumn("_bit", bit)
    per_site = joined.groupBy(site).agg(
        F.bit_or("_bit").alias("mask"),
        F.bit_or(F.when(F.col("n") > 1, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias("same"))
    return per_site.groupBy("mask", "same").agg(F.count(F.lit(1)).alias("sites"))


def class_pairs(tenants: DataFrame, site: str, classes: DataFrame) -> DataFrame:
    """Unordered class pairs (a <= b) with the sites that host both.

    ``sites`` counts presence, so the diagonal a|a is every site with class a;
    ``same_class_sites`` is that diagonal under the stricter reading of two or more holders of
    the class at the site (for a pair of different classes the two columns agree).
    """
    numbered = numbered_classes(classes)
    if numbered is None:
        return _pairs_of_arrays(tenants, site, classes)
    present = F.filter(F.sequence(F.lit(0), F.lit(MASK_CLASSES - 1)),
                       lambda i: F.call_function("getbit", F.col("mask"), i) == 1)
    first = class_signatures(tenants, site, numbered).withColumn("_bits", present) \
        .select("same", "sites", "_bits", F.explode("_bits").alias("i"))
    both = first.select("same", "sites", "i", F.explode(F.filter("_bits", lambda j: j >= F.col("i"))).alias("j"))
    same = (F.col("i") != F.col("j")) | (F.call_function("getbit", F.col("same"), F.col("i")) == 1)
    counted = both.groupBy("i", "j").agg(
        F.sum("sites").alias("sites"),
        F.sum(F.when(same, F.col("sites")).otherwise(0)).alias("same_class_sites"))
    a = F.broadcast(numbered.select(F.col("_i").alias("i"), F.col("class").alias("a")))
    b = F.broadcast(numbered.select(F.col("_i").alias("j"), F.col("class").alias("b")))
    return counted.join(a, "i").join(b, "j").select("a", "b", "sites", "same_class_sites")


def _pairs_of_arrays(tenants: DataFrame, site: str, classes: DataFrame) -> DataFrame:
    """``class_pairs`` for any number of classes: a site's signature is the sorted array of its classes."""
    column = classes.columns[0]
    listed = classes.select(F.col(column).alias("class")).distinct()
    per_class = tenants.groupBy(site, "class").agg(F.count(F.lit(1)).alias("n")).join(listed, "class", "left_semi")
    per_site = per_class.groupBy(site).agg(F.sort_array(F.collect_list(F.struct("class", (F.col("n") > 1).alias("two")))).alias("set"))
    signatures = per_site.groupBy("set").agg(F.count(F.lit(1)).alias("sites"))
    first = signatures.select("sites", "set", F.explode("set").alias("x"))
    both = first.select("sites", "x", F.explode(F.filter("set", lambda y: y["class"] >= F.col("x.class"))).alias("y"))
    same = (F.col("x.class") != F.col("y.class")) | F.col("x.two")
    return both.groupBy(F.col("x.class").alias("a"), F.col("y.class").alias("b")).agg(
        F.sum("sites").alias("sites"), F.sum(F.when(same, F.col("sites")).otherwise(0)).alias("same_class_sites"))


def pair_totals(pairs: DataFrame) -> DataFrame:
    """Each pair credited to both of its classes, the diagonal once."""
    ends = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("class"), "sites")
    return ends.groupBy("class").agg(F.sum("sites").alias("pairings"))


def numbered_classes(classes: DataFrame) -> DataFrame | None:
    """(class, _i): classes numbered in order of name; None when there are more than a mask has bits for."""
    column = classes.columns[0]
    names = [r[0] for r in classes.select(column).distinct().orderBy(column).limit(MASK_CLASSES + 1).collect()]
    if len(names) > MASK_CLASSES:
        return None
    kind = classes.schema[column].dataType
    return classes.sparkSession.createDataFrame(
        [(n, i) for i, n in enumerate(names)], f"class {kind.simpleString()}, _i int")


def crowded_sites(site_totals: DataFrame, site: str, least: int = 6, top: int = 400,
                  named_holders: DataFrame | None = None) -> DataFrame:
    """The ``top`` sites with at least ``least`` holders, by named holders, then all, then key.

    The threshold counts every holder; the listing names only those that may be named, so both
    counts are given. ``named_holders`` has (site, n).
    """
    crowded = site_totals.filter(F.col("holders") >= least)
    if named_holders is not None:
        crowded = crowded.join(named_holders.withColumnRenamed("n", "named"), site, "left").fillna(0, ["named"])
    else:
        crowded = crowded.withColumn("named", F.col("holders"))
    return crowded.orderBy(F.desc("named"), F.desc("holders"), F.asc(site)).limit(top)


def tenant_list(crowded: DataFrame, tenants: DataFrame, site: str) -> DataFrame:
    """(site, holder) of the named tenants of the sites listed: long form, one row a tenant."""
    return tenants.filter(~F.col("person")).join(
        broadcast_if_small(crowded.select(site)), site, "left_semi").select(site, "holder")


def sharing_split(site_totals: DataFrame) -> DataFrame:
    """Sites with a single holder and sites shared: one row."""
    return site_totals.agg(F.count_if(F.col("holders") == 1).alias("single_holder"),
                           F.count_if(F.col("holders") > 1).alias("shared"))
