"""Rollups of the device → licence → holder and device → site star."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.dates import year_token
from holdfast.operators.joins import dense, year_domain
from holdfast.operators.ordering import best
from holdfast.scale import dealt, durable, hot_hashes, skew_join


def histogram(df: DataFrame, *keys: str | Column, name: str = "rows") -> DataFrame:
    """Rows per key. Order at the sink with ``orderBy(desc(name), key)``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def licence_rows(devices: DataFrame, licence: str, transmit: str) -> DataFrame:
    """Rows and transmit rows per licence."""
    return devices.groupBy(licence).agg(F.count(F.lit(1)).alias("rows"),
                                        F.count_if(F.col(transmit)).alias("tx"))


def scalar_totals(devices: DataFrame, licences: DataFrame, licence: str, granted: str,
                  counts: Mapping[str, Column]) -> DataFrame:
    """Totals of the whole fact in one row: every count, and the same over granted licences.

    ``counts`` are predicates on device columns. The fact is counted per licence first, so the
    join to licences sees one row a licence and the unmatched rows are a column of the result.
    """
    per = devices.groupBy(licence).agg(F.count(F.lit(1)).alias("rows"),
                                       *[F.count_if(c).alias(n) for n, c in counts.items()])
    known = licences.select(licence, F.col(granted).alias("_granted"))
    joined = per.join(known, licence, "left")
    names = ["rows", *counts]
    return joined.agg(
        *[F.sum(n).alias(n) for n in names],
        *[F.coalesce(F.sum(F.when(F.col("_granted"), F.col(n))), F.lit(0)).alias(f"granted_{n}") for n in names],
        F.coalesce(F.sum(F.when(F.col("_granted").isNull(), F.col("rows"))), F.lit(0)).alias("unmatched_rows"))


def vintage(df: DataFrame, day: Column, kind: Column, kinds: Sequence[str]) -> DataFrame:
    """Rows per year for each population apart, with every year between the first and the last."""
    dated = df.select(F.year(day).alias("year"), kind.alias("kind")).filter(F.col("year").isNotNull())
    wide = dated.groupBy("year").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return dense(wide, year_domain(wide, "year"), ["year"], list(kinds))


def year_histogram(df: DataFrame, day: Column, missing: str, name: str = "rows") -> DataFrame:
    """Rows per year token; rows without a date are counted under ``missing``."""
    return df.groupBy(year_token(day, missing).alias("year")).agg(F.count(F.lit(1)).alias(name))


# --- site grain ------------------------------------------------------------------------------


def site_holders(devices: DataFrame, licences: DataFrame, *, site: str, licence: str, holder: str,
                 cls: str, person: str, granted: str, transmit: str) -> DataFrame:
    """One row per (site, holder): devices, transmit rows, licences, class, person, granted.

    Every site question is answered from this grain. The facts are first reduced to
    (site, licence); a licence spread over very many sites is salted in the join. Without hot keys the
    rows are dealt by licence for the first step and the join, and by site for what follows.
    """
    rows, hot = devices.count(), hot_hashes(devices, [licence])
    known = devices.filter(F.col(site).isNotNull()).select(site, licence, transmit)
    each = dealt(known, licence, rows, hot).groupBy(site, licence).agg(
        F.count(F.lit(1)).alias("devices"), F.count_if(F.col(transmit)).alias("tx"))
    info = licences.select(licence, F.col(holder).alias("holder"), F.col(cls).alias("class"),
                           F.col(person).alias("person"), F.col(granted).alias("granted"))
    placed = dealt(skew_join(each, info, licence, hot=hot), site, rows, hot_hashes(known, [site]))
    return (placed.groupBy(site, "holder", "class", "person")
            .agg(F.sum("devices").alias("devices"), F.sum("tx").alias("tx"),
                 F.count(F.lit(1)).alias("licences"), F.bool_or("granted").alias("granted")))


def site_rollup(tenants: DataFrame, site: str) -> DataFrame:
    """Per live site: devices, transmit rows, licences, holders, person-only and publishable flags.

    A site is person-only when every one of its devices belongs to a withheld holder, in any
    status; it is publishable when it is not person-only and some licence is granted.
    """
    rolled = tenants.groupBy(site).agg(
        F.sum("devices").alias("devices"), F.sum("tx").alias("tx"), F.sum("licences").alias("licences"),
        F.count(F.lit(1)).alias("holders"), F.bool_and("person").alias("person_only"),
        F.bool_or("granted").alias("_granted"))
    return rolled.withColumn("publishable", ~F.col("person_only") & F.col("_granted")).drop("_granted")


def modal_class(tenants: DataFrame, site: str, name: str = "class") -> DataFrame:
    """The class with most holders at each site; the first class by name wins among equals."""
    per_class = tenants.groupBy(site, "class").agg(F.count(F.lit(1)).alias("n"))
    return per_class.groupBy(site).agg(best("class", "n", "class").alias(name))


# --- entity grain ----------------------------------------------------------------------------


def entity_totals(entities: DataFrame, per_licence: DataFrame, tenants: DataFrame, *, key: str,
                  holder: str, site: str) -> DataFrame:
    """Devices, transmit rows and live sites of every entity, zero when it has none.

    Each fact is brought to the entity grain before anything is joined, so nothing fans out.
    """
    devices = per_licence.groupBy(F.col(holder).alias(key)).agg(
        F.sum("rows").alias("devices"), F.sum("tx").alias("tx"))
    sites = tenants.groupBy(F.col("holder").alias(key)).agg(F.count(F.lit(1)).alias("sites"))
    return (entities.join(devices, key, "left").join(sites, key, "left")
            .fillna(0, subset=["devices", "tx", "sites"]))


def holder_totals(entities: DataFrame, devices: DataFrame, owners: DataFrame, *, key: str, licence: str,
                  site: str, transmit: str) -> DataFrame:
    """Devices, transmit rows and live sites of every entity, zero when it has none, from one join.

    ``owners`` gives each licence its entity; licences it does not list are left out, so that owners of a
    few entities make their totals alone. Devices are brought to (licence, site) before the join, those
    without a site too, and to (entity, site) after it: the same rows give devices and sites.
    """
    each = devices.groupBy(licence, site).agg(F.count(F.lit(1)).alias("devices"), F.count_if(F.col(transmit)).alias("tx"))
    placed = skew_join(each, owners.select(licence, key), licence, probe=devices).groupBy(key, site).agg(
        F.sum("devices").alias("devices"), F.sum("tx").alias("tx"))
    per = placed.groupBy(key).agg(F.sum("devices").alias("devices"), F.sum("tx").alias("tx"), F.count(site).alias("sites"))
    return entities.join(per, key, "left").fillna(0, subset=["devices", "tx", "sites"])


def class_totals(totals: DataFrame, cls: str, sums: Sequence[str], classes: DataFrame | None = None) -> DataFrame:
    """Sums and number of entities per class, with every class of the domain present."""
    rolled = totals.groupBy(cls).agg(*[F.sum(c).alias(c) for c in sums],
                                     F.count(F.lit(1)).alias("entities"))
    return rolled if classes is None else dense(rolled, classes, [cls], [*sums, "entities"])


def matrix(df: DataFrame, row: str, column: str, rows: DataFrame, columns: DataFrame,
           name: str = "licences", weight: str | None = None) -> DataFrame:
    """Long form of row × column counts with every combination of the two domains.

    The columns meet the rows as one array; ``weight`` sums a column where the rows are counts already.
    """
    counted = df.groupBy(row, column).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias(name))
    one = F.lit(1).alias("_one")
    listed = columns.select(one, column).groupBy("_one").agg(F.collect_set(column).alias("_listed"))
    # One row: the only thing ever broadcast here.
    domain = (rows.select(one, row).distinct().join(F.broadcast(listed), "_one")
              .select(row, F.explode("_listed").alias(column)))
    return dense(counted, domain, [row, column], [name])


def shares(df: DataFrame, cls: str, sums: Mapping[str, str], least: float) -> DataFrame:
    """Each class's share of two totals, and their ratio; classes above ``least`` on either share.

    ``sums`` maps the two output names to columns: the share of the first, of the second, and
    second per unit of the first.
    """
    (a, col_a), (b, col_b) = sums.items()
    per = durable(df.groupBy(cls).agg(F.sum(col_a).alias(a), F.sum(col_b).alias(b)))
    total = per.agg(F.sum(a).alias("a"), F.sum(b).alias("b")).first()
    out = (per.withColumn(f"{a}_share", F.try_divide(F.col(a) * 100.0, F.lit(float(total["a"] or 0))))
           .withColumn(f"{b}_share", F.try_divide(F.col(b) * 100.0, F.lit(float(total["b"] or 0))))
           .withColumn(f"{b}_per_{a}", F.col(b).cast("double") / F.greatest(F.lit(1), F.col(a))))
    return out.filter((F.col(f"{a}_share") > least) | (F.col(f"{b}_share") > least))


# --- region grain ----------------------------------------------------------------------------


def region_rollup(sites: DataFrame, tenants: DataFrame, regions: DataFrame, *, site: str,
                  region: str, probe: DataFrame | None = None) -> DataFrame:
    """Sites, live sites, devices, holders and largest named holder of every region of ``regions``.

    ``sites`` gives the region of every site, live or not. Holder counts come from the
    (region, holder) grain, which is reduced before it is ranked. The tenants are placed once
    and checkpointed, because two rollups read them.
    """
    placed = sites.filter(F.col(region).isNotNull())
    all_sites = placed.groupBy(region).agg(F.count(F.lit(1)).alias("sites"))
    joined = durable(skew_join(tenants, placed.select(site, region), site, probe=probe))
    live = (joined.select(region, site).distinct()
            .groupBy(region).agg(F.count(F.lit(1)).alias("live")))
    held = joined.groupBy(region, "holder", "class", "person").agg(
        F.count(F.lit(1)).alias("n"), F.sum("devices").alias("_d"))
    named = F.when(~F.col("person"), F.col("holder"))
    ranked = held.groupBy(region).agg(
        F.sum("_d").alias("devices"), F.count(F.lit(1)).alias("holders"),
        F.min_by(named, F.when(~F.col("person"), F.struct((-F.col("n")).alias("s"), F.col("holder").alias("t"))))
        .alias("top_holder"),
        F.max(F.when(~F.col("person"), F.col("n"))).alias("top_holder_sites"))
    out = regions
    for part in (all_sites, live, ranked):
        out = out.join(part, region, "left")
    return out.fillna(0, subset=["sites", "live", "devices", "holders", "top_holder_sites"])


def region_classes(tenants_with_region: DataFrame, region: str) -> DataFrame:
    """Holder-at-site counts per class and region: each organisation once per site it is at."""
    return tenants_with_region.groupBy(region, "class").agg(F.count(F.lit(1)).alias("n"))


# --- ratios ----------------------------------------------------------------------------------


def ratio_table(bars: Mapping[str, DataFrame]) -> DataFrame:
    """(label, n, of, share) from one-row tables of (n, of): a share never goes without both."""
    rows = [df.select(F.lit(label).alias("label"), F.col("n").cast("long"), F.col("of").cast("long"))
            for label, df in bars.items()]
    return reduce(DataFrame.unionByName, rows).withColumn(
        "share", F.try_divide(F.col("n").cast("double"), F.col("of").cast("double")))


def share_bar(df: DataFrame, condition: Column) -> DataFrame:
    """One row (n, of): the rows that satisfy a condition, and all of them."""
    return df.agg(F.count_if(condition).alias("n"), F.count(F.lit(1)).alias("of"))
