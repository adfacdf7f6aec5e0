"""Queries on bands, bins, exact values, pairs and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import log_bin, log_bin_edge, ratio_floor_one
from holdfast.operators import bands as B
from holdfast.operators import blocks as K
from holdfast.operators import intervals as I
from holdfast.operators import pairing as P
from holdfast.operators.concentration import stacked
from holdfast.operators.joins import dense
from holdfast.operators.ordering import share_of_group, top_per_group
from holdfast.plans.registry import BANDS_SQL, PRICE_BANDS, REGISTER_SQL, Tables, query
from holdfast.scale import durable, skew_join

KEY = ["licence", "site", "value", "direction"]
BANDED = f"""WITH {BANDS_SQL}, {REGISTER_SQL},
fact AS (SELECT * FROM dev JOIN lic USING (licence)
         JOIN bands ON value >= lo AND (hi IS NULL OR value < hi) AND value > 0)
"""


def held(t: Tables) -> DataFrame:
    return B.holder_bands(t.banded_devices, t.owners, band="band", licence="licence", holder=["holder"],
                          key=KEY, transmit="tx")


def by_holder(t: Tables) -> DataFrame:
    """Holders per band; class and person flag join at that grain, where no holder is hot."""
    return held(t).join(t.clients.drop("name"), "holder")


@query(f"""{BANDED}
SELECT b.band, b.band_name, count(f.licence) AS rows, count(f.licence) FILTER (WHERE tx) AS tx,
       count(DISTINCT CASE WHEN f.licence IS NOT NULL THEN (f.licence, site, value, direction) END) AS assignments,
       count(DISTINCT f.licence) AS licences, count(DISTINCT holder) AS holders
FROM bands b LEFT JOIN fact f USING (band) GROUP BY b.band, b.band_name""")
def band_rollup(t: Tables) -> DataFrame:
    """Rows, transmit rows, assignments, licences and holders of every band, empty ones too."""
    rolled = B.band_rollup(held(t), "band")
    return dense(rolled, t.bands.select("band", "band_name"), ["band"],
                 ["rows", "tx", "assignments", "licences", "holders"])


@query(f"""{BANDED}
SELECT band, holder, rows, rank FROM (
  SELECT band, holder, count(*) AS rows,
         row_number() OVER (PARTITION BY band ORDER BY count(*) DESC, holder) AS rank
  FROM fact WHERE NOT person GROUP BY band, holder) WHERE rank <= 12""")
def band_top_holders(t: Tables) -> DataFrame:
    """The twelve largest named holders of every band, by their rows in that band."""
    named = by_holder(t).filter(~F.col("person")).select("band", "holder", "rows")
    return top_per_group(named, ["band"], [F.desc("rows"), F.asc("holder")], 12)


@query(f"""{BANDED}, mix AS (SELECT band, class, count(*) AS rows FROM fact GROUP BY band, class)
SELECT band, class, rows, rows / sum(rows) OVER (PARTITION BY band) AS share,
       (sum(rows) OVER (PARTITION BY band ORDER BY rows DESC, class) - rows)
         / sum(rows) OVER (PARTITION BY band) AS "offset" FROM mix""")
def band_composition(t: Tables) -> DataFrame:
    """Share of every class in every band, and where its piece of a stacked column starts."""
    return stacked(B.class_mix(by_holder(t), "band", "class"), ["band"], "rows", "class")


@query(f"""{BANDED}
SELECT band, class, rows, rank FROM (
  SELECT band, class, count(*) AS rows,
         row_number() OVER (PARTITION BY band ORDER BY count(*) DESC, class) AS rank
  FROM fact GROUP BY band, class) WHERE rank <= 3""")
def band_top_classes(t: Tables) -> DataFrame:
    mix = B.class_mix(by_holder(t), "band", "class")
    return top_per_group(mix, ["band"], [F.desc("rows"), F.asc("class")], 3)


@query(f"""{BANDED}, r AS (
  SELECT band, count(*) AS rows, count(DISTINCT (licence, site, value, direction)) AS assignments
  FROM fact GROUP BY band)
SELECT band, rows / greatest(1, assignments) AS rows_per_assignment FROM r""")
def band_rows_per_assignment(t: Tables) -> DataFrame:
    return B.band_rollup(held(t), "band").select(
        "band", ratio_floor_one(F.col("rows"), F.col("assignments")).alias("rows_per_assignment"))


@query(f"""{BANDED}, h AS (SELECT band, holder, count(*) AS rows FROM fact WHERE NOT person GROUP BY ALL),
w AS (SELECT band, count(*) AS n FROM fact GROUP BY band),
k AS (SELECT band, holder, h.rows, h.rows / greatest(1, n) AS share,
             row_number() OVER (PARTITION BY band ORDER BY h.rows DESC, holder) AS place
      FROM h JOIN w USING (band))
SELECT holder, band, rows, share, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY holder ORDER BY rows DESC, band) AS rank
  FROM k WHERE place <= 12) WHERE rank <= 10""")
def holder_bands(t: Tables) -> DataFrame:
    """For every holder in some band's top twelve: the ten bands it is largest in, with its share."""
    per_holder = durable(by_holder(t))
    listed = top_per_group(per_holder.filter(~F.col("person")).select("band", "holder", "rows"), ["band"],
                           [F.desc("rows"), F.asc("holder")], 12, "place").drop("place")
    whole = B.band_rollup(per_holder, "band").select("band", F.col("rows").alias("_whole"))
    shared = listed.join(whole, "band").withColumn("share", ratio_floor_one(F.col("rows"), F.col("_whole")))
    return top_per_group(shared.drop("_whole"), ["holder"], [F.desc("rows"), F.asc("band")], 10)


EVENT_AXIS = {"low": 0.01, "high": 1000.0, "per_decade": 24}
EVENT_BINS = """SELECT CAST(floor(log10(value / 0.01) * 24) AS INTEGER) AS bin, user_id,
  event_type = 'purchase' AS tx FROM events WHERE value >= 0.01 AND value < 1000"""


def event_bins(t: Tables) -> DataFrame:
    return B.bin_rollup(t.events, F.col("value"), "user_id", F.col("event_type") == "purchase", **EVENT_AXIS)


@query(f"""WITH b AS ({EVENT_BINS})
SELECT bin, count(*) AS rows, count(*) FILTER (WHERE tx) AS tx, count(DISTINCT user_id) AS holders
FROM b GROUP BY bin""")
def log_bin_rollup(t: Tables) -> DataFrame:
    """Rows, transmit rows and holders per constant-ratio bin."""
    return event_bins(t)


@query(f"""WITH b AS (SELECT CAST(floor(log10(value / 0.01) * 24) AS INTEGER) AS bin, event_type
                      FROM events WHERE value >= 0.01 AND value < 1000)
SELECT bin, event_type AS class, count(*) AS rows FROM b GROUP BY bin, event_type""")
def log_bin_composition(t: Tables) -> DataFrame:
    binned = t.events.select(log_bin(F.col("value"), **EVENT_AXIS).alias("bin"), F.col("event_type").alias("class"))
    return binned.filter("bin >= 0").groupBy("bin", "class").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH b AS ({EVENT_BINS}), r AS (SELECT bin, count(*) AS rows FROM b GROUP BY bin)
SELECT bin, rows FROM r
WHERE 0.01 * pow(10, (bin + 1) / 24) > 1.5 AND 0.01 * pow(10, bin / 24) < 47""")
def bins_in_view(t: Tables) -> DataFrame:
    """Bins that overlap the part of the axis in view."""
    rolled = event_bins(t).withColumns({
        "lo": log_bin_edge(F.col("bin"), 0.01), "hi": log_bin_edge(F.col("bin") + 1, 0.01)})
    return B.overlapping(rolled, "lo", "hi", (1.5, 47.0)).select("bin", "rows")


@query(f"""WITH {BANDS_SQL} SELECT band, band_name FROM bands
WHERE (hi IS NULL OR hi > 3000) AND lo < 26000 AND band IN (
  SELECT b.band FROM lineitem JOIN bands b ON l_extendedprice >= b.lo AND (b.hi IS NULL OR l_extendedprice < b.hi))""")
def bands_in_view(t: Tables) -> DataFrame:
    used = t.banded_devices.select("band").distinct()
    return B.overlapping(t.bands, "lo", "hi", (3000.0, 26000.0)).join(used, "band", "left_semi") \
        .select("band", "band_name")


@query(f"""WITH {REGISTER_SQL}
SELECT value, count(*) AS rows, count(*) FILTER (WHERE tx) AS tx, count(DISTINCT licence) AS licences
FROM dev JOIN lic USING (licence) WHERE granted GROUP BY value""")
def exact_value_rollup(t: Tables) -> DataFrame:
    """Rows, transmit rows and licences per exact value, over granted licences."""
    granted = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("licence"))
    return B.value_rollup(t.devices, granted, value="value", licence="licence", transmit="tx")


@query("""WITH v AS (SELECT l_quantity AS value, count(*) AS rows FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT value, rows FROM v ORDER BY rows DESC, value LIMIT 1""")
def busiest_value(t: Tables) -> DataFrame:
    granted = t.orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("licence"))
    devices = t.lineitem.select(F.col("l_orderkey").alias("licence"), F.col("l_quantity").alias("value"),
                                (F.col("l_linestatus") == "O").alias("tx"))
    rolled = B.value_rollup(devices, granted, value="value", licence="licence", transmit="tx")
    return rolled.agg(F.min_by("value", F.struct(-F.col("rows"), F.col("value"))).alias("value"),
                      F.max("rows").alias("rows"))


@query("""WITH v AS (SELECT l_quantity AS value, count(*) AS rows FROM lineitem GROUP BY 1)
SELECT value, rows FROM v WHERE value BETWEEN 10 AND 20""")
def values_in_view(t: Tables) -> DataFrame:
    counted = t.lineitem.groupBy(F.col("l_quantity").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return B.within(counted, "value", (10.0, 20.0))


@query("""SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_suppkey, l_returnflag)) AS assignments,
count(*) / count(DISTINCT (l_orderkey, l_suppkey, l_returnflag)) AS ratio FROM lineitem WHERE l_suppkey IS NOT NULL""")
def assignment_ratio(t: Tables) -> DataFrame:
    one = B.assignment_ratio(t.lineitem, ["l_orderkey", "l_suppkey", "l_returnflag"], "l_suppkey")
    return one.withColumn("ratio", F.col("rows") / F.col("assignments"))


@query("""WITH iv AS (SELECT n_nationkey AS interval_id, n_nationkey * 20000.0 AS lo,
  CASE WHEN n_nationkey < 24 THEN (n_nationkey + 1) * 20000.0 END AS hi FROM nation)
SELECT interval_id, count(o_orderkey) AS rows, count(DISTINCT o_custkey) AS holders
FROM orders LEFT JOIN iv ON lo <= o_totalprice AND (hi IS NULL OR o_totalprice < hi) GROUP BY interval_id""")
def interval_rollup(t: Tables) -> DataFrame:
    """The same range question against an interval table of any size."""
    key = F.col("n_nationkey")
    intervals = t.nation.select(key.alias("interval_id"), (key * 20000.0).alias("lo"),
                                F.when(key < 24, (key + 1) * 20000.0).alias("hi"))
    facts = t.orders.select("o_custkey", "o_totalprice")
    joined = B.range_join(facts, "o_totalprice", intervals, low=100.0, high=1e6)
    each = joined.groupBy("interval_id", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("interval_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("holders"))


# --- pairs -----------------------------------------------------------------------------------

SIDES = """s AS (SELECT l_orderkey AS grp, l_linestatus = 'O' AS one, l_extendedprice AS value,
  row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_extendedprice) AS position FROM lineitem),
p AS (SELECT a.grp, a.position, a.value AS first, b.value AS second FROM s a JOIN s b
      ON a.grp = b.grp AND a.position = b.position WHERE a.one AND NOT b.one),
g AS (SELECT *, floor(abs(first - second) / 1000.0 * 1000.0 + 0.5) / 1000.0 AS gap FROM p WHERE first <> second)"""


def pairs(t: Tables, value: str = "l_extendedprice") -> DataFrame:
    sides = t.lineitem.select(F.col("l_orderkey").alias("grp"), F.col(value).alias("value"), "l_linestatus")
    return P.ordinal_pairs(sides, ["grp"], "value", F.col("l_linestatus") == "O")


@query(f"""WITH {SIDES} SELECT grp, position, first, second FROM p""")
def ordinal_pairs(t: Tables) -> DataFrame:
    """The n-th smallest value of either side of every group, as far as the shorter side goes."""
    return pairs(t)


@query(f"""WITH {SIDES} SELECT gap, count(*) AS pairs FROM g GROUP BY gap""")
def gap_histogram(t: Tables) -> DataFrame:
    return P.gap_histogram(P.gaps(pairs(t), unit=1000.0))


@query(f"""WITH {SIDES.replace("l_extendedprice", "l_quantity")}, c AS (
  SELECT floor(least(first, second) / 0.001 + 0.5) / 1000 AS low,
         floor(greatest(first, second) / 0.001 + 0.5) / 1000 AS high, count(*) AS links FROM g GROUP BY ALL)
SELECT low, high, links FROM c ORDER BY links DESC, low, high LIMIT 900""")
def top_pairs(t: Tables) -> DataFrame:
    """The commonest (low, high) pairs."""
    return P.top_pairs(P.gaps(pairs(t, "l_quantity"), unit=1.0), 900, unit=1.0)


@query(f"""WITH {SIDES} SELECT 'groups' AS metric, count(DISTINCT l_orderkey) AS n FROM lineitem
UNION ALL SELECT 'paired_groups', count(DISTINCT grp) FROM g""")
def pairing_totals(t: Tables) -> DataFrame:
    groups = t.lineitem.select(F.col("l_orderkey").alias("grp"))
    return P.pairing_totals(groups, P.gaps(pairs(t), unit=1000.0), ["grp"])


@query(f"""WITH {SIDES.replace("l_extendedprice", "l_quantity")}, c AS (
  SELECT least(first, second) AS low, greatest(first, second) AS high, count(*) AS links FROM g GROUP BY ALL)
SELECT low, high, links FROM c WHERE low >= 10 AND high <= 30""")
def pairs_in_view(t: Tables) -> DataFrame:
    counted = P.gaps(pairs(t, "l_quantity"), unit=1.0).groupBy(
        F.least("first", "second").alias("low"), F.greatest("first", "second").alias("high")
    ).agg(F.count(F.lit(1)).alias("links"))
    return B.pairs_within(counted, "low", "high", (10.0, 30.0))


# --- blocks ----------------------------------------------------------------------------------

BLOCKS = f"""{BANDS_SQL}, blk AS (
  SELECT l_orderkey AS licence, l_suppkey AS holder, l_partkey AS area, p_type AS market, band,
         l_quantity AS lower, CASE WHEN l_returnflag = 'R' THEN round(l_discount * 100) END AS upper
  FROM lineitem JOIN part ON p_partkey = l_partkey
  JOIN bands ON l_extendedprice >= lo AND (hi IS NULL OR l_extendedprice < hi)),
held AS (SELECT market, band, holder, sum(lower + coalesce(upper, 0)) AS width, sum(lower) AS lower,
                coalesce(sum(upper), 0) AS upper, count(DISTINCT licence) AS licences
         FROM blk WHERE NOT regexp_matches(market, '(?i)^promo') GROUP BY ALL)"""


def block_rows(t: Tables) -> DataFrame:
    areas = t.part.select(F.col("p_partkey").alias("area"), F.col("p_type").alias("market"))
    line = t.lineitem.select(
        F.col("l_orderkey").alias("licence"), F.col("l_suppkey").alias("holder"), F.col("l_partkey").alias("area"),
        PRICE_BANDS.index(F.col("l_extendedprice")).alias("band"), F.col("l_quantity").alias("lower"),
        F.when(F.col("l_returnflag") == "R", F.round(F.col("l_discount") * 100)).alias("upper"))
    return line, areas


def holdings(t: Tables) -> DataFrame:
    line, areas = block_rows(t)
    named = K.named_areas(areas, "market", "^promo")
    return K.block_holdings(skew_join(line, named, "area"), market="market", band="band", holder="holder",
                            licence="licence", lower=F.col("lower"), upper=F.col("upper"))


@query(f"WITH {BLOCKS} SELECT * FROM held")
def block_holdings(t: Tables) -> DataFrame:
    """Width held per market, band and holder: both blocks of a pair, several blocks per key."""
    return holdings(t)


@query(f"""WITH {BLOCKS}, a AS (SELECT holder, area, sum(lower + coalesce(upper, 0)) AS w FROM blk GROUP BY ALL),
n AS (SELECT holder, floor(sum(w) + 0.5) AS naive, floor(max(w) + 0.5) AS in_one_area, count(*) AS areas
      FROM a GROUP BY holder)
SELECT holder, naive, in_one_area, areas, naive / in_one_area AS overstatement
FROM n ORDER BY naive DESC, holder LIMIT 12""")
def naive_vs_one_area(t: Tables) -> DataFrame:
    """The sum over all areas against the most held in one area, and how far the first overstates."""
    line, _ = block_rows(t)
    return K.naive_and_one_area(line, holder="holder", area="area",
                                width=F.col("lower") + F.coalesce("upper", F.lit(0.0)))


@query(f"""WITH {BLOCKS}, h AS (SELECT market, holder, sum(width) AS w FROM held GROUP BY ALL)
SELECT market, sum(w) AS width, count(*) AS holders, arg_max(holder, (w, -holder)) AS largest,
       max(w) AS largest_width FROM h GROUP BY market""")
def market_summary(t: Tables) -> DataFrame:
    return K.market_summary(holdings(t), "market", "holder")


@query(f"""WITH {BLOCKS} SELECT *, width / sum(width) OVER (PARTITION BY market, band) AS share,
sum(width) OVER (PARTITION BY market, band) AS column_width FROM held""")
def market_shares(t: Tables) -> DataFrame:
    return K.market_shares(holdings(t), "market", "band")


# A line holds as many hundredths from its price on as its quantity times ten: whole numbers, so sums are exact.
STRETCHES = """iv AS (SELECT l_suppkey AS holder, CAST(round(l_extendedprice * 100) AS BIGINT) AS lo,
  CAST(round(l_extendedprice * 100) + l_quantity * 1000 AS BIGINT) AS hi FROM lineitem),
reach AS (SELECT *, max(hi) OVER (PARTITION BY holder ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv),
numbered AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR lo > before)
  OVER (PARTITION BY holder ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS n FROM reach),
stretch AS (SELECT holder, min(lo) AS lo, max(hi) AS hi, count(*) AS blocks FROM numbered GROUP BY holder, n)"""


def held_intervals(t: Tables) -> DataFrame:
    low = F.round(F.col("l_extendedprice") * 100)
    return t.lineitem.select(F.col("l_suppkey").alias("holder"), low.cast("long").alias("lo"),
                             (low + F.col("l_quantity") * 1000).cast("long").alias("hi"))


@query(f"WITH {STRETCHES} SELECT holder, lo, hi, blocks FROM stretch")
def interval_islands(t: Tables) -> DataFrame:
    """The stretches each holder covers, overlapping and touching intervals as one."""
    return I.islands(held_intervals(t), ["holder"], "lo", "hi")


@query(f"""WITH {STRETCHES}, u AS (SELECT holder, CAST(sum(hi - lo) AS BIGINT) AS width, count(*) AS stretches FROM stretch GROUP BY holder)
SELECT holder, count(*) AS blocks, CAST(sum(hi - lo) AS BIGINT) AS summed, any_value(u.width) AS width, any_value(u.stretches) AS stretches
FROM iv JOIN u USING (holder) GROUP BY holder""")
def interval_union(t: Tables) -> DataFrame:
    """The width each holder covers, beside the sum of its intervals, which counts overlaps again."""
    return I.union_width(held_intervals(t), ["holder"], "lo", "hi")


@query("""WITH k AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated_keys,
max(n) AS most FROM k""")
def composite_key_blocks(t: Tables) -> DataFrame:
    """How many blocks the composite key (licence, area) carries: the cardinality gate of the join."""
    from holdfast.operators.joins import composite_cardinality
    return composite_cardinality(t.lineitem, ["l_orderkey", "l_suppkey"])


@query(f"""{BANDED}, r AS (SELECT band, count(*) AS rows FROM fact GROUP BY band)
SELECT band, rows, rows / sum(rows) OVER () AS share FROM r""")
def band_share(t: Tables) -> DataFrame:
    rolled = B.band_rollup(held(t), "band").select("band", "rows").withColumn("_all", F.lit(1))
    return share_of_group(rolled, ["_all"], "rows").drop("_all")


@query("""WITH iv AS (SELECT n_nationkey AS interval_id, n_nationkey * 400.0 - 1000 AS lo,
  CASE WHEN n_nationkey < 24 THEN n_nationkey * 400.0 - 600 END AS hi FROM nation),
v AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN CAST('nan' AS DOUBLE)
        ELSE c_acctbal END AS value FROM customer)
SELECT interval_id, count(*) AS rows, count(value) FILTER (WHERE value <= 0 OR isnan(value)) AS outside
FROM v LEFT JOIN iv ON NOT isnan(value) AND value > 0 AND lo <= value AND (hi IS NULL OR value < hi) GROUP BY interval_id""")
def range_join_missing(t: Tables) -> DataFrame:
    """Rows per interval where values are NULL, NaN, negative or zero as well: those are in no interval."""
    iv = t.nation.select(
        F.col("n_nationkey").alias("interval_id"), (F.col("n_nationkey") * 400.0 - 1000).alias("lo"),
        F.when(F.col("n_nationkey") < 24, F.col("n_nationkey") * 400.0 - 600).alias("hi"))
    kind = F.col("c_custkey") % 7
    values = t.customer.select(F.when(kind == 1, F.lit(float("nan"))).when(kind != 0, F.col("c_acctbal").cast("double")).alias("value"))
    joined = B.range_join(values, "value", iv)
    return joined.groupBy("interval_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when((F.col("value") <= 0) | F.isnan("value"), 1)).alias("outside"))
