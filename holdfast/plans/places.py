"""Queries on sites, regions, tenants and points."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.numbers import half_up, log_share, ramp_breakpoint, ramp_bucket, ratio, ratio_floor_one
from holdfast.operators import geo as G
from holdfast.operators import rollups as R
from holdfast.operators import tenancy as N
from holdfast.operators.joins import dense, search
from holdfast.operators.ordering import best, top_per_group
from holdfast.plans.registry import MAST_SQL, REGISTER_SQL, Tables, query
from holdfast.scale import durable, skew_join
from holdfast.sources import polygons


def mast_tenants(t: Tables) -> DataFrame:
    return t.once("tenants", lambda: R.site_holders(
        t.mast_devices, t.mast_licences, site="site", licence="licence", holder="holder", cls="class",
        person="person", granted="granted", transmit="tx"))


def kept_tenants(t: Tables) -> DataFrame:
    """The same, written once: for queries that read it more than once."""
    return t.once("kept_tenants", lambda: durable(mast_tenants(t)))


@query(f"""WITH {MAST_SQL}
SELECT site, CAST(sum(devices) AS BIGINT) AS devices, CAST(sum(tx) AS BIGINT) AS tx, count(*) AS licences,
 count(*) AS holders, bool_and(person) AS person_only, NOT bool_and(person) AND bool_or(granted) AS publishable
FROM tenants GROUP BY site""")
def site_rollup(t: Tables) -> DataFrame:
    """Devices, licences, holders and the suppression flags of every live site."""
    return R.site_rollup(mast_tenants(t), "site")


@query(f"""WITH {REGISTER_SQL}
SELECT site, count(*) AS devices, count(*) FILTER (WHERE tx) AS tx, count(DISTINCT licence) AS licences,
 count(DISTINCT holder) AS holders, bool_and(person) AS person_only,
 NOT bool_and(person) AND bool_or(granted) AS publishable
FROM dev JOIN lic USING (licence) GROUP BY site""")
def part_site_rollup(t: Tables) -> DataFrame:
    """The same over the register star, where a holder has several licences at a site."""
    tenants = R.site_holders(t.devices, t.licences, site="site", licence="licence", holder="holder", cls="class",
                             person="person", granted="granted", transmit="tx")
    return R.site_rollup(tenants, "site")


@query(f"""WITH {MAST_SQL}, s AS (SELECT site, bool_and(person) AS p, bool_or(granted) AS g FROM tenants GROUP BY site)
SELECT count(*) FILTER (WHERE p) AS person_only, count(*) FILTER (WHERE NOT p AND g) AS publishable, count(*) AS live
FROM s""")
def suppressed_sites(t: Tables) -> DataFrame:
    """Sites withheld because every device on them belongs to a withheld holder."""
    return R.site_rollup(mast_tenants(t), "site").agg(
        F.count_if("person_only").alias("person_only"), F.count_if("publishable").alias("publishable"),
        F.count(F.lit(1)).alias("live"))


@query(f"""WITH {MAST_SQL}, n AS (SELECT site, class, count(*) AS n FROM tenants GROUP BY ALL)
SELECT site, arg_min(class, (-n, class)) AS class FROM n GROUP BY site""")
def modal_class(t: Tables) -> DataFrame:
    """The class with most holders at every site."""
    return R.modal_class(mast_tenants(t), "site")


PAIRS = f"""{MAST_SQL}, c AS (SELECT site, class, count(*) AS n FROM tenants WHERE NOT person GROUP BY ALL),
pairs AS (SELECT x.class AS a, y.class AS b, count(*) AS sites,
          count(*) FILTER (WHERE x.class <> y.class OR x.n > 1) AS same_class_sites
   FROM c x JOIN c y ON x.site = y.site AND x.class <= y.class GROUP BY ALL)"""


def pairs_of(t: Tables) -> DataFrame:
    named = mast_tenants(t).filter(~F.col("person"))
    return N.class_pairs(named, "site", t.nation.select(F.col("n_nationkey").alias("class")))


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def class_pairs(t: Tables) -> DataFrame:
    """Sites that host both classes of a pair, under both readings of the diagonal."""
    return pairs_of(t)


@query(f"""WITH {PAIRS} SELECT class, CAST(sum(sites) AS BIGINT) AS pairings FROM (
  SELECT a AS class, sites FROM pairs UNION ALL SELECT b, sites FROM pairs WHERE a <> b) GROUP BY class""")
def pair_totals(t: Tables) -> DataFrame:
    return N.pair_totals(pairs_of(t))


CROWDED = f"""{MAST_SQL}, s AS (SELECT site, count(*) AS holders, count(*) FILTER (WHERE NOT person) AS named,
  CAST(sum(devices) AS BIGINT) AS devices, CAST(sum(tx) AS BIGINT) AS tx, count(*) AS licences,
  bool_and(person) AS person_only, NOT bool_and(person) AND bool_or(granted) AS publishable FROM tenants GROUP BY site),
top400 AS (SELECT * FROM s WHERE publishable AND holders >= 6 ORDER BY named DESC, holders DESC, site LIMIT 400)"""


def crowded(t: Tables) -> DataFrame:
    tenants = kept_tenants(t)
    named = tenants.filter(~F.col("person")).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return N.crowded_sites(R.site_rollup(tenants, "site").filter("publishable"), "site", 6, 400, named)


@query(f"WITH {CROWDED} SELECT * FROM top400")
def crowded_sites(t: Tables) -> DataFrame:
    """The 400 sites with most holders; the threshold counts all, the listing names the named."""
    return crowded(t)


@query(f"WITH {CROWDED} SELECT site, holder FROM tenants JOIN top400 USING (site) WHERE NOT person")
def crowded_tenants(t: Tables) -> DataFrame:
    """Who is at those sites, one row a tenant."""
    return N.tenant_list(crowded(t), kept_tenants(t), "site")


@query(f"""WITH {CROWDED} SELECT count(*) FILTER (WHERE holders = 1) AS single_holder,
count(*) FILTER (WHERE holders > 1) AS shared FROM s WHERE publishable""")
def sharing_split(t: Tables) -> DataFrame:
    return N.sharing_split(R.site_rollup(mast_tenants(t), "site").filter("publishable"))


# --- regions ------------------------------------------------------------------------------------

REGIONS = f"""{MAST_SQL}, place AS (SELECT o_orderkey AS site, c_nationkey AS region FROM orders JOIN customer ON c_custkey = o_custkey),
pop AS (SELECT c_nationkey AS region, count(*) AS population FROM customer GROUP BY 1),
live AS (SELECT region, count(DISTINCT site) AS live, CAST(sum(devices) AS BIGINT) AS devices
         FROM tenants JOIN place USING (site) GROUP BY region),
held AS (SELECT region, holder, class, person, count(*) AS n FROM tenants JOIN place USING (site) GROUP BY ALL),
tops AS (SELECT region, count(*) AS holders, arg_min(holder, (-n, holder)) FILTER (WHERE NOT person) AS top_holder,
                max(n) FILTER (WHERE NOT person) AS top_holder_sites FROM held GROUP BY region),
reg AS (SELECT n_nationkey AS region, n_name AS name, coalesce(population, 0) AS population, coalesce(sites, 0) AS sites,
               coalesce(live, 0) AS live, coalesce(devices, 0) AS devices, coalesce(holders, 0) AS holders,
               top_holder, coalesce(top_holder_sites, 0) AS top_holder_sites
        FROM nation LEFT JOIN pop ON pop.region = n_nationkey LEFT JOIN live ON live.region = n_nationkey
        LEFT JOIN tops ON tops.region = n_nationkey
        LEFT JOIN (SELECT region, count(*) AS sites FROM place GROUP BY region) a ON a.region = n_nationkey),
rates AS (SELECT *, CASE WHEN population > 0 THEN floor(sites / population * 100000 + 0.5) / 10 END AS per_ten_k FROM reg)"""


def placed_sites(t: Tables) -> DataFrame:
    customer = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region"))
    orders = t.orders.select(F.col("o_orderkey").alias("site"), "o_custkey")
    return skew_join(orders, customer, "o_custkey").select("site", "region")


def regions(t: Tables) -> DataFrame:
    population = t.customer.groupBy(F.col("c_nationkey").alias("region")).agg(F.count(F.lit(1)).alias("population"))
    listed = t.nation.select(F.col("n_nationkey").alias("region"), F.col("n_name").alias("name"))
    listed = dense(population, listed, ["region"], ["population"])
    rolled = R.region_rollup(placed_sites(t), mast_tenants(t), listed, site="site", region="region",
                             probe=t.mast_devices)
    rate = half_up(F.try_divide(F.col("sites"), F.col("population")) * 1e5) / F.lit(10.0)
    return rolled.withColumn("per_ten_k", rate)


@query(f"WITH {REGIONS} SELECT * FROM rates")
def region_rollup(t: Tables) -> DataFrame:
    """Sites, live sites, devices, holders, largest named holder and sites per 10,000 per region."""
    return regions(t)


@query(f"""WITH {REGIONS}
SELECT arg_min(name, (-coalesce(per_ten_k, 0), region)) AS most, max(coalesce(per_ten_k, 0)) AS most_rate,
 arg_min(name, (coalesce(per_ten_k, 0), region)) FILTER (WHERE population > 50) AS least,
 min(coalesce(per_ten_k, 0)) FILTER (WHERE population > 50) AS least_rate FROM rates""")
def region_extremes(t: Tables) -> DataFrame:
    """Highest rate, and the lowest among regions above a population floor."""
    rate = F.coalesce("per_ten_k", F.lit(0.0))
    r = regions(t).select("name", "region", "population", rate.alias("rate"))
    floor = F.col("population") > 50
    low = F.when(floor, F.struct(F.col("rate").alias("s"), F.col("region").alias("t")))
    return r.agg(best("name", "rate", "region").alias("most"), F.max("rate").alias("most_rate"),
                 F.min_by("name", low).alias("least"), F.min(F.when(floor, F.col("rate"))).alias("least_rate"))


@query(f"""WITH {REGIONS}, k AS (SELECT region, class, CAST(sum(n) AS BIGINT) AS n FROM held GROUP BY ALL)
SELECT region, class, n, rank, n / w AS share FROM (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, class) AS rank,
         sum(n) OVER (PARTITION BY region) AS w FROM k) WHERE rank <= 10""")
def region_classes(t: Tables) -> DataFrame:
    """The ten largest classes of every region, each organisation counted once per site it is at."""
    from holdfast.operators.ordering import share_of_group
    joined = skew_join(mast_tenants(t), placed_sites(t), "site", probe=t.mast_devices)
    shared = share_of_group(R.region_classes(joined, "region"), ["region"], "n")
    return top_per_group(shared, ["region"], [F.desc("n"), F.asc("class")], 10)


@query(f"""WITH {REGIONS} SELECT region, live / greatest(1, (region + 1) * 50.0) * 1000 AS per_thousand,
 CASE WHEN live > 0 THEN top_holder_sites / live END AS concentration FROM rates""")
def region_densities(t: Tables) -> DataFrame:
    """Live sites per 1,000 units of area, and the largest holder's share of the live sites."""
    area = (F.col("region") + 1) * 50.0
    return regions(t).select("region", (ratio_floor_one(F.col("live"), area) * 1000).alias("per_thousand"),
                             ratio(F.col("top_holder_sites"), F.col("live")).alias("concentration"))


@query(f"""WITH {REGIONS}, x AS (SELECT region, log10(1 + coalesce(per_ten_k, 0)) / log10(1 + max(coalesce(per_ten_k, 0)) OVER ()) AS t FROM rates)
SELECT region, CAST(least(7, greatest(0, floor(t * 7 + 0.5))) AS INTEGER) AS bucket FROM x""")
def ramp_buckets(t: Tables) -> DataFrame:
    """The colour step of every region on a log ramp whose ceiling is measured."""
    r = durable(regions(t).select("region", F.coalesce("per_ten_k", F.lit(0.0)).alias("v")))
    ceiling = F.lit(r.agg(F.max("v")).first()[0])
    return r.select("region", ramp_bucket(log_share(F.col("v"), ceiling)).alias("bucket"))


@query(f"""WITH {REGIONS}, m AS (SELECT max(coalesce(per_ten_k, 0)) AS top FROM rates)
SELECT CAST(i AS INTEGER) AS bucket, floor((pow(1 + top, i / 7.0) - 1) + 0.5) AS breakpoint FROM m, range(8) r(i)""")
def ramp_breakpoints(t: Tables) -> DataFrame:
    """The legend of the same ramp: where each step starts."""
    ceiling = regions(t).agg(F.max(F.coalesce("per_ten_k", F.lit(0.0))).alias("top"))
    steps = ceiling.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return steps.select("bucket", half_up(ramp_breakpoint(F.col("bucket"), F.col("top"))).alias("breakpoint"))


# --- points -------------------------------------------------------------------------------------

# The first two dimensions of an embedding, times 100, stand for a position in degrees.
POINTS_SQL = "pts AS (SELECT vec_id, embedding[1] * 100.0::DOUBLE AS lat, embedding[2] * 100.0::DOUBLE AS lon, label FROM embeddings)"


def points(t: Tables) -> DataFrame:
    def coordinate(i: int):
        return F.col("embedding")[i].cast("double") * 100.0
    return t.embeddings.select("vec_id", coordinate(0).alias("lat"), coordinate(1).alias("lon"), "label")


# A square with a hole, a two-part region, a triangle over both, one to be dropped by its name (it lies
# over the others and comes before the triangle), and one without geometry.
BOUNDARIES = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"name": "Ring"}, "geometry": {"type": "Polygon", "coordinates": [
        [[-12.0, -11.0], [11.5, -11.0], [11.5, 12.5], [-12.0, 12.5], [-12.0, -11.0]],
        [[-3.0, -4.0], [4.0, -3.5], [3.0, 5.0], [-4.0, 4.0], [-3.0, -4.0]]]}},
    {"type": "Feature", "properties": {"name": "Isles"}, "geometry": {"type": "MultiPolygon", "coordinates": [
        [[[-2.0, -2.5], [2.5, -2.0], [2.0, 2.5], [-2.5, 2.0], [-2.0, -2.5]]],
        [[[12.0, 0.0], [30.0, -7.0], [28.0, 14.0], [12.0, 0.0]]]]}},
    {"type": "Feature", "properties": {"name": "Nowhere (usual address unknown)"}, "geometry": {"type": "Polygon", "coordinates": [
        [[-60.0, -60.0], [60.0, -60.0], [60.0, 60.0], [-60.0, 60.0], [-60.0, -60.0]]]}},
    {"type": "Feature", "properties": {"name": "Unmapped"}, "geometry": None},
    {"type": "Feature", "properties": {"name": "Wedge"}, "geometry": {"type": "Polygon", "coordinates": [
        [[-30.0, -25.0], [35.0, -25.0], [0.0, 32.0], [-30.0, -25.0]]]}}]}


def _edges_sql(name: str = "edges", snap=lambda v: v) -> str:
    rows = []
    for f, feature in enumerate(BOUNDARIES["features"]):
        geometry = feature["geometry"]
        if not geometry or "usual address" in feature["properties"]["name"]:
            continue
        polygons_ = geometry["coordinates"] if geometry["type"] == "MultiPolygon" else [geometry["coordinates"]]
        for p, rings in enumerate(polygons_):
            for ring in rings:
                ring = [(snap(x), snap(y)) for x, y in ring]
                for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                    if y1 != y2:
                        rows.append(f"({f}, {p}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)")
    return f"{name}(feature, part, x1, y1, x2, y2) AS (VALUES " + ", ".join(rows) + ")"


# The ray of a point crosses an edge when the edge straddles it and lies to the east.
LOCATED = f"""{POINTS_SQL}, {_edges_sql()}, hits AS (
  SELECT vec_id, feature, part FROM pts JOIN edges
    ON (y1 > lat) <> (y2 > lat) AND lon < (x1 - x2) * (lat - y2) / (y1 - y2) + x2
  GROUP BY ALL HAVING count(*) % 2 = 1),
located AS (SELECT vec_id, CAST(coalesce(min(feature), -1) AS INTEGER) AS region FROM pts LEFT JOIN hits USING (vec_id) GROUP BY vec_id)"""


def boundary_document(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(json.dumps(BOUNDARIES),)], "value string")


def boundary_parts(t: Tables) -> DataFrame:
    features = G.drop_named(polygons.from_text(boundary_document(t)).withColumn("name", F.col("properties")["name"]),
                            "name", "usual address")
    return polygons.parts(features)


@query(f"WITH {LOCATED} SELECT vec_id, region FROM located")
def point_in_polygon(t: Tables) -> DataFrame:
    """The first region whose rings hold the point, -1 when none does."""
    return G.locate(points(t), boundary_parts(t), id="vec_id", lat="lat", lon="lon")


@query(f"WITH {LOCATED} SELECT region, count(*) AS sites FROM located GROUP BY region")
def region_point_counts(t: Tables) -> DataFrame:
    return region_counts(t, boundary_parts(t))


def region_counts(t: Tables, parts: DataFrame) -> DataFrame:
    found = G.locate(points(t), parts, id="vec_id", lat="lat", lon="lon")
    return found.groupBy("region").agg(F.count(F.lit(1)).alias("sites"))


@query(f"""WITH {POINTS_SQL} SELECT CAST(floor(lon * 10 + 0.5) AS BIGINT) AS gx, CAST(floor(lat * 10 + 0.5) AS BIGINT) AS gy,
 count(*) AS sites, CAST(sum(label) AS BIGINT) AS devices FROM pts GROUP BY ALL""")
def density_grid(t: Tables) -> DataFrame:
    """Sites and devices per tenth of a degree."""
    return G.density_grid(points(t), "lat", "lon", F.col("label"))


@query(f"""WITH {POINTS_SQL} SELECT vec_id FROM pts WHERE lat BETWEEN -10 AND 14 AND lon BETWEEN -9 AND 8
AND CASE WHEN label IN (0, 1) THEN label ELSE 2 END <> 2""")
def points_in_box(t: Tables) -> DataFrame:
    """Points in view; zoomed in far enough, none of unknown accuracy."""
    coded = points(t).withColumn("accuracy", F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(2))
    return G.in_box(coded, "lat", "lon", (-10.0, -9.0, 14.0, 8.0), "accuracy", exact_only=True).select("vec_id")


PICKS = [(1, 0.0, 0.0), (2, 5.5, -7.25), (3, -20.0, 14.0), (4, 11.0, 11.0), (5, 39.0, 39.0), (6, -1.0, -18.5)]


@query(f"""WITH {POINTS_SQL}, picks(pick, y, x) AS (VALUES {', '.join(f'({p}, {y}::DOUBLE, {x}::DOUBLE)' for p, y, x in PICKS)}),
d AS (SELECT pick, vec_id, (lon - x) * (lon - x) + (lat - y) * (lat - y) AS distance2 FROM picks, pts)
SELECT pick, arg_min(vec_id, (distance2, vec_id)) AS vec_id, min(distance2) AS distance2
FROM d WHERE distance2 < 6.25 GROUP BY pick""")
def nearest_within(t: Tables) -> DataFrame:
    """The nearest point to every pick, when one is closer than the radius."""
    picks = t.spark.createDataFrame(PICKS, "pick int, lat double, lon double")
    return G.nearest_within(picks, points(t), pick="pick", id="vec_id", x="lon", y="lat", radius=2.5)


@query(f"""WITH {POINTS_SQL}, d AS (SELECT a.vec_id AS pick, b.vec_id, (b.lon - a.lon - 0.3) * (b.lon - a.lon - 0.3) + (b.lat - a.lat) * (b.lat - a.lat) AS distance2
  FROM pts a, pts b WHERE a.vec_id % 20 = 0)
SELECT pick, arg_min(vec_id, (distance2, vec_id)) AS vec_id, floor(min(distance2) * 1e6 + 0.5) / 1e6 AS distance2
FROM d WHERE distance2 < 900 GROUP BY pick""")
def nearest_of_many(t: Tables) -> DataFrame:
    """The nearest point to a place beside every twentieth point, in a radius that holds most of them."""
    picks = points(t).filter(F.col("vec_id") % 20 == 0).select(
        F.col("vec_id").alias("pick"), "lat", (F.col("lon") + 0.3).alias("lon"))
    near = G.nearest_within(picks, points(t), pick="pick", id="vec_id", x="lon", y="lat", radius=30.0)
    return near.withColumn("distance2", half_up(F.col("distance2"), 6))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'anv') ORDER BY p_partkey LIMIT 40")
def search_names(t: Tables) -> DataFrame:
    """The first forty names that contain the text, case ignored."""
    return search(t.part.select("p_partkey", "p_name"), "p_name", " ANv", [F.asc("p_partkey")])
