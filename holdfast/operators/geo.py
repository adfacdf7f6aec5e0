"""Points in polygons, density grids, nearest points, boxes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.numbers import floor_cell, rounded_cell
from holdfast.scale import BROADCAST_ROWS, bounded_rows, broadcast_if_small, durable, skew_join

# Fixed value: the side of a candidate cell in degrees.
CELL = 0.5
# Edges of one part that one strip may hold before the strips are made thinner.
STRIP_EDGES = 512
# Edges (32 bytes each) that may be broadcast.
BROADCAST_EDGES = 1_000_000
# Picks, or points around a pick on average, up to which all of them meet.
FEW = 64
# Points of a cell that is split no further, and into how many a cell is split along each side (a power of two,
# so that the cells of a cell are exactly within it).
LEAF = 32
SPLIT = 4
# Bounds are this much wider than computed, for what rounding takes.
SLACK = 1 + 1e-9


def polygon_edges(parts: DataFrame) -> DataFrame:
    """(feature, part, x1, y1, x2, y2): the edges of every ring, the closing edge included.

    ``parts`` has (feature, part, rings) with rings as arrays of [x, y] positions. Horizontal
    edges are left out: a horizontal ray never crosses them.
    """
    rings = parts.select("feature", "part", F.explode("rings").alias("ring"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("ring") - 1),
        lambda i: F.struct(
            F.get("ring", i).alias("a"),
            F.get("ring", F.when(i == 0, F.size("ring") - 1).otherwise(i - 1)).alias("b")))
    edges = rings.filter(F.size("ring") > 1).select("feature", "part", F.explode(pairs).alias("e"))
    return edges.select(
        "feature", "part", F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"),
        F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2")).filter(F.col("y1") != F.col("y2"))


def _strip_height(edges: DataFrame, cell: float) -> float:
    """A strip height at which no part has more than about STRIP_EDGES edges in one strip."""
    height = cell
    for _ in range(12):
        row = _strips(edges, height).groupBy("part", "strip").agg(F.count(F.lit(1)).alias("n")).agg(
            F.max("n")).first()
        if not row[0] or row[0] <= STRIP_EDGES:
            break
        height /= 2
    return height


def _strips(edges: DataFrame, height: float) -> DataFrame:
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    return edges.withColumn("strip", F.explode(F.sequence(floor_cell(low, height), floor_cell(high, height))))


def locate(points: DataFrame, parts: DataFrame, *, id: str, lat: str, lon: str, region: str = "region",
           cell: float = CELL) -> DataFrame:
    """(id, region): the first feature (lowest number) whose even-odd rings hold the point, else -1.

    A point meets the parts of its cell, then the edges of that part in its strip, kept as one
    array per (part, strip); the crossings are counted inside the row, so no pair of point and
    edge is ever shuffled. Boundaries of a checked size are broadcast and the points stay where
    they are; beyond that the same joins shuffle, with hot cells salted. Holes and islands need
    no case of their own. Points without coordinates are in no region.
    """
    edges = durable(polygon_edges(parts))
    height = _strip_height(edges, cell)
    boxes = edges.groupBy("feature", "part").agg(
        F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"),
        F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y9"))
    cells = (boxes
             .withColumn("_cx", F.explode(F.sequence(floor_cell(F.col("x0"), cell), floor_cell(F.col("x9"), cell))))
             .withColumn("_cy", F.explode(F.sequence(floor_cell(F.col("y0"), cell), floor_cell(F.col("y9"), cell)))))
    cut = _strips(edges, height)
    strips = cut.groupBy("part", "strip").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))

    at = points.select(F.col(id), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    at = at.withColumns({"_cx": floor_cell(F.col("_lon"), cell), "_cy": floor_cell(F.col("_lat"), cell)})
    in_box = F.coalesce(F.col("_lon").between(F.col("x0"), F.col("x9"))
                        & F.col("_lat").between(F.col("y0"), F.col("y9")), F.lit(False))
    candidates = _join_boundary(at, cells, ["_cx", "_cy"], cells).select(
        id, "_lat", "_lon", "feature", "part",
        F.when(in_box, floor_cell(F.col("_lat"), height)).alias("strip"))
    crossings = F.size(F.filter("_edges", lambda e: (
        ((e["y1"] > F.col("_lat")) != (e["y2"] > F.col("_lat")))
        & (F.col("_lon") < F.try_divide((e["x2"] - e["x1"]) * (F.col("_lat") - e["y1"]), e["y2"] - e["y1"])
           + e["x1"]))))
    # The strips weigh as much as the edges in them: those are counted, not the rows.
    met = _join_boundary(candidates, strips, ["part", "strip"], cut, BROADCAST_EDGES)
    first = F.min(F.when(crossings % 2 == 1, F.col("feature")))
    return met.groupBy(id).agg(F.coalesce(first.cast("int"), F.lit(-1)).alias(region))


def _join_boundary(points: DataFrame, table: DataFrame, on: Sequence[str], weight: DataFrame,
                   limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join to a table that is broadcast when its weight is counted small, else salted."""
    if bounded_rows(weight, limit) is not None:
        return points.join(F.broadcast(table), list(on), "left")
    return skew_join(points, table, on, "left")


def coarsened(parts: DataFrame, grid: float) -> DataFrame:
    """The same parts with every position on a grid, repeated positions once: boundaries fit for drawing only."""
    def snapped(ring: Column) -> Column:
        at = F.transform(ring, lambda p: F.transform(p, lambda v: F.floor(v / F.lit(grid) + 0.5) * F.lit(grid)))
        return F.filter(at, lambda p, i: (i == 0) | (p != F.get(at, i - 1)))
    return parts.withColumn("rings", F.transform("rings", snapped))


def drop_named(df: DataFrame, name: str, pattern: str | None) -> DataFrame:
    """Drop pseudo-regions: rows whose name matches ``pattern``; None drops none."""
    return df if pattern is None else df.filter(~F.coalesce(F.col(name).rlike(pattern), F.lit(False)))


def density_grid(sites: DataFrame, lat: str, lon: str, devices: Column, per_unit: int = 10) -> DataFrame:
    """Sites and devices per cell of 1/per_unit degrees."""
    return (sites.select(rounded_cell(F.col(lon), per_unit).alias("gx"),
                         rounded_cell(F.col(lat), per_unit).alias("gy"), devices.alias("_d"))
            .groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("sites"), F.sum("_d").alias("devices")))


def in_box(points: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float],
           accuracy: str | None = None, exact_only: bool = False, unknown: int = 2) -> DataFrame:
    """Points inside (south, west, north, east); with ``exact_only``, none of unknown accuracy."""
    south, west, north, east = box
    kept = points.filter(F.col(lat).between(south, north) & F.col(lon).between(west, east))
    return kept.filter(F.col(accuracy) != unknown) if accuracy and exact_only else kept


def nearest_within(picks: DataFrame, points: DataFrame, *, pick: str, id: str, x: str, y: str,
                   radius: float) -> DataFrame:
    """(pick, id, distance²): the nearest point strictly closer than ``radius`` to every pick.

    Points at one place are one candidate (the smallest id stands for them). Every pick is listed
    in the nine cells around it. Where these hold few points, a pick meets them all; a checked, short
    list of picks is broadcast, so the points are read once and reduced map-side, and a long list takes
    the same join with hot cells salted. Where they hold many, the cells are split first: see ``_closing``.
    Picks without a place have no row; ``pick`` is unique.
    """
    places = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.min(id).alias(id))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = (picks.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(pick, F.col(x).alias("_px"), F.col(y).alias("_py"))
             .withColumn("_cx", F.explode(F.transform(around, lambda d: floor_cell(F.col("_px"), radius) + d)))
             .withColumn("_cy", F.explode(F.transform(around, lambda d: floor_cell(F.col("_py"), radius) + d))))
    if bounded_rows(asked, 9 * FEW) is not None:  # a point meets FEW picks at most
        return _nearest(_placed(places, radius).join(F.broadcast(asked), ["_cx", "_cy"]), pick, id, radius)
    places = durable(places)
    whole = durable(_cells(places, radius))
    met = durable(_join_boundary(whole, asked, ["_cx", "_cy"], asked).filter(F.col(pick).isNotNull()))
    found, listed = met.agg(F.sum("_n"), F.count(F.lit(1))).first()
    if (found or 0) <= FEW * listed:
        near = _join_boundary(_placed(places, radius), asked, ["_cx", "_cy"], asked)
        return _nearest(near, pick, id, radius)
    return _closing(places, met, pick, id, radius)


def _placed(places: DataFrame, side: float) -> DataFrame:
    return places.withColumns({"_cx": floor_cell(F.col("_x"), side), "_cy": floor_cell(F.col("_y"), side)})


def _cells(places: DataFrame, side: float) -> DataFrame:
    """(_cx, _cy, _n and the box around the points) of every cell that holds any."""
    return _placed(places, side).groupBy("_cx", "_cy").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_x0"), F.max("_x").alias("_x9"),
        F.min("_y").alias("_y0"), F.max("_y").alias("_y9"))


def _nearest(near: DataFrame, pick: str, id: str, radius: float) -> DataFrame:
    d2 = (F.col("_x") - F.col("_px")) * (F.col("_x") - F.col("_px")) \
        + (F.col("_y") - F.col("_py")) * (F.col("_y") - F.col("_py"))
    return (near.withColumn("distance2", d2).filter(F.col("distance2") < radius * radius)
            .groupBy(pick).agg(F.min(F.struct("distance2", id)).alias("_best"))
            .select(pick, f"_best.{id}", "_best.distance2"))


def _bounded(met: DataFrame, pick: str, radius: float) -> DataFrame:
    """The cells of each pick that may hold its nearest point, with ``_least`` and ``_bound`` (squared).

    No point of a cell is nearer than its box, and one at least is no farther than the box's farthest corner.
    """
    def away(p: str, a: str, b: str) -> tuple[Column, Column]:
        near = F.greatest(F.col(a) - F.col(p), F.col(p) - F.col(b), F.lit(0.0))
        far = F.greatest(F.abs(F.col(a) - F.col(p)), F.abs(F.col(b) - F.col(p)))
        return near * near, far * far

    (nx, fx), (ny, fy) = away("_px", "_x0", "_x9"), away("_py", "_y0", "_y9")
    # The cells of one pick: nine, then what is left of them; a window over a short list.
    bound = F.least("_bound", F.min((fx + fy) * SLACK).over(Window.partitionBy(pick)))
    known = met if "_bound" in met.columns else met.withColumn("_bound", F.lit(radius * radius))
    return known.withColumn("_least", nx + ny).withColumn("_bound", bound).filter(
        (F.col("_least") <= F.col("_bound")) & (F.col("_least") < radius * radius))


def _closing(places: DataFrame, met: DataFrame, pick: str, id: str, radius: float) -> DataFrame:
    """The search from cells of the radius's side down to cells of LEAF points.

    Each round, a pick keeps the cells that can still hold something nearer than what the others are sure to
    hold. Those of more than LEAF points are split in SPLIT times SPLIT, and the pick goes on to the parts that
    hold points. So a pick reads a few small cells, however many points lie within its radius, and
    what is split is only what some pick still looks at.
    """
    edge = places.agg(F.max(F.greatest(F.abs("_x"), F.abs("_y")))).first()[0] or 0.0
    side, leaves, bounds = radius, [], []
    keys = [pick, "_px", "_py", "_cx", "_cy"]
    while True:
        met = durable(_bounded(met, pick, radius).select(*keys, "_n", "_least", "_bound"))
        bounds.append(met.select(pick, "_bound"))
        fine = side / SPLIT
        # Below this, cells are no wider than the gaps between numbers.
        open_ = F.col("_n") > LEAF if edge / fine < 2.0 ** 50 else F.lit(False)
        leaves.append((side, met.filter(~open_)))
        dense = met.filter(open_)
        if dense.isEmpty():
            break
        parts = F.sequence(F.lit(0), F.lit(SPLIT - 1))
        further = (dense.withColumn("_cx", F.explode(F.transform(parts, lambda d: F.col("_cx") * SPLIT + d)))
                   .withColumn("_cy", F.explode(F.transform(parts, lambda d: F.col("_cy") * SPLIT + d))))
        inside = broadcast_if_small(dense.select("_cx", "_cy").distinct())
        cells = _cells(_placed(places, side).join(inside, ["_cx", "_cy"], "left_semi"), fine)
        met = skew_join(further.drop("_n", "_least"), cells, ["_cx", "_cy"])
        side = fine
    bound = durable(reduce(DataFrame.unionByName, bounds).groupBy(pick).agg(F.min("_bound").alias("_last")))
    near = []
    for side, found in leaves:
        left = found.join(bound, pick).filter(F.col("_least") <= F.col("_last")).select(*keys)
        near.append(skew_join(left, _placed(places, side), ["_cx", "_cy"], probe=found))
    return _nearest(reduce(DataFrame.unionByName, near), pick, id, radius)
