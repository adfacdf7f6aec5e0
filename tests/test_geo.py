"""Points in polygons against brute force; grids, boxes, nearest points."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from holdfast import scale
from holdfast.operators import geo as G
from holdfast.sources import polygons


def ring(rng, cx, cy, r, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    pts = [[cx + r * rng.uniform(.5, 1) * math.cos(a), cy + r * rng.uniform(.5, 1) * math.sin(a)] for a in angles]
    return [*pts, pts[0]]


def features(rng, count=14):
    out = []
    for i in range(count):
        cx, cy = rng.uniform(-4, 4), rng.uniform(-4, 4)
        outer = [ring(rng, cx, cy, 2.5, rng.randint(5, 60)), ring(rng, cx, cy, 0.8, 7)]
        geometry = {"type": "Polygon", "coordinates": outer}
        if i % 4 == 1:
            geometry = {"type": "MultiPolygon", "coordinates": [outer, [ring(rng, cx + 5, cy, 1, 8)]]}
        out.append({"type": "Feature", "properties": {"name": f"r{i}"}, "geometry": None if i == 3 else geometry})
    return out


def brute(fs, x, y):
    for i, f in enumerate(fs):
        g = f["geometry"]
        if not g:
            continue
        for rings in (g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]]):
            inside = False
            for r in rings:
                for (x1, y1), (x2, y2) in zip(r, r[-1:] + r):
                    if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                        inside = not inside
            if inside:
                return i
    return -1


@pytest.mark.parametrize("mode", ["broadcast", "shuffled", "salted"])
def test_points_in_polygons(spark, monkeypatch, mode):
    if mode != "broadcast":
        monkeypatch.setattr(G, "bounded_rows", lambda df, limit=0: None)
        if mode == "salted":
            monkeypatch.setattr(scale, "HOT_ROWS", 0)
    rng = random.Random(3)
    fs = features(rng)
    text = spark.createDataFrame([(json.dumps({"features": fs}),)], "value string")
    parts = polygons.parts(polygons.from_text(text))
    points = [(i, rng.uniform(-7, 7), rng.uniform(-7, 10)) for i in range(1200)] + [(2000 + i, 0.25, 0.25) for i in range(600)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")
    odd = spark.createDataFrame([(9999, None, 1.0)], "id int, lat double, lon double")
    monkeypatch.setattr(G, "STRIP_EDGES", 8)
    got = {r["id"]: r["region"] for r in G.locate(df.union(odd), parts, id="id", lat="lat", lon="lon").collect()}
    assert got.pop(9999) == -1
    assert got == {i: brute(fs, lon, lat) for i, lat, lon in points}
    assert len(set(got.values())) > 6


def test_geojson_from_a_file(spark, tmp_path):
    fs = features(random.Random(1), 5)
    fs[0]["properties"] = {"name": "Migratory - Offshore", "code": 7}
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": fs}, indent=1))
    found = polygons.read_polygons(spark, str(tmp_path / "b.geojson"))
    assert found.count() == 5 and found.filter("type is null").count() == 1
    assert found.filter("feature = 0").first()["properties"]["code"] == "7"
    named = found.withColumn("name", F.col("properties")["name"])
    assert G.drop_named(named, "name", "Migratory|No usual address").count() == 4
    per = polygons.parts(found).groupBy("feature").count()
    assert {r["feature"]: r["count"] for r in per.collect()} == {0: 1, 1: 2, 2: 1, 4: 1}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """Braces, brackets and quotes in strings, members beside the features, and features over many ranges of bytes."""
    rng = random.Random(8)
    bits = ["}", "{", "[", "]", '"', "\\", ",", "é", "\n", '"features":[{', "x"]
    fs = features(rng, 10_000)
    for k, f in enumerate(fs):
        f["properties"] = {"name": f"{k}-" + "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))}
        if k % 3:
            f["bbox"] = [0, 1, 2, 3]
    document = {"type": "FeatureCollection", "title": "all [{ of } them", "crs": {"type": "name", "properties": {"name": "x"}},
                "meta": {"list": [{"a": 1}, {"b": [{"c": {}}]}]}, "bbox": [-1, -2, 3, 4], "features": fs, "after": {"z": [1]}}
    (tmp_path / "b.geojson").write_text(json.dumps(document, ensure_ascii=False), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8
        got = polygons.read_polygons(spark, str(tmp_path / "b.geojson")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["feature"] for r in got) == list(range(10_000))
    for r in got:
        want = fs[r["feature"]]
        assert r["properties"] == want["properties"]
        assert r["type"] == (want["geometry"] or {}).get("type")
        assert want["geometry"] is None or json.loads(r["coordinates"]) == want["geometry"]["coordinates"]


def test_cut_and_empty_boundary_files(spark, tmp_path):
    (tmp_path / "empty.geojson").write_text('{"type": "FeatureCollection", "features": []}\n')
    assert polygons.read_polygons(spark, str(tmp_path / "empty.geojson")).count() == 0
    (tmp_path / "cut.geojson").write_text('{"features": [{"type": "Feature", "properties": {}}, {"type": "Feature", "prop')
    with pytest.raises(polygons.BrokenFile):
        polygons.read_polygons(spark, str(tmp_path / "cut.geojson"))


def test_grid_cells_are_centred(spark):
    df = spark.createDataFrame([(-33.85, 151.2, 2), (-33.86, 151.24, 3), (0.05, -0.05, 1)], "lat double, lon double, d long")
    got = {(r["gx"], r["gy"]): (r["sites"], r["devices"]) for r in G.density_grid(df, "lat", "lon", F.col("d")).collect()}
    assert sum(v[0] for v in got.values()) == 3
    assert got[(1512, -339)] == (1, 3) and (0, 1) in got


def test_box_drops_unknown_accuracy_when_zoomed_in(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 0.5, 0.5, 2), (3, 9.0, 0.0, 0), (4, 1.0, 1.0, 1)], "id int, lat double, lon double, acc int")
    box = (-1.0, -1.0, 1.0, 1.0)
    assert G.in_box(df, "lat", "lon", box).count() == 3
    assert {r["id"] for r in G.in_box(df, "lat", "lon", box, "acc", exact_only=True).collect()} == {1, 4}


@pytest.mark.parametrize("small", [True, False])
def test_nearest(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(G, "bounded_rows", lambda df, limit=0: None)
        monkeypatch.setattr(scale, "HOT_ROWS", 0)
    rng = random.Random(8)
    pts = [(i, round(rng.uniform(-5, 5), 2), round(rng.uniform(-5, 5), 2)) for i in range(800)] + [(1000 + i, 1.0, 1.0) for i in range(400)]
    asked = [(i, rng.uniform(-7, 7), rng.uniform(-7, 7)) for i in range(60)] + [(99, 1.0, 1.5), (98, 50.0, 50.0)]
    got = G.nearest_within(spark.createDataFrame(asked, "pick int, x double, y double"),
                           spark.createDataFrame(pts, "id int, x double, y double"), pick="pick", id="id", x="x", y="y", radius=0.5)
    want = {}
    for p, x, y in asked:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b in pts)
        if near[0][0] < 0.25:
            want[p] = near[0][1]
    assert {r["pick"]: r["id"] for r in got.collect()} == want
    assert 98 not in want and len(want) > 20


def closest(asked, pts, radius):
    want = {}
    for p, x, y in asked:
        near = min(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b in pts)
        if near[0] < radius * radius:
            want[p] = (near[1], near[0])
    return want


def searched(spark, asked, pts, radius):
    got = G.nearest_within(spark.createDataFrame(asked, "pick int, x double, y double"), spark.createDataFrame(pts, "id int, x double, y double"),
                           pick="pick", id="id", x="x", y="y", radius=radius)
    return {r["pick"]: (r["id"], r["distance2"]) for r in got.collect()}


def test_nearest_in_dense_places(spark, monkeypatch):
    """A dense clump, a lone point beside it, clumps within a clump; every pick has most points in its radius."""
    monkeypatch.setattr(G, "LEAF", 5)
    rng = random.Random(12)
    pts = [(k, rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for k in range(1500)]
    pts += [(2000 + k, 3 + rng.gauss(0, 1e-9), 3 + rng.gauss(0, 1e-9)) for k in range(300)] + [(3000, 1.5, 1.5), (3001, 1.5, 1.5)]
    pts += [(4000 + k, -7.0 + (k % 30), float(k // 30)) for k in range(300)]
    asked = [(k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(60)] + [(100 + k, rng.gauss(0, 2e-4), rng.gauss(0, 2e-4)) for k in range(60)]
    asked += [(200, 3.0, 3.0), (201, 1.4, 1.4), (202, 500.0, 500.0), (203, 3.0 + 1e-9, 3.0)]
    got, want = searched(spark, asked, pts, 8.0), closest(asked, pts, 8.0)
    assert got == want and 202 not in want


def test_nearest_among_points_of_one_cell(spark):
    """All points in one cell of the radius's side, as close as numbers allow: it ends, and few pairs are looked at."""
    x = 0.1
    pts = []
    for k in range(2000):
        pts.append((k, x, 0.2))
        x = math.nextafter(x, 1)
    asked = [(k, pts[k * 19][1], 0.2 + 1e-18) for k in range(100)]
    assert searched(spark, asked, pts, 5.0) == closest(asked, pts, 5.0)
