"""Geometry against closed forms and brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from hydrolens.functions import geo
from hydrolens.operators import polygons, raster, spatial
from hydrolens.operators import validate as V
from hydrolens.plans import features
from hydrolens.sources.geojson import read_boundary, read_features


def write(tmp_path, name, features_or_geometry):
    path = tmp_path / name
    path.write_text(json.dumps(features_or_geometry))
    return str(path)


def square(x0, y0, x1, y1):
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


def feature(geometry, **properties):
    return {"type": "Feature", "geometry": geometry, "properties": properties}


def collection(*features_):
    return {"type": "FeatureCollection", "features": list(features_)}


def test_geojson_reading_and_rules(spark, tmp_path):
    bow = {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [1, 0], [0, 1], [0, 0]]]}
    path = write(tmp_path, "f.json", collection(
        feature({"type": "Point", "coordinates": [95.6, 16.7]}, name="p"), feature({"type": "Point", "coordinates": [181, 16]}, name="far"), feature(bow, name="bow"),
        feature({"type": "MultiPolygon", "coordinates": [square(0, 0, 1, 1)["coordinates"], square(2, 0, 3, 1)["coordinates"]]}, name="multi")))
    marked = {r.n: r.violations for r in V.flagged(read_features(spark, path), V.geometry_rules()).select(F.col("properties")["name"].alias("n"), "violations").collect()}
    assert marked["p"] == [] and marked["multi"] == [] and marked["bow"] == ["geometry intersects itself"] and len(marked["far"]) == 1
    with pytest.raises(Exception, match="FeatureCollection"):
        read_features(spark, write(tmp_path, "g.json", square(0, 0, 1, 1))).collect()
    for name, document in (("a.json", square(0, 0, 2, 1)), ("b.json", feature(square(0, 0, 2, 1))), ("c.json", collection(feature(square(0, 0, 2, 1))))):
        assert read_boundary(spark, write(tmp_path, name, document)).select("geometry.bbox.xmax").first()[0] == 2.0


def test_area_centroid_and_utm(spark):
    r = spark.range(1).select(
        geo.area_m2(geo.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).alias("a"), geo.centroid(geo.box(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(6.0))).alias("c"),
        geo.to_utm(F.lit(95.65), F.lit(16.73)).alias("u"),
    ).first()
    # area between two parallels: integral of both radii of curvature times the cosine of the latitude
    n, total = 20000, 0.0
    for i in range(n):
        phi = math.radians((i + 0.5) / n)
        w = 1 - geo.E2 * math.sin(phi) ** 2
        total += geo.A * (1 - geo.E2) / w**1.5 * geo.A / math.sqrt(w) * math.cos(phi) * math.radians(1 / n)
    assert r.a == pytest.approx(total * math.radians(1), rel=1e-9)
    assert (r.c.x, r.c.y) == pytest.approx((2, 4))
    back = spark.range(1).select(geo.from_utm(F.lit(r.u.x), F.lit(r.u.y)).alias("p")).first().p
    assert (back.x, back.y) == pytest.approx((95.65, 16.73), abs=1e-9)


def test_union_area_against_grid_count(spark):
    rng = random.Random(1)
    boxes = [(x, y, x + rng.randint(1, 5), y + rng.randint(1, 5)) for x, y in ((rng.randint(0, 20), rng.randint(0, 20)) for _ in range(30))]
    cells = {(i, j) for x0, y0, x1, y1 in boxes for i in range(x0, x1) for j in range(y0, y1)}
    df = spark.createDataFrame([(1, *map(float, b)) for b in boxes], "k int, x0 double, y0 double, x1 double, y1 double").select("k", geo.box("x0", "y0", "x1", "y1").alias("geometry"))
    for crowd in (500, 2):  # the second value forces the finer grid
        pieces = polygons.dissolve(df, ["k"], 4.0, crowd=crowd, planar=True, split=4)
        assert pieces.agg(F.sum("area_m2")).first()[0] == pytest.approx(len(cells))


def test_union_of_triangles_with_hole(spark):
    ring = [(0.0, 0.0), (8.0, 0.0), (0.0, 8.0), (0.0, 0.0)]
    hole = [(1.0, 1.0), (3.0, 1.0), (1.0, 3.0), (1.0, 1.0)]
    other = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 0.0)]
    rows = [([ring, hole], [False, True]), ([other], [False])]
    df = spark.createDataFrame([(1, r, h) for r, h in rows], "k int, r array<array<struct<x:double,y:double>>>, h array<boolean>")
    df = df.select("k", geo.geometry(F.lit("Polygon"), F.col("r"), F.transform("r", lambda _: F.lit(0)), F.col("h")).alias("geometry"))
    total = polygons.dissolve(df, ["k"], 3.0, planar=True).agg(F.sum("area_m2")).first()[0]
    # two half squares of 32 share a quarter of 16; the hole of 2 is half covered by the second triangle
    assert total == pytest.approx(32 + 32 - 16 - 1)


def test_import_dissolves_and_clips(spark, tmp_path):
    path = write(tmp_path, "e.json", collection(
        feature(square(95.60, 16.60, 95.62, 16.62), event_id="1", event_start_date="2015-08-09", event_end_date="2015-08-14"),
        feature(square(95.61, 16.60, 95.63, 16.62), event_id="1", event_start_date="2015-08-09", event_end_date="2015-08-14"),
        feature(square(97.0, 16.60, 97.1, 16.62), event_id="2", event_start_date="2016-01-01", event_end_date="2016-01-02")))
    boundary = read_boundary(spark, write(tmp_path, "b.json", square(95.605, 16.605, 95.625, 16.70)))
    extents, pieces, skipped, _ = features.import_gfd_events(read_features(spark, path), boundary)
    row = extents.collect()
    expected = spark.range(1).select(geo.box_area_m2(*map(F.lit, (95.605, 16.605, 95.625, 16.62)))).first()[0] / 1e6
    assert len(row) == 1 and row[0].source_key == "demo:gfd:event:1" and row[0].area_km2 == pytest.approx(expected, rel=1e-9)
    assert row[0].source_feature_count == 2 and [r.group_value for r in skipped.collect()] == ["2"]
    assert pieces.agg(F.sum("area_m2")).first()[0] / 1e6 == pytest.approx(expected, rel=1e-9)


def test_grid_weights_and_square_grid(spark):
    b = spark.range(1).select(geo.box(*map(F.lit, (95.4, 16.5, 95.9, 16.9))).alias("geometry"))
    weights = [r.weight for r in spatial.grid_weights(b).collect()]
    assert len(weights) >= 4 and sum(weights) == pytest.approx(1) and min(weights) > 0
    small = spark.range(1).select(geo.box(*map(F.lit, (95.60, 16.60, 95.62, 16.62))).alias("geometry"))
    g = spatial.square_grid(small, 500).agg(F.sum("coverage_fraction").alias("c"), F.max("coverage_fraction").alias("m")).first()
    area = small.select(geo.area_m2("geometry")).first()[0]
    assert g.c * 250000 == pytest.approx(area, rel=2e-3) and g.m == pytest.approx(1)


def test_segments_are_short_and_unique(spark):
    line = geo.line((F.lit(95.595), F.lit(16.605)), (F.lit(95.605), F.lit(16.607)), (F.lit(95.63), F.lit(16.615)))
    lines = spark.range(2).select(F.col("id").alias("line_id"), F.lit("river").alias("name"), F.when(F.col("id") == 0, "river").otherwise("road").alias("waterway"), line.alias("geometry"))
    b = spark.range(1).select(geo.box(*map(F.lit, (95.60, 16.60, 95.62, 16.62))).alias("geometry"))
    rows = spatial.segment_lines(lines, b).collect()
    assert len(rows) >= 2 and {r.line_id for r in rows} == {0} and len({r.source_key for r in rows}) == len(rows)
    assert max(r.segment_length_m for r in rows) <= 500 + 1e-6
    xs = [p.x for r in rows for p in r.geometry.rings[0]]
    assert min(xs) == pytest.approx(95.60, abs=1e-6) and max(xs) == pytest.approx(95.62, abs=1e-6)


def test_patches_against_flood_fill(spark):
    rng = random.Random(9)
    wet = {(r, c) for r in range(40) for c in range(40) if rng.random() < 0.55}
    df = spark.createDataFrame([(r, c, 1) for r, c in wet], "px_row int, px_col int, flooded int")
    for connectivity in (4, 8):
        steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
        left, sizes = set(wet), []
        while left:
            stack, n = [left.pop()], 0
            while stack:
                r, c = stack.pop()
                n += 1
                for a, b in steps:
                    if (r + a, c + b) in left:
                        left.remove((r + a, c + b))
                        stack.append((r + a, c + b))
            sizes.append(n)
        got = raster.label_patches(df, connectivity=connectivity, min_px=3, size=16).groupBy("patch_id").agg(F.count("*").alias("n"), F.max("patch_pixels").alias("p")).collect()
        assert sorted(r.n for r in got) == sorted(s for s in sizes if s > 3) and all(r.n == r.p for r in got)


def test_nearest_far_from_everything(spark):
    p = spark.createDataFrame([(1, 95.0, 16.0), (2, -70.0, -40.0)], "cell_id int, x double, y double")
    s = spark.createDataFrame([(7, "river_segment", 95.5, 16.5, 95.51, 16.5), (8, "river_segment", 10.0, 10.0, 10.01, 10.0)], "segment_id int, asset_type string, x1 double, y1 double, x2 double, y2 double")
    got = {r.cell_id: r.segment_id for r in spatial.nearest_segments(p, s).collect()}
    assert got == {1: 7, 2: 8}


def test_nearest_against_all_pairs(spark):
    """Clusters, long segments, points 50 degrees away, kinds with fewer segments than asked for."""
    rng = random.Random(12)
    segments = [(i, "a", x := rng.gauss(95, 0.1), y := rng.gauss(16, 0.1), x + rng.uniform(-0.02, 0.02), y + rng.uniform(-0.02, 0.02)) for i in range(150)]
    segments += [(200, "a", 94.0, 15.0, 96.0, 17.5), (201, "b", 95.0, 15.0, 95.0, 17.0), (202, "b", 95.2, 16.0, 95.2, 16.0)]
    points = [(i, rng.gauss(95, 0.2), rng.gauss(16, 0.2)) for i in range(150)] + [(500, 45.0, -30.0), (501, -120.0, 16.0), (502, 95.0, 16.0)]

    def distance(px, py, s):
        _, _, ax, ay, bx, by = s
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1, max(0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n)) if n else 0
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    p = spark.createDataFrame(points, "cell_id int, x double, y double")
    s = spark.createDataFrame(segments, "segment_id int, asset_type string, x1 double, y1 double, x2 double, y2 double")
    for k in (1, 4):
        got = {}
        for r in spatial.nearest_segments(p, s, k=k).collect():
            got.setdefault((r.cell_id, r.asset_type), []).append(r.distance_deg)
        assert len(got) == 2 * len(points)
        for (c, kind), found in got.items():
            _, px, py = next(q for q in points if q[0] == c)
            want = sorted(distance(px, py, q) for q in segments if q[1] == kind)[:k]
            assert sorted(found) == pytest.approx(want, abs=1e-12)


def test_nearest_of_copied_segments(spark):
    """Rows that repeat a segment are one segment, so they do not use up the ranks."""
    s = spark.createDataFrame([(1, "a", 0.0, 0.0, 0.001, 0.0)] * 4 + [(2, "a", 0.5, 0.5, 0.501, 0.5), (3, "a", 9.0, 9.0, 9.001, 9.0)],
                              "segment_id int, asset_type string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 0.0005, 0.0005)], "cell_id int, x double, y double")
    got = spatial.nearest_segments(p, s, k=3).orderBy("rank").collect()
    assert [r.segment_id for r in got] == [1, 2, 3]


def test_far_points_follow_few_nodes(spark):
    """A point far from all of 4,000 segments does not look at most of them."""
    rng = random.Random(5)
    rows = [(i, "a", x := rng.uniform(95.4, 95.65), y := rng.uniform(16.45, 16.65), x + 0.004, y + 0.002) for i in range(4000)]
    s = spark.createDataFrame(rows, "segment_id int, asset_type string, x1 double, y1 double, x2 double, y2 double")
    unit = 0.005 / 2**8
    spots = [(95.4 + 0.005 * (i % 50), 20.0 + 0.005 * (i // 50)) for i in range(2000)]
    places = spark.createDataFrame([(x, y, math.floor(x / unit), math.floor(y / unit)) for x, y in spots], "x double, y double, px long, py long")
    for k in (1, 3):
        shapes = spatial._shapes(s, "asset_type", unit, k).cache()
        leaves, _ = spatial._leaf_pairs(places, shapes, "asset_type", 17, k)
        assert leaves.count() <= 100 * len(spots)
