"""Exact overlays of cells with triangles, an L and a polygon with a hole."""

import random

import pytest
from pyspark.sql import functions as F

from hydrolens.functions import geo
from hydrolens.operators import outlines, polygons, spatial

SHAPES = {
    1: [[(0.0, 0.0), (0.06, 0.0), (0.0, 0.06), (0.0, 0.0)]],
    2: [[(0.05, 0.05), (0.09, 0.05), (0.09, 0.06), (0.06, 0.06), (0.06, 0.09), (0.05, 0.09), (0.05, 0.05)]],
    3: [[(0.1, 0.0), (0.18, 0.01), (0.17, 0.08), (0.11, 0.09), (0.1, 0.0)], [(0.12, 0.02), (0.16, 0.02), (0.15, 0.06), (0.12, 0.02)]],
    4: [[(0.031, 0.071), (0.037, 0.078), (0.029, 0.08), (0.031, 0.071)]],
}


def extents(spark, shapes=SHAPES):
    df = spark.createDataFrame([(k, f"demo:gfd:frequency:{k}", k, r) for k, r in shapes.items()], "extent_id int, source_key string, event_count int, r array<array<struct<x:double,y:double>>>")
    return df.select("extent_id", "source_key", "event_count", geo.geometry(F.lit("Polygon"), F.col("r"), F.transform("r", lambda _: F.lit(0)), F.transform("r", lambda _, i: i > 0)).alias("geometry"))


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                odd = not odd
    return odd


def crosses(p, q, a, b):
    turn = lambda o, s, t: (s[0] - o[0]) * (t[1] - o[1]) - (t[0] - o[0]) * (s[1] - o[1])
    return turn(a, b, p) * turn(a, b, q) <= 0 and turn(p, q, a) * turn(p, q, b) <= 0


def meet(box, rings):
    x0, y0, x1, y1 = box
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    if any(crosses(p, q, a, b) for p, q in zip(corners, corners[1:]) for r in rings for a, b in zip(r, r[1:])):
        return True
    return inside(x0, y0, rings) or any(x0 < x < x1 and y0 < y < y1 for r in rings for x, y in r)


def some_cells(spark, n=500):
    rng = random.Random(2)
    boxes = [(x, y, x + rng.uniform(0.0003, 0.02), y + rng.uniform(0.0003, 0.02)) for x, y in ((rng.uniform(-0.01, 0.2), rng.uniform(-0.01, 0.1)) for _ in range(n))]
    df = spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "cell_id int, xmin double, ymin double, xmax double, ymax double")
    return boxes, spatial.with_box(df).select("cell_id", "bbox")


def test_left_join_and_count(spark):
    boxes, cells = some_cells(spark)
    want = {i: {k for k, rings in SHAPES.items() if meet(b, rings)} for i, b in enumerate(boxes)}
    got = {}
    for r in spatial.left_spatial_join(cells, extents(spark), "demo:gfd:frequency:").collect():
        got.setdefault(r.cell_id, []).append(r.extent_id)
    assert {i: set(k) - {None} for i, k in got.items()} == want and all(len(k) == max(1, len(want[i])) for i, k in got.items())
    assert {len(k) for k in want.values()} >= {0, 1, 2}
    counts = {r.cell_id: r.historical_event_count for r in spatial.historical_count(cells, extents(spark), "demo:gfd:frequency:").collect()}
    assert counts == {i: max(k, default=0) for i, k in want.items()}


def test_borders_touch(spark):
    """A common border or corner counts, on the borders of buckets too."""
    shape = {7: [[(0.01, 0.01), (0.02, 0.01), (0.02, 0.02), (0.01, 0.02), (0.01, 0.01)]]}
    boxes = [(0.02, 0.02, 0.03, 0.03), (0.0, 0.0, 0.01, 0.01), (0.02, 0.012, 0.025, 0.013), (0.0200001, 0.0, 0.03, 0.03), (0.005, 0.02, 0.03, 0.021)]
    cells = spatial.with_box(spark.createDataFrame([(i, *b) for i, b in enumerate(boxes)], "cell_id int, xmin double, ymin double, xmax double, ymax double"))
    met = outlines.meeting(cells, outlines.outline(extents(spark, shape), ["extent_id"]), ["extent_id"])
    assert sorted(r.cell_id for r in met.collect()) == [0, 1, 2, 4]


def test_overlap_areas(spark):
    """Areas by pieces equal those of the whole polygon clipped to the cell."""
    _, cells = some_cells(spark)
    e = extents(spark)
    pieces = outlines.outline(e, ["extent_id"])
    got = {(r.cell_id, r.extent_id): r.overlap_m2 for r in outlines.overlaps(cells, pieces, ["extent_id"]).collect()}
    pairs = cells.crossJoin(e.select("extent_id", "geometry"))  # a fixture of four shapes
    want = {(r.cell_id, r.extent_id): r.overlap_m2 for r in polygons.with_clip_area(pairs, "geometry", "bbox").collect() if r.overlap_m2 > 1e-3}
    assert {k for k, v in got.items() if v > 1e-3} == set(want)
    assert all(got[k] == pytest.approx(a, rel=1e-6, abs=1e-3) for k, a in want.items())


def test_crowded_place_is_descended(spark):
    """Thousands of vertices in one bucket: every level halves, and the area stays."""
    rng = random.Random(3)
    rows = []
    for k in range(400):
        x, y, s = rng.uniform(0, 0.9), rng.uniform(0, 0.9), rng.uniform(0.01, 0.1)
        rows.append((1, x, y, x + s, y + s))
    df = spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double").select("k", geo.box("x0", "y0", "x1", "y1").alias("geometry"))
    areas = [polygons.dissolve(df, ["k"], 1.0, crowd=c, planar=True, split=2).agg(F.sum("area_m2")).first()[0] for c in (10**9, 60)]
    assert areas[0] == pytest.approx(areas[1], rel=1e-9)
    point = [(1, [[(0.5, 0.5), (0.5 + rng.uniform(-0.4, 0.4), 0.9), (0.5 + rng.uniform(-0.4, 0.4), 0.1), (0.5, 0.5)]]) for _ in range(60)]
    fan = spark.createDataFrame(point, "k int, r array<array<struct<x:double,y:double>>>").select("k", geo.geometry(F.lit("Polygon"), F.col("r"), F.array(F.lit(0)), F.array(F.lit(False))).alias("geometry"))
    areas = [polygons.dissolve(fan, ["k"], 1.0, crowd=c, planar=True, split=2, levels=4).agg(F.sum("area_m2")).first()[0] for c in (10**9, 20)]
    assert areas[0] == pytest.approx(areas[1], rel=1e-9)
