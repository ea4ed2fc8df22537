"""Rings that are clipped and tested side by side give what one ring at a time gives."""

import random

import numpy as np
import pandas as pd

from hydrolens.operators import polygons


def _rings(seed, count):
    rng = random.Random(seed)
    rings = []
    for _ in range(count):
        n = rng.randint(3, 9)
        ring = np.array([(rng.uniform(0, 4), rng.uniform(0, 4)) for _ in range(n)])
        rings.append(np.vstack([ring, ring[:1]]))
    return rings


def test_blocks_clip_as_single_rings():
    rng = random.Random(3)
    rings = _rings(1, 300)
    boxes = np.array([(x := rng.uniform(-1, 4), y := rng.uniform(-1, 4), x + rng.uniform(0.1, 4), y + rng.uniform(0.1, 4)) for _ in rings])
    for which, block in polygons._by_length([r[:-1] for r in rings], 100):
        got = polygons._clipped_areas(block, boxes[which])
        for i, area in zip(which, got):
            piece = polygons._clip_ring(rings[i], boxes[i])
            want = polygons._ring_area(polygons._closed(piece), False) if len(piece) >= 3 else 0.0
            assert abs(area - want) <= 1e-6 * max(1.0, want) + 1e-3


def test_blocks_cross_as_single_rings():
    rings = _rings(2, 300) + [np.array([(0, 0), (1, 0), (1, 0), (1, 1), (0, 0)], dtype=float), np.empty((0, 2)), np.array([(0, 0), (2, 2), (2, 0), (0, 2)], dtype=float)]
    assert polygons._rings_crossing(rings).tolist() == [polygons._ring_crosses(r) for r in rings]


def test_holes_and_outside():
    square, hole, far = [0, 0, 4, 0, 4, 4, 0, 4, 0, 0], [1, 1, 2, 1, 2, 2, 1, 2, 1, 1], [8, 8, 9, 8, 9, 9, 8, 9, 8, 8]
    xy = pd.Series([square + hole, square, far])
    got = polygons._clip_area.func(xy, pd.Series([[5, 5], [5], [5]]), pd.Series([[False, True], [False], [False]]), *[pd.Series([float(v)] * 3) for v in (0, 0, 3, 3)])
    whole, inner = (polygons._ring_area(polygons._box(b), False) for b in ((0, 0, 3, 3), (1, 1, 2, 2)))
    assert np.allclose(got, [whole - inner, whole, 0.0], rtol=1e-9)


def test_point_ids_of_high_rows(spark):
    """Point ids of the 30,000th pixel row lie above the range of int."""
    from pyspark.sql import functions as F

    from hydrolens.workload.spatial import points_samples

    class Made:
        v_pixels = spark.createDataFrame([(30000, 5)], "px_row int, px_col int")
        v_cells = spark.createDataFrame([(1, 95.4, 16.4, 95.405, 16.405)], "cell_id long, xmin double, ymin double, xmax double, ymax double")
        v_predictions = spark.createDataFrame([(1, 0.5)], "cell_id long, probability double")

    points, _ = points_samples(Made)
    assert points.agg(F.max("point_id")).first()[0] == 3_000_000_005


def test_python_work_is_spread(spark):
    one = spark.range(100).coalesce(1)
    assert polygons.spread(one).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_overlaps_of_boxes_and_others(spark):
    """Boxes and triangles side by side; a box on the border of a cell has no area in it."""
    from pyspark.sql import functions as F

    from hydrolens.functions import geo
    from hydrolens.operators import spatial
    from hydrolens.workload.spatial import triangle

    rows = [(i, x := 0.003 * i, y := 0.002 * i, x + 0.01, y + 0.008) for i in range(12)] + [(99, 0.01, 0.0, 0.02, 0.01)]
    e = spark.createDataFrame(rows, "id int, xmin double, ymin double, xmax double, ymax double")
    shape = F.when(F.col("id") % 2 == 0, triangle()).otherwise(geo.box("xmin", "ymin", "xmax", "ymax"))
    cells = spark.createDataFrame([(1, 0.0, 0.0, 0.01, 0.01), (2, 0.02, 0.01, 0.03, 0.02)], "cell_id int, xmin double, ymin double, xmax double, ymax double")
    extents = e.select("id", shape.alias("geometry"))
    got = {(r.cell_id, r.id): r.overlap_m2 for r in spatial.polygon_overlaps(spatial.with_box(cells), extents, keep=["id"]).collect()}
    assert got[(1, 99)] == 0.0
    shapes = {r.id: [np.array([(p.x, p.y) for p in ring]) for ring in r.geometry.rings] for r in extents.collect()}
    boxes = {r.cell_id: (r.xmin, r.ymin, r.xmax, r.ymax) for r in cells.collect()}
    for (cell, i), area in got.items():
        piece = polygons._clip_ring(shapes[i][0], boxes[cell])
        want = polygons._ring_area(polygons._closed(piece), False) if len(piece) >= 3 else 0.0
        assert abs(area - want) <= 1e-3
