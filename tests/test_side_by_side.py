"""Rings that are cut, united and met side by side equal those that are handled one by one; filled places are not cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydrolens.functions import geo
from hydrolens.operators import polygons, raster


def rings(n=40):
    rng = np.random.default_rng(5)
    for i in range(n):
        k = 3 + i % 5
        angle = np.sort(rng.uniform(0, 2 * np.pi, k))[:: 1 if i % 2 else -1]
        yield rng.uniform(-3, 3, 2) + rng.uniform(0.2, 2.5, (k, 1)) * np.column_stack([np.cos(angle), np.sin(angle)])


def test_clipped_rings_equal_one_by_one():
    for ring in rings():
        box = np.array([-1.0, -0.5, 1.5, 2.0])
        want = polygons._clip_ring(ring, box)
        points, alive = polygons._clip_many(ring[None], box[None])
        assert alive[0] == (len(want) > 0)
        if alive[0]:
            assert polygons._areas(points, True)[0] == pytest.approx(polygons._ring_area(polygons._closed(want), True), abs=1e-12)
            assert points.min() >= -1.0 and points[0, :, 0].max() <= 1.5


def test_convex_rings_equal_one_by_one():
    for ring in rings(60):
        want = polygons._convex(polygons._closed(ring))
        way = polygons._convex_many(ring[None])[0]
        assert (way == 0) == (want is None)
        if want is not None:
            assert (want == polygons._closed(ring)[::way]).all()


def test_meeting_of_convex_rings():
    square = [0.0, 0.0, 2.0, 0.0, 2.0, 2.0, 0.0, 2.0, 0.0, 0.0]
    moved = [1.0, 1.0, 3.0, 1.0, 3.0, 3.0, 1.0, 3.0, 1.0, 1.0]
    corner = [0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    far = [9.0, 9.0, 10.0, 9.0, 9.0, 10.0, 9.0, 9.0]
    found = polygons._meet.func(pd.Series([square, square, square]), pd.Series([moved, corner, far]))
    want = [polygons._ring_area(np.reshape(r, (-1, 2)), False) for r in ([1.0, 1.0, 2.0, 1.0, 2.0, 2.0, 1.0, 2.0, 1.0, 1.0], corner)]
    assert found.area.tolist() == pytest.approx([*want, 0.0], rel=1e-9) and found.xy[0].size == 10 and found.xy[2].size == 0


def test_filled_places_of_a_large_outline_are_not_cut(spark, monkeypatch):
    # 200 x 200 buckets, of which the border and a part beside it are partial
    outline = spark.createDataFrame([(1, 0.5, 0.5, 200.5, 200.5), (1, 10.0, 10.0, 11.5, 11.5), (2, 3.0, 3.0, 5.0, 4.5)], "k int, x0 double, y0 double, x1 double, y1 double")
    df = outline.select("k", geo.box("x0", "y0", "x1", "y1").alias("geometry"))
    cut = []
    plain = polygons._cut

    def counted(df, keys, size, *more):
        done = plain(df, keys, size, *more)
        if size == 1.0:
            cut.append(done.count())
        return done

    monkeypatch.setattr(polygons, "_cut", counted)
    pieces = polygons.dissolve(df, ["k"], 1.0, planar=True)
    one = pieces.where("k = 1").groupBy("bx", "by").agg(F.sum("area_m2").alias("a")).agg(F.count("a").alias("n"), F.sum("a").alias("a"), F.max("a").alias("m")).first()
    assert (one.n, one.a, one.m) == (201 * 201, pytest.approx(40000.0), pytest.approx(1.0))
    assert pieces.where("k = 2").agg(F.sum("area_m2")).first()[0] == pytest.approx(3.0)
    assert cut[0] < 201 * 201 / 2


def test_frequency_deals_out_pixels_before_it_counts(spark):
    px = spark.range(40).select((F.col("id") % 5).alias("px_row"), (F.col("id") % 5 + 1).alias("px_col"), (F.col("id") % 2).alias("flooded"), F.lit(None).cast("int").alias("permanent_water"))
    counted = raster.flood_frequency(px)
    assert {(r.px_row, r.event_count) for r in counted.collect()} == {(i, 4) for i in range(5)}
    plan = raster.flood_frequency(px)._jdf.queryExecution().executedPlan().toString()
    # the only exchange lies below both steps of the count
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.rindex("HashAggregate")


def test_thinned_rings_equal_one_by_one():
    import pyarrow as pa

    rng = np.random.default_rng(11)
    many = [r for r in rings(60)] + [np.round(rng.uniform(0, 3, (k, 2))) for k in (1, 2, 3, 9, 30, 200, 900)]
    many += [np.vstack([r, r[:1]]) for r in many] + [np.array([[0, 0], [np.nan, 1], [1, 1], [1, 0], [0, 0.0]]), np.zeros((6, 2))]
    rows = [many[i : i + 1 + i % 3] for i in range(0, len(many) - 2, 3)] + [[]]
    xy = pa.array([[float(v) for r in row for v in r.ravel()] for row in rows], pa.list_(pa.float64()))
    sizes = pa.array([[len(r) for r in row] for row in rows], pa.list_(pa.int32()))
    for tolerance in (0.0, 0.05, 0.6):
        found = polygons._simplified_rows(xy, sizes, tolerance).to_pylist()
        wanted = [[polygons._simplified(polygons._closed(r), tolerance) for r in row] for row in rows]
        for f, w in zip(found, wanted, strict=True):
            assert all(np.array_equal([(p["x"], p["y"]) for p in a], b, equal_nan=True) for a, b in zip(f, w, strict=True))
