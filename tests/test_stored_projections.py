"""Projected coordinates are stored before they are joined on, so that no scan or join repeats their series."""

from pyspark.sql import functions as F

from hydrolens.functions import geo
from hydrolens.plans import features


def test_terrain_grid_joins_stored_indices(spark):
    area = spark.range(1).select(geo.box(F.lit(95.4), F.lit(16.45), F.lit(95.42), F.lit(16.47)).alias("geometry"))
    # a cross join, as of rows and columns of a raster: filters on the indices would be drawn into it
    steps = spark.range(25).select(((F.col("id") - 2) * 0.001).alias("d"))
    pixels = steps.select((F.col("d") + 95.4005).alias("lon")).crossJoin(steps.select((F.col("d") + 16.4505).alias("lat"))).withColumn("value", F.col("lon") - 90)
    segments = spark.createDataFrame([(1, "river_segment", 95.39, 16.46, 95.43, 16.46)], "segment_id int, asset_type string, x1 double, y1 double, x2 double, y2 double")
    grid = features.build_terrain_grid(area, pixels, segments)
    assert "ATANH" not in grid._jdf.queryExecution().optimizedPlan().toString().upper()
    rows = grid.collect()
    inside = pixels.where("lon >= 95.4 and lon < 95.42 and lat >= 16.45 and lat < 16.47").count()
    assert sum(r.elevation_sample_count for r in rows) == inside == 400
    for r in rows:
        # the line runs at one latitude: the distance is that of the centre's latitude, about
        assert abs(r.distance_to_waterway_m - abs(r.y - 16.46) * 110660) < 2
        assert r.bbox.xmin < r.x < r.bbox.xmax and r.bbox.ymin < r.y < r.bbox.ymax
