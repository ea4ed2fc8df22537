"""A wide outline is dissolved without its squares being gathered on the driver."""

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import polygons


def test_squares_of_a_wide_outline_are_not_broadcast(spark):
    # a rectangle of 90 x 80 buckets with a square beside it and one that crosses its side
    rings = [(0.5, 0.5, 90.5, 80.5), (100.0, 0.0, 101.0, 1.0), (90.0, 3.0, 92.0, 5.0)]
    rows = [("a", [x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], [5]) for x0, y0, x1, y1 in rings]
    df = spark.createDataFrame(rows, "k string, xy array<double>, size array<int>")
    found = polygons.dissolve(df, ["k"], 1.0, planar=True)
    total, buckets = found.agg(F.sum("area_m2"), F.countDistinct("bx", "by")).first()
    assert total == pytest.approx(90 * 80 + 1 + 2 * 2 - 0.5 * 2)
    assert buckets == 91 * 81 + 1 + 2 * 1
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
