"""Clipped cells of a rotated grid over a boundary of several parts with a hole."""

import pytest
from pyspark.sql import functions as F

from hydrolens.functions import geo
from hydrolens.operators import outlines, polygons, spatial

PARTS = [
    [[(95.60, 16.60), (95.63, 16.605), (95.625, 16.63), (95.605, 16.632), (95.60, 16.60)], [(95.61, 16.61), (95.62, 16.61), (95.615, 16.62), (95.61, 16.61)]],
    [[(95.65, 16.60), (95.67, 16.60), (95.67, 16.606), (95.656, 16.606), (95.656, 16.62), (95.65, 16.62), (95.65, 16.60)]],
]
WATER = [[[(95.59, 16.59), (95.66, 16.595), (95.612, 16.64), (95.59, 16.59)]]]


def shapes(spark, parts, **columns):
    df = spark.createDataFrame([(r,) for r in parts], "r array<array<struct<x:double,y:double>>>")
    shape = geo.geometry(F.lit("Polygon"), F.col("r"), F.transform("r", lambda _: F.lit(0)), F.transform("r", lambda _, i: i > 0))
    return df.select(*[F.lit(v).alias(k) for k, v in columns.items()], shape.alias("geometry"))


def test_areas_of_cells_add_up_to_the_boundary(spark):
    boundary = shapes(spark, PARTS)
    projected = boundary.select(geo.map_vertices("geometry", geo.to_utm).alias("g")).select("g.rings").collect()

    def shoelace(ring):
        return abs(sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:]))) / 2

    # coordinates are moved near the origin first, so that the sum itself is exact enough
    def near(ring):
        return [type(p)(x=p.x - ring[0].x, y=p.y - ring[0].y) for p in ring]

    wanted = sum(shoelace(near(r)) * (1 if i == 0 else -1) for row in projected for i, r in enumerate(row.rings))
    pieces = spatial.grid_pieces(boundary, 250)
    assert pieces.agg(F.sum("area_m2")).first()[0] == pytest.approx(wanted, rel=1e-9)
    by_cell = {(r.grid_i, r.grid_j): r.a for r in pieces.groupBy("grid_i", "grid_j").agg(F.sum("area_m2").alias("a")).collect()}
    squares = {(r.grid_i, r.grid_j): r.cell_area_m2 for r in spatial.square_grid(boundary, 250).collect()}
    assert by_cell.keys() == squares.keys() and all(by_cell[k] == pytest.approx(squares[k], rel=1e-9) for k in squares)


def test_shares_of_clipped_cells(spark):
    boundary, water = shapes(spark, PARTS), shapes(spark, WATER, event_id=7)
    cells, wet = spatial.grid_pieces(boundary, 500), outlines.outline(water, ["event_id"])
    shares = {(r.grid_i, r.grid_j): r.flooded_fraction for r in spatial.piece_fraction(cells, wet).collect()}
    area = {(r.grid_i, r.grid_j): r.cell_area_m2 for r in spatial.square_grid(boundary, 500).collect()}
    both = polygons.clip_to_boundary(water, boundary, ["event_id"]).agg(F.sum("area_m2")).first()[0]
    whole = boundary.agg(F.sum(geo.area_m2("geometry"))).first()[0]
    # cells are weighed in the plane, shares in the equal-area plane
    assert sum(shares[k] * area[k] for k in shares) / sum(area.values()) == pytest.approx(both / whole, rel=1e-4)
    inner = [v for v in shares.values() if v > 1 - 1e-9]
    assert inner and max(shares.values()) <= 1 and len(shares) < len(area)
    # a cell of which only a corner lies in the boundary, all of it wet, is full although its square is not
    partial = [k for k, v in shares.items() if v > 1 - 1e-9 and area[k] < 200000]
    assert partial
