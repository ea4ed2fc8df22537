"""Spatial joins as equi-joins on grid buckets.

A box is copied to the buckets it meets; pairs meet in a bucket, and each pair is kept only in the bucket
that holds the lower-left corner of the two boxes' overlap, so no distinct is needed. Bucket keys are
ordinary join keys, so adaptive skew handling splits crowded buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.functions import geo
from hydrolens.operators import outlines, polygons
from hydrolens.session import materialize


def bbox_of(*names: str) -> Column:
    return F.struct(*[F.col(n).alias(a) for n, a in zip(names, ("xmin", "ymin", "xmax", "ymax"))])


def with_box(df: DataFrame, names: Sequence[str] = ("xmin", "ymin", "xmax", "ymax"), name: str = "bbox") -> DataFrame:
    return df.withColumn(name, bbox_of(*names))


def _bucketed(df: DataFrame, box: str, size: float, tag: str) -> DataFrame:
    def span(low: str, high: str) -> Column:
        return F.sequence(
            F.floor(F.col(box)[low] / size).cast("bigint"), F.floor(F.col(box)[high] / size).cast("bigint")
        )

    return df.withColumn(f"{tag}x", F.explode(span("xmin", "xmax"))).withColumn(f"{tag}y", F.explode(span("ymin", "ymax")))


def bbox_join(left: DataFrame, right: DataFrame, left_box: str = "bbox", right_box: str = "right_bbox", bucket_deg: float = 0.02) -> DataFrame:
    """All pairs of rows whose boxes meet, each once. Other column names must not clash."""
    a = _bucketed(left, left_box, bucket_deg, "__l")
    b = _bucketed(right, right_box, bucket_deg, "__r")
    l, r = F.col(left_box), F.col(right_box)
    home_x = F.floor(F.greatest(l["xmin"], r["xmin"]) / bucket_deg).cast("bigint")
    home_y = F.floor(F.greatest(l["ymin"], r["ymin"]) / bucket_deg).cast("bigint")
    condition = (
        (F.col("__lx") == F.col("__rx")) & (F.col("__ly") == F.col("__ry"))
        & geo.bbox_intersects(l, r) & (home_x == F.col("__lx")) & (home_y == F.col("__ly"))
    )
    return a.join(b, condition).drop("__lx", "__ly", "__rx", "__ry")


def spatial_join(left: DataFrame, right: DataFrame, bucket_deg: float = 0.02, left_geometry: str = "geometry", right_geometry: str = "right_geometry") -> DataFrame:
    """Pairs of rows whose geometries meet: boxes by bucket, then the exact test.

    Geometries that are boxes are joined apart from the others, so that two boxes never reach Python.
    """
    a = left.withColumn("__lbox", F.col(left_geometry)["bbox"]).withColumn("__lplain", F.coalesce(polygons.is_box(left_geometry), F.lit(False)))
    b = right.withColumn("__rbox", F.col(right_geometry)["bbox"]).withColumn("__rplain", F.coalesce(polygons.is_box(right_geometry), F.lit(False)))

    def pairs(l: DataFrame, r: DataFrame) -> DataFrame:
        return bbox_join(l, r, "__lbox", "__rbox", bucket_deg)

    def done(df: DataFrame) -> DataFrame:
        return df.drop("__lbox", "__rbox", "__lplain", "__rplain")

    both = F.col("__lplain") & F.col("__rplain")
    boxes = done(pairs(a.where("__lplain"), b.where("__rplain")))
    # the condition becomes part of the join
    return boxes.unionByName(done(pairs(a, b).where(~both).where(polygons.intersects(left_geometry, right_geometry))))


def left_spatial_join(cells: DataFrame, extents: DataFrame, prefix: str, key: str = "cell_id", bucket_deg: float = 0.02) -> DataFrame:
    """Every cell with the extents of one key prefix that meet it; cells without any are kept.

    Extents with a ``geometry`` are met exactly, through their outlines; extents with a ``bbox`` alone are boxes.
    """
    if "geometry" in extents.columns:
        return outlines.left_join(cells, extents.where(F.col("source_key").startswith(prefix)), "source_key", key)
    wanted = extents.where(F.col("source_key").startswith(prefix)).withColumnRenamed("bbox", "right_bbox")
    pairs = bbox_join(cells.select(key, "bbox"), wanted, "bbox", "right_bbox", bucket_deg).drop("bbox", "right_bbox")
    return cells.join(pairs, key, "left")


def historical_count(cells: DataFrame, extents: DataFrame, prefix: str, key: str = "cell_id", bucket_deg: float = 0.02) -> DataFrame:
    """Largest event count of the frequency extents that meet each cell, zero without any. Geometries are met exactly."""
    if "geometry" in extents.columns:
        return outlines.largest_count(cells, extents.where(F.col("source_key").startswith(prefix)), key=key)
    wanted = extents.where(F.col("source_key").startswith(prefix)).select(F.col("bbox").alias("right_bbox"), "event_count")
    counts = (
        bbox_join(cells.select(key, "bbox"), wanted, "bbox", "right_bbox", bucket_deg)
        .groupBy(key)
        .agg(F.max("event_count").alias("historical_event_count"))
    )
    return cells.select(key).join(counts, key, "left").select(
        key, F.coalesce("historical_event_count", F.lit(0)).alias("historical_event_count")
    )


def box_overlaps(cells: DataFrame, extents: DataFrame, key: str = "cell_id", keep: Sequence[str] = (), bucket_deg: float = 0.02) -> DataFrame:
    """(key, kept extent columns, overlap_m2) for cells and box extents that meet."""
    other = extents.select(F.col("bbox").alias("right_bbox"), *keep)
    return bbox_join(cells.select(key, "bbox"), other, "bbox", "right_bbox", bucket_deg).select(
        key, *keep, geo.bbox_overlap_m2("bbox", "right_bbox").alias("overlap_m2")
    )


def polygon_overlaps(cells: DataFrame, extents: DataFrame, key: str = "cell_id", keep: Sequence[str] = (), bucket_deg: float = 0.02) -> DataFrame:
    """As ``box_overlaps`` for polygonal extents: the part of each polygon inside the cell box."""
    # as in ``spatial_join``, polygons that are boxes never reach Python
    plain_box = F.coalesce(polygons.is_box("geometry") & ~F.get("geometry.hole", F.lit(0)), F.lit(False))
    # stored, so that the geometry is made once a row and not once for each of its uses
    told = materialize(polygons.spread(extents.select("geometry", *keep)).withColumn("__plain", plain_box))
    plain = box_overlaps(cells, told.where("__plain").withColumn("bbox", F.col("geometry.bbox")), key, keep, bucket_deg)
    other = told.where("not __plain").select("geometry", F.col("geometry.bbox").alias("right_bbox"), *keep)
    pairs = bbox_join(cells.select(key, "bbox"), other, "bbox", "right_bbox", bucket_deg)
    return plain.unionByName(polygons.with_clip_area(pairs, "geometry", "bbox").select(key, *keep, "overlap_m2"))


def _cell_area() -> Column:
    b = F.col("bbox")
    return geo.box_area_m2(b["xmin"], b["ymin"], b["xmax"], b["ymax"])


def flooded_fraction(cells: DataFrame, overlaps: DataFrame, key: str = "cell_id", keys: Sequence[str] = ()) -> DataFrame:
    """Share of each cell under water, clamped to [0, 1]; only cells with an overlap are returned."""
    area = overlaps.groupBy(key, *keys).agg(F.sum("overlap_m2").alias("__wet"))
    share = F.try_divide(F.col("__wet"), F.nullif(_cell_area(), F.lit(0.0)))
    return area.join(cells.select(key, "bbox"), key).select(
        key, *keys, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)).alias("flooded_fraction")
    )


def union_fraction(cells: DataFrame, extents: DataFrame, keys: Sequence[str] = ("event_id",), key: str = "cell_id",
                   bucket_deg: float = 0.02) -> DataFrame:
    """Flooded share per cell and event where an event's overlapping polygons count once.

    Extents are first dissolved into disjoint pieces, whose overlaps may then be added up.
    """
    pieces = outlines.outline(extents, list(keys), bucket_deg)
    return outline_fraction(cells, pieces, keys, key, bucket_deg)


def outline_fraction(cells: DataFrame, pieces: DataFrame, keys: Sequence[str] = ("event_id",), key: str = "cell_id", bucket_deg: float = 0.02) -> DataFrame:
    """As ``union_fraction`` for extents that are outlines already, as an import leaves them. ``bucket_deg`` is that of the outline."""
    overlaps = outlines.overlaps(cells, pieces, list(keys), key, bucket_deg)
    return flooded_fraction(cells, overlaps, key, keys)


def _axis(xy: str, offset: int) -> Column:
    """The x (0) or y (1) values of a flat vertex array."""
    return F.filter(F.col(xy), lambda _, i: i % 2 == offset)


# --- nearest ------------------------------------------------------------------------------


#: The finest cells are ``base_deg`` by two to this power; a join of nodes starts with this many pairs at most; shapes in a leaf, about.
_FINEST, _START_PAIRS, _LEAF = 8, 2_000_000, 8


def _shapes(segments: DataFrame, kind: str, unit: float, k: int) -> DataFrame:
    """(kind, ends, ids, n, c, bx, by): segments of equal ends as one row with their ``k`` least ids. ``bx`` and ``by`` are the finest cell of the
    lower left corner, ``c`` is the level whose cells are as wide as the segment."""
    ends = ("x1", "y1", "x2", "y2")
    given = segments.select(kind, "segment_id", *ends).dropna(subset=[kind, *ends])
    if k == 1:
        shapes = given.groupBy(kind, *ends).agg(F.array(F.min(F.struct("segment_id"))).alias("ids"))
    else:
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy(kind, *ends).orderBy("segment_id"))
        least = given.dropDuplicates().withColumn("__r", place).where(F.col("__r") <= k)
        shapes = least.groupBy(kind, *ends).agg(F.collect_list(F.struct("segment_id")).alias("ids"))
    length = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    return shapes.select(
        kind, *ends, "ids", F.size("ids").alias("n"), F.when(length > unit, F.ceil(F.log2(length / unit))).otherwise(0).cast("int").alias("c"),
        F.floor(F.least("x1", "x2") / unit).cast("bigint").alias("bx"), F.floor(F.least("y1", "y2") / unit).cast("bigint").alias("by"),
    )


def _up(c: str, level: int, own: str | None = None) -> Column:
    """The cell of a level that holds a finest cell; a segment stays on its own level ``own`` below that."""
    return F.expr(f"shiftright({c}, {level})" if own is None else f"shiftright({c}, greatest({own}, {level}))")


def _point_nodes(places: DataFrame, level: int) -> DataFrame:
    return places.groupBy(_up("px", level).alias("qx"), _up("py", level).alias("qy")).agg(F.struct(
        F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax")).alias("q"))


def _shape_nodes(shapes: DataFrame, kind: str, level: int) -> DataFrame:
    """Nodes of a level with the box of their segments, one end, the number of segments and the node of the level above."""
    return shapes.groupBy(
        kind, "c", _up("bx", level, "c").alias("rx"), _up("by", level, "c").alias("ry"), _up("bx", level + 1, "c").alias("ax"), _up("by", level + 1, "c").alias("ay"),
    ).agg(
        F.struct(
            F.min(F.least("x1", "x2")).alias("xmin"), F.min(F.least("y1", "y2")).alias("ymin"), F.max(F.greatest("x1", "x2")).alias("xmax"), F.max(F.greatest("y1", "y2")).alias("ymax"),
        ).alias("r"),
        F.min(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))).alias("v"), F.sum("n").alias("n"),
    )


def _kept(pairs: DataFrame, kind: str, k: int, slack: float) -> DataFrame:
    """Pairs of nodes that may hold one of the ``k`` nearest segments of some point of the point node, with a ``reach`` that none of these exceeds."""
    from pyspark.sql import Window

    q, r, v = F.col("q"), F.col("r"), F.col("v")
    gaps = [F.greatest(r[f"{a}min"] - q[f"{a}max"], q[f"{a}min"] - r[f"{a}max"], F.lit(0.0)) for a in "xy"]
    if k == 1:
        far = [F.greatest(F.abs(v[a] - q[f"{a}min"]), F.abs(v[a] - q[f"{a}max"])) for a in "xy"]
    else:
        far = [F.greatest(r[f"{a}max"] - q[f"{a}min"], q[f"{a}max"] - r[f"{a}min"]) for a in "xy"]
    node = Window.partitionBy(kind, "qx", "qy")
    held = F.sum("n").over(node.orderBy("__far").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    told = pairs.withColumns({"__near": F.hypot(*gaps), "__far": F.hypot(*far)}).withColumn("__held", held)
    bound = F.min(F.when(F.col("__held") >= k, F.col("__far"))).over(node) * (1 + 1e-9) + slack
    # fewer than k segments in all: nothing bounds the search
    bounded = told.withColumn("reach", F.coalesce(bound, F.lit(float("inf"))))
    return bounded.where(F.col("__near") <= F.col("reach")).select(kind, "qx", "qy", "q", "c", "rx", "ry", "reach")


def _leaf_pairs(places: DataFrame, shapes: DataFrame, kind: str, levels: int, k: int) -> tuple[DataFrame, int]:
    """(kind, qx, qy, c, rx, ry, reach): point cells with the segment cells to search, both of the level that is returned as well."""
    top = _FINEST + levels + 15

    # one row for each side: how many nodes every second level has, about, and the largest coordinate
    def sizes(df: DataFrame, x: str, y: str, *own: str) -> Column:
        return [F.approx_count_distinct(F.struct(*own, _up(x, i, *own[1:]), _up(y, i, *own[1:]))).alias(f"n{i}") for i in range(0, top + 1, 2)]

    of_points = places.agg(*sizes(places, "px", "py"), F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("far")).first()
    of_shapes = shapes.agg(*sizes(shapes, "bx", "by", kind, "c"), F.count(F.lit(1)).alias("n"), F.max(F.greatest(*[F.abs(e) for e in ("x1", "y1", "x2", "y2")])).alias("far")).first()
    leaf = max((i for i in range(0, _FINEST + 1, 2) if of_shapes[f"n{i}"] * _LEAF >= of_shapes["n"]), default=0)
    start = next((i for i in range(leaf, top, 2) if of_points[f"n{i}"] * of_shapes[f"n{i}"] <= _START_PAIRS), top)
    slack = 1e-14 * max(of_points["far"] or 0.0, of_shapes["far"] or 0.0)

    pairs = _kept(_point_nodes(places, start).crossJoin(_shape_nodes(shapes, kind, start)), kind, k, slack)
    for level in range(start - 1, leaf - 1, -1):
        pairs = materialize(pairs.drop("reach"))
        # first the segments go down and are thinned out, then the points
        below = _shape_nodes(shapes, kind, level)
        closer = pairs.select(kind, "c", "qx", "qy", "q", F.col("rx").alias("ax"), F.col("ry").alias("ay")).join(below, [kind, "c", "ax", "ay"])
        thinned = _kept(closer, kind, k, slack).withColumnsRenamed({"qx": "__ax", "qy": "__ay"}).drop("q")
        inner = _point_nodes(places, level).withColumns({"__ax": _up("qx", 1), "__ay": _up("qy", 1)})
        pairs = thinned.join(inner, ["__ax", "__ay"]).drop("__ax", "__ay")
    return pairs.select(kind, "qx", "qy", "c", "rx", "ry", "reach"), leaf


def nearest_segments(points: DataFrame, segments: DataFrame, kind: str = "asset_type", key: str = "cell_id",
                     base_deg: float = 0.005, levels: int = 17, k: int = 1) -> DataFrame:
    """The ``k`` nearest segments of every kind for each point, with their ``rank``: chosen in degrees, reported in metres as well.

    Points and segments are both sorted into pyramids of cells, whose nodes know the box of what they hold. The search goes down both pyramids together:
    a pair of nodes is kept while the boxes may hold a nearest segment, which the farthest distance to the best nodes found so far decides. So a point far
    from all segments follows the few nodes at their edge, and none looks at all segments. It starts where there are few pairs of nodes, at most ``levels`` levels
    above cells of ``base_deg`` if so, and ends with cells of a few segments. Exact at any distance.
    """
    ends = ("x1", "y1", "x2", "y2")
    unit = base_deg / 2**_FINEST
    places = materialize(points.select("x", "y").dropna().distinct().select(
        "x", "y", F.floor(F.col("x") / unit).cast("bigint").alias("px"), F.floor(F.col("y") / unit).cast("bigint").alias("py")))
    shapes = materialize(_shapes(segments, kind, unit, k))
    leaves, leaf = _leaf_pairs(places, shapes, kind, levels, k)
    at = places.select("x", "y", _up("px", leaf).alias("qx"), _up("py", leaf).alias("qy"))
    held = shapes.select(kind, "c", *ends, "ids", _up("bx", leaf, "c").alias("rx"), _up("by", leaf, "c").alias("ry"))
    distance = geo.segment_distance_deg("x", "y", *ends)
    candidates = leaves.join(at, ["qx", "qy"]).join(held, [kind, "c", "rx", "ry"]).where(distance <= F.col("reach"))
    if k == 1:
        score = F.struct(distance, F.col("ids")[0]["segment_id"])
        near = candidates.groupBy("x", "y", kind).agg(F.min_by(F.struct(F.col("ids")[0]["segment_id"].alias("segment_id"), *ends), score).alias("b"))
    else:
        from pyspark.sql import Window

        one = candidates.select("x", "y", kind, F.explode("ids").alias("__id"), *ends)
        order = Window.partitionBy("x", "y", kind).orderBy(distance, "__id")
        near = one.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).select("x", "y", kind, F.struct(F.col("__id.segment_id").alias("segment_id"), *ends).alias("b"))
    found = points.select(key, "x", "y").join(near, ["x", "y"]).select(key, kind, F.struct("b.segment_id", *[f"b.{e}" for e in ends], "x", "y").alias("b"))
    score = F.struct(geo.segment_distance_deg(*[F.col(f"b.{c}") for c in ("x", "y", *ends)]), F.col("b.segment_id"))
    if k == 1:
        # a key may have several places
        best = found.groupBy(key, kind).agg(F.min_by("b", score).alias("b")).withColumn("rank", F.lit(1))
    else:
        once = found.dropDuplicates([key, kind, "b"]).withColumn("__score", score)
        best = once.withColumn("rank", F.row_number().over(Window.partitionBy(key, kind).orderBy("__score"))).where(F.col("rank") <= k)
    return best.select(
        key, kind, F.col("b.segment_id").alias("segment_id"),
        geo.segment_distance_deg(*[F.col(f"b.{c}") for c in ("x", "y", *ends)]).alias("distance_deg"),
        geo.segment_distance_m(*[F.col(f"b.{c}") for c in ("x", "y", *ends)]).alias("distance_m"),
        *([] if k == 1 else ["rank"]),
    )


def nearest_waterway(cells: DataFrame, segments: DataFrame, key: str = "cell_id") -> DataFrame:
    """Distances to the nearest river and canal and the smaller of the two, in metres."""
    nearest = nearest_segments(cells, segments, "asset_type", key)

    def of(kind: str) -> Column:
        return F.max(F.when(F.col("asset_type") == kind, F.col("distance_m")))

    pivoted = nearest.groupBy(key).agg(
        of("river_segment").alias("distance_to_river_m"), of("canal_segment").alias("distance_to_canal_m")
    )
    return pivoted.withColumn("distance_to_waterway_m", F.least("distance_to_river_m", "distance_to_canal_m"))


def distance_to_network(cells: DataFrame, segments: DataFrame, key: str = "cell_id", zone: int = 46, base_m: float = 500.0) -> DataFrame:
    """Planar UTM distance of each point to the nearest part of the whole network."""
    def project(x: str, y: str, tag: str, df: DataFrame) -> DataFrame:
        return df.withColumn(tag, geo.to_utm(x, y, zone))

    # each side is projected once and stored: a later step would repeat the whole series for every use of a coordinate
    p = materialize(project("x", "y", "u", polygons.spread(cells.select(key, "x", "y"))).select(key, F.col("u.x").alias("x"), F.col("u.y").alias("y")))
    s = project("x2", "y2", "v", project("x1", "y1", "u", polygons.spread(segments.select("segment_id", "x1", "y1", "x2", "y2")))).select(
        F.lit("network").alias("kind"), "segment_id", F.col("u.x").alias("x1"), F.col("u.y").alias("y1"), F.col("v.x").alias("x2"), F.col("v.y").alias("y2")
    )
    near = nearest_segments(p, materialize(s), "kind", key, base_m)
    return near.select(key, F.col("distance_deg").alias("distance_to_waterway_m"))  # units of the plane: metres


# --- interpolation ------------------------------------------------------------------------

IDW_RADIUS_M = 500.0 * math.sqrt(2) * 0.55
NEAREST_M = 275.0


def _neighbourhood(points: DataFrame, samples: DataFrame, radius_m: float, point: str, sample: str) -> DataFrame:
    """Pairs within ``radius_m``. Rows of buckets are one radius high; within a row the bucket width follows
    the row's own latitude, and each sample is copied to the 3x3 buckets around it in every row's own width."""
    step = radius_m / geo.METRES_PER_DEGREE

    def width(row: Column) -> Column:
        # widest degrees for one radius among the rows a neighbour may come from
        edge = F.least(F.lit(89.9), F.greatest(F.abs((row - 1) * step), F.abs((row + 2) * step)))
        return step / F.cos(F.radians(edge))

    p = points.withColumn("__row", F.floor(F.col("lat") / step).cast("bigint")).withColumn(
        "__column", F.floor(F.col("lng") / width(F.col("__row"))).cast("bigint")
    )
    offsets = F.array(F.lit(-1), F.lit(0), F.lit(1))
    s = (
        samples.select(F.col(sample).alias("__sample"), F.col("lat").alias("__lat"), F.col("lng").alias("__lng"), F.col("value").alias("__value"))
        .withColumn("__d", F.explode(offsets))
        .withColumn("__row", F.floor(F.col("__lat") / step).cast("bigint") + F.col("__d"))
        .withColumn("__e", F.explode(offsets))
        .withColumn("__column", F.floor(F.col("__lng") / width(F.col("__row"))).cast("bigint") + F.col("__e"))
        .drop("__d", "__e")
    )
    distance = geo.distance_m("lat", "lng", "__lat", "__lng")
    return p.join(s, ["__row", "__column"]).withColumn("distance_m", distance).where(F.col("distance_m") <= radius_m)


def idw(points: DataFrame, samples: DataFrame, radius_m: float = IDW_RADIUS_M, power: float = 2.0, point: str = "point_id", sample: str = "sample_id") -> DataFrame:
    """Inverse-distance value at each point; a sample within 0.5 m is returned as is; null without samples."""
    near = _neighbourhood(points, samples, radius_m, point, sample)
    weight = F.when(F.col("distance_m") > 0, 1.0 / F.pow("distance_m", F.lit(power)))
    summed = near.groupBy(point).agg(
        F.min_by("__value", F.struct("distance_m", "__sample")).alias("__nearest"),
        F.min("distance_m").alias("__least"),
        F.sum(weight * F.col("__value")).alias("__wv"),
        F.sum(weight).alias("__w"),
    )
    value = F.when(F.col("__least") < 0.5, F.col("__nearest")).otherwise(F.try_divide("__wv", "__w"))
    return points.select(point).join(summed.select(point, value.alias("value")), point, "left")


def nearest_sample(points: DataFrame, samples: DataFrame, max_m: float = NEAREST_M, point: str = "point_id", sample: str = "sample_id") -> DataFrame:
    """Nearest sample closer than ``max_m``; points without one are absent."""
    near = _neighbourhood(points, samples, max_m, point, sample).where(F.col("distance_m") < max_m)
    return near.groupBy(point).agg(
        F.min_by("__sample", F.struct("distance_m", "__sample")).alias(sample), F.min("distance_m").alias("distance_m")
    )


# --- grids --------------------------------------------------------------------------------


def _grid_cut(boundary: DataFrame, size_m: int, zone: int) -> DataFrame:
    """(bx, by, xy, area_m2): the boundary's disjoint convex pieces in each square, in the plane."""
    if size_m not in (100, 250, 500, 1000):
        raise ValueError("size_m must be 100, 250, 500 or 1000")
    projected = boundary.select(F.lit(1).alias("__b"), geo.map_vertices("geometry", lambda x, y: geo.to_utm(x, y, zone)).alias("geometry"))
    return polygons.dissolve(projected, ["__b"], float(size_m), planar=True)


def grid_pieces(boundary: DataFrame, size_m: int = 500, zone: int = 46) -> DataFrame:
    """The clipped geometry of ``square_grid``: (grid_i, grid_j, xy in degrees, area_m2 in the plane).

    The boundary may have many parts and holes. A square is one or several rows, disjoint convex rings that follow the rotated sides of the square
    and the boundary inside it; no row or task holds more than a square.
    """
    points = F.transform(
        F.sequence(F.lit(0), (F.size("xy") / 2).cast("int") - 1), lambda i: geo.from_utm(F.get("xy", 2 * i), F.get("xy", 2 * i + 1), zone)
    )
    placed = _grid_cut(boundary, size_m, zone).select(F.col("bx").alias("grid_i"), F.col("by").alias("grid_j"), points.alias("p"), "area_m2")
    return placed.select("grid_i", "grid_j", F.flatten(F.transform("p", lambda p: F.array(p["x"], p["y"]))).alias("xy"), "area_m2")


def piece_fraction(cells: DataFrame, extents: DataFrame, keys: Sequence[str] = ("event_id",), key: Sequence[str] = ("grid_i", "grid_j"),
                   bucket_deg: float = outlines.BUCKET_DEG) -> DataFrame:
    """Share of each cell, given by its pieces, that lies in each extent, given as an outline; cells without an overlap are left out.

    The denominator is the cell's own area, not that of its square or box. Both sides meet bucket by bucket in disjoint pieces, so areas add up.
    """
    flat = cells.select(*key, "xy", F.array((F.size("xy") / 2).cast("int")).alias("size"))
    cut = polygons.bucket_pieces(flat, list(key), bucket_deg).select(*key, "bx", "by", "xy")
    whole = cut.withColumn("__a", polygons._meet("xy", "xy")).groupBy(*key).agg(F.sum("__a.area").alias("__whole"))
    near = cut.join(extents.select(*keys, "bx", "by", F.col("xy").alias("__window")), ["bx", "by"])
    wet = near.withColumn("__a", polygons._meet("xy", "__window")).groupBy(*key, *keys).agg(F.sum("__a.area").alias("__wet")).where("__wet > 0")
    share = F.least(F.lit(1.0), F.try_divide("__wet", "__whole"))
    return wet.join(whole, list(key)).select(*key, *keys, share.alias("flooded_fraction"))


def square_grid(boundary: DataFrame, size_m: int = 500, zone: int = 46) -> DataFrame:
    """Square UTM cells over a boundary: (grid_i, grid_j, coverage_fraction, cell_area_m2, bbox in degrees, x, y centre).

    The boundary is dissolved straight into the grid squares, so partial squares carry their exact area and share; ``grid_pieces`` has their geometry.
    """
    pieces = _grid_cut(boundary, size_m, zone)
    cells = pieces.groupBy("bx", "by").agg(F.sum("area_m2").alias("__m2"))
    size = float(size_m)
    # one row for each projected point, so that the series is written, and computed, once
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.5))])
    points = polygons.spread(cells).withColumn("__o", F.explode(offsets)).select(
        "bx", "by", "__m2", (F.col("__o.i") == 0.5).alias("__mid"), geo.from_utm((F.col("bx") + F.col("__o.i")) * size, (F.col("by") + F.col("__o.j")) * size, zone).alias("__p")
    )
    corner, centre = F.when(~F.col("__mid"), F.col("__p")), F.when(F.col("__mid"), F.col("__p"))
    placed = points.groupBy("bx", "by", "__m2").agg(
        F.struct(F.min(corner["x"]).alias("xmin"), F.min(corner["y"]).alias("ymin"), F.max(corner["x"]).alias("xmax"), F.max(corner["y"]).alias("ymax")).alias("bbox"),
        F.max(centre["x"]).alias("x"), F.max(centre["y"]).alias("y"),
    )
    return placed.select(
        F.col("bx").alias("grid_i"), F.col("by").alias("grid_j"), (F.col("__m2") / size**2).alias("coverage_fraction"), F.col("__m2").alias("cell_area_m2"),
        "bbox", "x", "y",
    )


def grid_weights(boundary: DataFrame, step_deg: float = 0.25, zone: int = 46) -> DataFrame:
    """Model grid points with the share of the boundary inside their footprint; shares add up to one."""
    half = step_deg / 2
    pieces = polygons.dissolve(boundary.select(F.lit(1).alias("__b"), "geometry"), ["__b"], step_deg, origin=(-half, -half))
    vertices = F.transform(
        F.sequence(F.lit(0), (F.size("xy") / 2).cast("int") - 1),
        lambda i: geo.to_utm(F.get("xy", i * 2), F.get("xy", i * 2 + 1), zone),
    )
    pieces = pieces.select("bx", "by", vertices.alias("ring"))
    planar = geo.planar_ring_area(F.col("ring"))
    area = pieces.groupBy("bx", "by").agg(F.sum(planar).alias("area_m2"))
    from hydrolens.operators.aggregates import with_share

    return with_share(area, "area_m2", "weight").select(
        F.round(F.col("by") * step_deg, 4).alias("latitude"), F.round(F.col("bx") * step_deg, 4).alias("longitude"), "weight"
    )


# --- lines --------------------------------------------------------------------------------


def segment_lines(lines: DataFrame, boundary: DataFrame, max_m: float = 500.0, key: str = "line_id", prefix: str = "osm",
                  area: str = "area", zone: int = 46, bucket_m: float = 2000.0) -> DataFrame:
    """Waterway lines inside a boundary, cut to pieces of at most ``max_m`` metres.

    ``lines`` holds the key, ``name``, ``waterway`` and a line geometry in degrees. The result has part and
    segment numbers, a stable ``source_key``, the length and the piece as a geometry. Steps: measure along
    each line in UTM, meet its edges with the boundary's convex pieces bucket by bucket, join the covered
    measures into parts, and cut the parts.
    """
    if max_m <= 0:
        raise ValueError("segment length must be greater than zero")
    wanted = lines.where(F.col("waterway").isin(*K.WATERWAY_KINDS))
    rings, numbers = F.col("geometry.rings"), F.sequence(F.lit(1), F.size("geometry.rings"))
    one_line = wanted.withColumn("__shape", F.explode(F.arrays_zip(rings.alias("ring"), numbers.alias("shape"))))
    projected = one_line.select(
        *[c for c in lines.columns if c != "geometry"], F.col("__shape.shape").alias("shape"),
        F.transform("__shape.ring", lambda p: geo.to_utm(p["x"], p["y"], zone)).alias("path"),
    )
    # edges with the measure at their start
    length = F.expr("transform(path, (p, i) -> if(i = 0, 0D, hypot(p.x - path[i - 1].x, p.y - path[i - 1].y)))")
    measured = projected.withColumn("steps", length).withColumn(
        "measure", F.transform("steps", lambda _, i: F.aggregate(F.slice("steps", F.lit(1), i + 1), F.lit(0.0), lambda a, s: a + s))
    )
    edges = measured.select(
        key, "shape",
        F.posexplode(F.expr(
            "transform(slice(path, 1, size(path) - 1), (p, i) -> named_struct('x1', p.x, 'y1', p.y, 'x2', path[i + 1].x, 'y2', path[i + 1].y, 'm', measure[i], 'd', steps[i + 1]))"
        )).alias("edge", "e"),
    ).where(F.col("e.d") > 0)
    boxed = edges.withColumn(
        "bbox",
        F.struct(
            F.least("e.x1", "e.x2").alias("xmin"), F.least("e.y1", "e.y2").alias("ymin"),
            F.greatest("e.x1", "e.x2").alias("xmax"), F.greatest("e.y1", "e.y2").alias("ymax"),
        ),
    )
    frame = polygons.dissolve(
        boundary.select(F.lit(1).alias("__b"), geo.map_vertices("geometry", lambda x, y: geo.to_utm(x, y, zone)).alias("geometry")),
        ["__b"], bucket_m, planar=True,
    )
    frame = frame.select("xy", F.struct(
        F.array_min(_axis("xy", 0)).alias("xmin"), F.array_min(_axis("xy", 1)).alias("ymin"),
        F.array_max(_axis("xy", 0)).alias("xmax"), F.array_max(_axis("xy", 1)).alias("ymax"),
    ).alias("right_bbox"))
    inside = (
        bbox_join(boxed, frame, "bbox", "right_bbox", bucket_m)
        .withColumn("t", _convex_interval("e", "xy"))
        .where(F.col("t.low") < F.col("t.high"))
        .select(key, "shape", (F.col("e.m") + F.col("t.low") * F.col("e.d")).alias("from_m"), (F.col("e.m") + F.col("t.high") * F.col("e.d")).alias("to_m"))
    )
    parts = _merge_intervals(inside, [key, "shape"], 1e-6)
    from pyspark.sql import Window

    # one line is one stored value, so its parts and pieces are few enough for a window per line
    numbered = parts.withColumn("part_index", F.row_number().over(Window.partitionBy(key).orderBy("shape", "from_m")))
    cuts = numbered.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("to_m") - F.col("from_m")) / max_m - 1e-9).cast("int") - 1))))
    pieces = cuts.withColumn("a", F.col("from_m") + F.col("k") * max_m).withColumn("b", F.least(F.col("to_m"), F.col("from_m") + (F.col("k") + 1) * max_m)).where(F.col("b") > F.col("a"))
    sequenced = pieces.withColumn("segment_index", F.row_number().over(Window.partitionBy(key).orderBy("part_index", "k")))
    located = sequenced.select(key, "shape", "part_index", "segment_index", "a", "b").join(measured, [key, "shape"])

    def at(m: str) -> str:
        return (
            f"transform(slice(filter(transform(slice(path, 1, size(path) - 1), (p, i) -> named_struct('p', p, 'q', path[i + 1], 'm', measure[i], 'd', steps[i + 1])),"
            f" s -> s.d > 0 AND {m} <= s.m + s.d + 1e-9), 1, 1), s -> named_struct('x', s.p.x + (s.q.x - s.p.x) * ({m} - s.m) / s.d, 'y', s.p.y + (s.q.y - s.p.y) * ({m} - s.m) / s.d))"
        )

    inner = "transform(filter(transform(path, (p, i) -> named_struct('p', p, 'm', measure[i])), v -> v.m > a AND v.m < b), v -> v.p)"
    line = located.withColumn("__utm", F.expr(f"concat({at('a')}, {inner}, {at('b')})"))
    degrees = F.transform("__utm", lambda p: geo.from_utm(p["x"], p["y"], zone))
    label = F.concat(F.col("name"), F.lit(" · "), F.lpad(F.col("segment_index").cast("string"), 3, "0"))
    kept = [c for c in lines.columns if c not in ("geometry", "name", key)]
    return line.select(
        key,
        label.alias("name"),
        F.concat(F.col("waterway"), F.lit("_segment")).alias("asset_type"),
        F.concat_ws(":", F.lit(prefix), F.col(key).cast("string"), F.lit(area), F.col("part_index").cast("string"), F.col("segment_index").cast("string"), F.lit(str(int(max_m)))).alias("source_key"),
        "part_index",
        "segment_index",
        (F.col("b") - F.col("a")).alias("segment_length_m"),
        geo.geometry(F.lit("LineString"), F.array(degrees), F.array(F.lit(0)), F.array(F.lit(False))).alias("geometry"),
        *kept,
    )


def _convex_interval(edge: str, ring: str) -> Column:
    """Parameters between which an edge runs inside a counter-clockwise convex ring."""
    corner = "named_struct('x', {0}[2 * (i + {1})], 'y', {0}[2 * (i + {1}) + 1])".format
    sides = f"transform(sequence(0, size({ring}) div 2 - 2), i -> named_struct('p', {corner(ring, 0)}, 'q', {corner(ring, 1)}))"
    f0 = f"((s.q.x - s.p.x) * ({edge}.y1 - s.p.y) - (s.q.y - s.p.y) * ({edge}.x1 - s.p.x))"
    f1 = f"((s.q.x - s.p.x) * ({edge}.y2 - s.p.y) - (s.q.y - s.p.y) * ({edge}.x2 - s.p.x))"
    return F.expr(
        f"aggregate(transform({sides}, s -> named_struct('f0', {f0}, 'f1', {f1})), named_struct('low', 0D, 'high', 1D),"
        " (acc, s) -> named_struct("
        "'low', CASE WHEN s.f1 > s.f0 THEN greatest(acc.low, -s.f0 / (s.f1 - s.f0)) WHEN s.f1 = s.f0 AND s.f0 < 0 THEN 2D ELSE acc.low END,"
        "'high', CASE WHEN s.f1 < s.f0 THEN least(acc.high, -s.f0 / (s.f1 - s.f0)) ELSE acc.high END))"
    )


def _merge_intervals(df: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("from_m", "to_m")
    reach = F.max("to_m").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = df.withColumn("__new", (reach.isNull() | (F.col("from_m") > reach + tolerance)).cast("int"))
    islands = starts.withColumn("__island", F.sum("__new").over(order))
    return islands.groupBy(*keys, "__island").agg(F.min("from_m").alias("from_m"), F.max("to_m").alias("to_m")).drop("__island")
