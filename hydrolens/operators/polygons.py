"""Polygon work that needs loops over vertices: NumPy inside Arrow batches, spread by Spark.

Inside this module a polygon is flat: ``xy`` holds x0, y0, x1, y1, ... of all rings and ``size`` the vertices
per ring. Flat arrays cross the Arrow border without per-vertex objects, and no higher-order expression is
repeated for them. Areas are measured in the cylindrical equal-area plane (see ``functions.geo``); clipping and
sweeping run in degrees, where grid cells are boxes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from hydrolens.functions import geo
from hydrolens.operators.sweep import near_edges
from hydrolens.session import materialize

# --- flat polygons ------------------------------------------------------------------------

_XY = T.ArrayType(T.DoubleType())
_SIZE = T.ArrayType(T.IntegerType())
_PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("bx", T.LongType()), T.StructField("by", T.LongType()), T.StructField("xy", _XY),
            T.StructField("size", _SIZE), T.StructField("filled", T.BooleanType()),
        ]
    )
)
_PART = T.ArrayType(T.StructType([T.StructField("xy", _XY), T.StructField("size", _SIZE)]))
_CONVEX = T.ArrayType(T.StructType([T.StructField("xy", _XY), T.StructField("area", T.DoubleType())]))


def _flat(rings: Column) -> tuple[Column, Column]:
    xy = F.flatten(F.transform(F.flatten(rings), lambda p: F.array(p["x"], p["y"])))
    return xy, F.transform(rings, lambda r: F.size(r))


def _exploded(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of an array that a UDF made. The outer form keeps the optimizer from copying the call into an
    inferred filter on the array's size."""
    return df.select(*keys, F.explode_outer(column).alias("p")).where(F.col("p").isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores. Python costs far more a row than reading, and a file of few row groups is read by few tasks."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def flat_polygons(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """Replace a geometry column by its flat form."""
    xy, size = _flat(F.col(geom)["rings"])
    return df.withColumn("xy", xy).withColumn("size", size).drop(geom)


def _split(xy, sizes) -> list[np.ndarray]:
    points = np.asarray(xy, dtype=float).reshape(-1, 2)
    return np.split(points, np.cumsum(np.asarray(sizes, dtype=int))[:-1]) if len(sizes) else []


def _closed(ring: np.ndarray) -> np.ndarray:
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])


def _clip_ring(ring: np.ndarray, box) -> np.ndarray:
    """Part of a ring inside a box, one half-plane at a time; bridges left by concave rings have no area."""
    points = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    xmin, ymin, xmax, ymax = box
    for axis, limit, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
        if len(points) == 0:
            break
        points = _half_plane(points, sign * (points[:, axis] - limit))
    return points


def _half_plane(points: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Open ring kept where ``side`` is not negative, with the crossing points added."""
    inside = side >= 0
    if inside.all():
        return points
    if not inside.any():
        return points[:0]
    following, after = np.roll(points, -1, axis=0), np.roll(side, -1)
    crossing = inside != np.roll(inside, -1)
    gap = np.where(crossing, side - after, 1.0)
    both = np.empty((2 * len(points), 2))
    both[0::2] = points
    both[1::2] = points + (following - points) * (side / gap)[:, None]
    keep = np.empty(2 * len(points), dtype=bool)
    keep[0::2], keep[1::2] = inside, crossing
    return both[keep]


def _segments(ring: np.ndarray) -> np.ndarray:
    r = _closed(ring)
    s = np.hstack([r[:-1], r[1:]])
    return s[(s[:, :2] != s[:, 2:]).any(axis=1)]


def _cross(o, a, b):
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def _edges_meet(s: np.ndarray, t: np.ndarray, proper: bool) -> np.ndarray:
    """Matrix: does segment i of ``s`` meet segment j of ``t``? ``proper`` asks for interior crossings only. Leading axes are rings side by side."""
    a, b = s[..., :, None, :2], s[..., :, None, 2:]
    c, d = t[..., None, :, :2], t[..., None, :, 2:]
    d1, d2, d3, d4 = _cross(c, d, a), _cross(c, d, b), _cross(a, b, c), _cross(a, b, d)
    crossing = (d1 * d2 < 0) & (d3 * d4 < 0)
    if proper:
        return crossing

    def on(p, q, r, area):
        within = (np.minimum(p, q) <= r).all(-1) & (r <= np.maximum(p, q)).all(-1)
        return (area == 0) & within

    return crossing | on(c, d, a, d1) | on(c, d, b, d2) | on(a, b, c, d3) | on(a, b, d, d4)


def _inside(x: float, y: float, rings: list[np.ndarray]) -> bool:
    """Even-odd test over all rings, so holes count."""
    odd = False
    for ring in rings:
        s = _segments(ring)
        straddle = (s[:, 1] > y) != (s[:, 3] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = s[:, 0] + (y - s[:, 1]) * (s[:, 2] - s[:, 0]) / (s[:, 3] - s[:, 1])
        odd ^= bool(np.count_nonzero(straddle & (x < at)) % 2)
    return odd


def _equal_area(ring: np.ndarray) -> np.ndarray:
    s = np.sin(np.radians(ring[:, 1]))
    q = (1 - geo.E2) * (s / (1 - geo.E2 * s * s) - np.log((1 - geo.ECC * s) / (1 + geo.ECC * s)) / (2 * geo.ECC))
    return np.column_stack([np.radians(ring[:, 0]) * geo.A, q * geo.A / 2])


def _ring_area(ring: np.ndarray, planar: bool) -> float:
    if len(ring) < 3:
        return 0.0
    p = ring if planar else _equal_area(ring)
    p = p - p[0]
    return abs(float(np.dot(p[:-1, 0], p[1:, 1]) - np.dot(p[1:, 0], p[:-1, 1]))) / 2


# --- predicates ---------------------------------------------------------------------------


def _ring_crosses(ring: np.ndarray) -> bool:
    """Do two edges that are not neighbours meet?"""
    s = _segments(ring)
    n = len(s)
    if n < 4:
        return False
    for i, j in near_edges(s):
        gap = j[None, :] - i[:, None]
        apart = (gap >= 2) & (gap < n - 1)
        if apart.any() and (apart & _edges_meet(s[i], s[j], proper=False)).any():
            return True
    return False


def _by_length(rings: list[np.ndarray], limit: int):
    """(indices, stacked rings) of rings with equally many positions, in blocks of bounded size; longer ones than ``limit`` are left out."""
    lengths = np.array([len(r) for r in rings], dtype=int)
    for n in np.unique(lengths[(lengths > 0) & (lengths <= limit)]):
        which = np.flatnonzero(lengths == n)
        step = max(1, _BLOCK // int(n) ** 2)
        for at in range(0, len(which), step):
            own = which[at:at + step]
            yield own, np.stack([rings[i] for i in own])


#: Pairs of edges in one block of rings, and positions of a ring that is tested in a block.
_BLOCK, _SHORT = 1 << 18, 32


def _rings_crossing(rings: list[np.ndarray]) -> np.ndarray:
    """``_ring_crosses`` of many rings: short closed ones without empty edges side by side, the others one by one."""
    told, done = np.zeros(len(rings), dtype=bool), np.zeros(len(rings), dtype=bool)
    for which, r in _by_length(rings, _SHORT):
        plain = (r[:, 0] == r[:, -1]).all(axis=1) & (r[:, 1:] != r[:, :-1]).any(axis=2).all(axis=1)
        which, r = which[plain], r[plain]
        done[which] = True
        n = r.shape[1] - 1
        if n < 4 or not len(which):
            continue
        edges = np.concatenate([r[:, :-1], r[:, 1:]], axis=2)
        gap = np.arange(n)[None, :] - np.arange(n)[:, None]
        told[which] = (((gap >= 2) & (gap < n - 1)) & _edges_meet(edges, edges, proper=False)).any(axis=(1, 2))
    for i in np.flatnonzero(~done):
        told[i] = _ring_crosses(rings[i])
    return told


def _any_meet(s: np.ndarray, t: np.ndarray) -> bool:
    return any(_edges_meet(s[i], t[j], proper=False).any() for i, j in near_edges(s, t))


@pandas_udf(T.BooleanType())
def _self_intersects(xy: pd.Series, sizes: pd.Series) -> pd.Series:
    rows = [[] if p is None else _split(p, n) for p, n in zip(xy, sizes)]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    crossing = np.zeros(len(rows), dtype=bool)
    crossing[owner[_rings_crossing([r for rings in rows for r in rings])]] = True
    return pd.Series(crossing, dtype=bool)


def _rings_cross(rings: Column) -> Column:
    return _self_intersects(*_flat(rings))


def self_intersects(geom) -> Column:
    g = F.col(geom) if isinstance(geom, str) else geom
    return _rings_cross(g["rings"])


@pandas_udf(T.BooleanType())
def _intersects(a: pd.Series, na: pd.Series, ka: pd.Series, b: pd.Series, nb: pd.Series, kb: pd.Series) -> pd.Series:
    def edges(rings, areal):
        return np.vstack([_segments(x) if areal else np.hstack([x[:-1], x[1:]]) if len(x) > 1 else np.hstack([x, x]) for x in rings])

    def test(xy_l, n_l, kind_l, xy_r, n_r, kind_r) -> bool:
        if xy_l is None:
            return True
        left, right = _split(xy_l, n_l), _split(xy_r, n_r)
        areal_l, areal_r = kind_l.endswith("Polygon"), kind_r.endswith("Polygon")
        if _any_meet(edges(left, areal_l), edges(right, areal_r)):
            return True
        # no edges meet: one lies within the other, or they are apart
        if areal_r and any(_inside(*x[0], right) for x in left):
            return True
        return bool(areal_l and any(_inside(*x[0], left) for x in right))

    return pd.Series([test(*row) for row in zip(a, na, ka, b, nb, kb)], dtype=bool)


def is_box(geom) -> Column:
    """A polygon that is its own bounding box."""
    g = F.col(geom) if isinstance(geom, str) else geom
    b = g["bbox"]
    ring = F.get(g["rings"], F.lit(0))
    corners = F.forall(ring, lambda p: p["x"].isin(b["xmin"], b["xmax"]) & p["y"].isin(b["ymin"], b["ymax"]))
    # four corners, each beside the next
    sides = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.get(ring, i)["x"] == F.get(ring, i + 1)["x"]) != (F.get(ring, i)["y"] == F.get(ring, i + 1)["y"]))
    distinct = F.size(F.array_distinct(F.slice(ring, 1, 4))) == 4
    return (g["type"] == "Polygon") & (F.size(g["rings"]) == 1) & (F.size(ring) == 5) & corners & distinct & sides


def intersects(a, b) -> Column:
    """Exact intersection of two geometries whose boxes meet (test that first, with ``geo.bbox_intersects``).

    Two boxes need no further test, so their vertices are not sent to Python.
    """
    left = F.col(a) if isinstance(a, str) else a
    right = F.col(b) if isinstance(b, str) else b
    open_question = ~(is_box(left) & is_box(right))
    (xy_l, n_l), (xy_r, n_r) = _flat(left["rings"]), _flat(right["rings"])
    sent = [F.when(open_question, c) for c in (xy_l, n_l, left["type"], xy_r, n_r, right["type"])]
    return _intersects(*sent)


# --- clipping -----------------------------------------------------------------------------


@pandas_udf(T.DoubleType())
def _clip_area(xy: pd.Series, sizes: pd.Series, hole: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    rings, owner, sign = [], [], []
    for row, (points, n, holes) in enumerate(zip(xy, sizes, hole)):
        for ring, is_hole in zip(_split(points, n), holes):
            rings.append(_closed(ring)[:-1])
            owner.append(row)
            sign.append(-1.0 if is_hole else 1.0)
    boxes = np.column_stack([x0, y0, x1, y1])
    total = np.zeros(len(boxes))
    for which, block in _by_length(rings, np.iinfo(np.int64).max):
        own = np.asarray(owner)[which]
        np.add.at(total, own, np.asarray(sign)[which] * _clipped_areas(block, boxes[own]))
    return pd.Series(np.maximum(0.0, total))


def _cut_side(points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """``_half_plane`` of many open rings of one length: (points, which are not empty, which positions are crossings).

    A ring that loses positions repeats its last one, which changes neither the outline nor the area.
    """
    inside = off >= 0
    if inside.all():
        return points, np.ones(len(points), dtype=bool), None
    following, after = np.roll(points, -1, axis=1), np.roll(off, -1, axis=1)
    crossing = inside != np.roll(inside, -1, axis=1)
    gap = np.where(crossing, off - after, 1.0)
    both = np.empty((len(points), 2 * points.shape[1], 2))
    both[:, 0::2] = points
    both[:, 1::2] = points + (following - points) * (off / gap)[:, :, None]
    keep = np.empty(both.shape[:2], dtype=bool)
    keep[:, 0::2], keep[:, 1::2] = inside, crossing
    counts = keep.sum(axis=1)
    # kept positions first, in order; then the last of them again
    order = np.argsort(~keep, axis=1, kind="stable")[:, :max(1, counts.max())]
    place = np.minimum(np.arange(order.shape[1])[None, :], np.maximum(counts - 1, 0)[:, None])
    at = np.take_along_axis(order, place, axis=1)
    return np.take_along_axis(both, at[:, :, None], axis=1), counts > 0, at % 2 == 1


def _clip_many(points: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_clip_ring`` of many open rings of one length, each with its own box, and which are not empty. Crossings lie on the border exactly."""
    alive = np.ones(len(points), dtype=bool)
    for axis, side, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        limit = boxes[:, side][:, None]
        points, some, crossed = _cut_side(points, sign * (points[:, :, axis] - limit))
        alive &= some
        if crossed is not None:
            points[:, :, axis] = np.where(crossed, limit, points[:, :, axis])
    return points, alive


def _areas(points: np.ndarray, planar: bool) -> np.ndarray:
    """``_ring_area`` of many open rings of one length."""
    flat = points if planar else _equal_area(points.reshape(-1, 2)).reshape(points.shape)
    flat = flat - flat[:, :1]
    x, y, u, w = flat[:, :, 0], flat[:, :, 1], np.roll(flat[:, :, 0], -1, axis=1), np.roll(flat[:, :, 1], -1, axis=1)
    return np.abs((x * w - u * y).sum(axis=1)) / 2


def _clipped_areas(points: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """``_clip_ring`` and its area for many open rings of one length, each with its own box."""
    points, alive = _clip_many(points, boxes)
    return np.where(alive, _areas(points, False), 0.0)


def _rings_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, positions a ring) of the closed rings of many open ones, without repeated positions."""
    fresh = (points != np.roll(points, -1, axis=1)).any(axis=2)
    counts = fresh.sum(axis=1)
    order = np.argsort(~fresh, axis=1, kind="stable")
    place = np.arange(points.shape[1] + 1)[None, :]
    at = np.take_along_axis(order, np.where(place < counts[:, None], np.minimum(place, points.shape[1] - 1), 0), axis=1)
    return np.take_along_axis(points, at[:, :, None], axis=1)[place <= counts[:, None]], counts + 1


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _flat_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
    """(all positions, first position of a row, positions of an open plain row or 0, flat values, ring sizes). A row is plain if it is one short ring
    of finite positions."""
    xy, size = batch.column("xy"), batch.column("size")
    lengths = xy.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    points = xy.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
    first = np.cumsum(lengths) - lengths
    rings = size.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    count = np.where((rings == 1) & (lengths >= 3) & (lengths <= _SHORT), lengths, 0)
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(points).all(axis=1))])
    count[broken[first + lengths] > broken[first]] = 0
    plain = np.flatnonzero(count)
    closed = (points[first[plain]] == points[first[plain] + count[plain] - 1]).all(axis=1)
    count[plain] -= closed
    return points, first, np.where(count >= 3, count, 0), xy, size


def with_clip_area(df: DataFrame, geom: str, box: str, name: str = "overlap_m2") -> DataFrame:
    """Add the area of the polygonal geometry ``geom`` inside the bbox struct ``box``."""
    g, b = F.col(geom), F.col(box)
    return df.withColumn(name, _clip_area(*_flat(g["rings"]), g["hole"], b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


# --- simplification -----------------------------------------------------------------------


def _simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    n = len(ring)
    keep = np.zeros(n, dtype=bool)
    # a closed ring is anchored at its first vertex and the vertex farthest from it
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    keep[[0, far, n - 1]] = True
    stack = [(0, far), (far, n - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, span = ring[i], ring[j] - ring[i]
        length = float(np.hypot(*span))
        rel = ring[i + 1 : j] - a
        gap = np.abs(rel[:, 0] * span[1] - rel[:, 1] * span[0]) / length if length else np.hypot(*rel.T)
        k = int(np.argmax(gap))
        if gap[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    result = ring[keep]
    return result if len(result) >= 4 else ring


def _kept_side_by_side(points: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of many closed rings ``_simplified`` keeps. A pass splits every open stretch of every ring that still moves."""
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    home = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(points))

    def farthest(value: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest value, its first position) of each stretch; stretches lie end to end."""
        most = np.maximum.reduceat(value, begins)
        at = np.where(value == np.repeat(most, lengths), np.arange(len(value)), len(value))
        return most, np.minimum.reduceat(at, begins)

    keep = np.zeros(len(points), dtype=bool)
    _, far = farthest(np.hypot(*(points - points[first[home]]).T), first, sizes)
    keep[first], keep[far], keep[last] = True, True, True
    moving = np.ones(len(sizes), dtype=bool)
    while moving.any():
        # vertices between two kept ones of rings that changed in the last pass
        left = np.maximum.accumulate(np.where(keep, place, 0))
        right = np.minimum.accumulate(np.where(keep, place, len(points))[::-1])[::-1]
        open_ = np.flatnonzero(~keep & moving[home])
        if not len(open_):
            break
        a, span = points[left[open_]], points[right[open_]] - points[left[open_]]
        length = np.hypot(*span.T)
        rel = points[open_] - a
        line = np.abs(rel[:, 0] * span[:, 1] - rel[:, 1] * span[:, 0])
        gap = np.where(length > 0, line / np.where(length > 0, length, 1.0), np.hypot(*rel.T))
        begins = np.flatnonzero(np.diff(left[open_], prepend=-1))
        most, at = farthest(gap, begins, np.diff(np.append(begins, len(gap))))
        split = open_[at[most > tolerance]]
        keep[split] = True
        moving = np.zeros(len(sizes), dtype=bool)
        moving[home[split]] = True
    few = np.add.reduceat(keep.astype(int), first) < 4
    return keep | few[home]


def _simplified_rows(xy: pa.Array, sizes: pa.Array, tolerance: float) -> pa.Array:
    """Thinned rings of every row as lists of positions. Short rings of finite positions are thinned side by side, others one by one."""
    counts = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    points = xy.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2)
    ends = np.cumsum(counts)
    begins = ends - counts
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(points).all(axis=1))])
    short = (counts > 0) & (counts <= _SHORT) & (broken[ends] == broken[begins])
    # a ring is closed by its first vertex where it is open
    closing = np.zeros(len(counts), dtype=bool)
    closing[short] = (points[begins[short]] != points[ends[short] - 1]).any(axis=1)
    lengths = np.where(short, counts + closing, 0)
    if short.any():
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ring = np.repeat(np.arange(len(counts)), lengths)
        closed = points[begins[ring] + np.where(step < counts[ring], step, 0)]
        keep = _kept_side_by_side(closed, lengths[short], tolerance)
        thin, kept = closed[keep], np.bincount(ring[keep], minlength=len(counts))
    else:
        thin, kept = points[:0], np.zeros(len(counts), dtype=np.int64)
    if not short.all():
        places = np.cumsum(kept) - kept
        parts = [thin[p : p + k] if s else _simplified(_closed(points[b:e]), tolerance) for s, p, k, b, e in zip(short, places, kept, begins, ends)]
        thin, kept = np.vstack(parts), np.array([len(p) for p in parts])
    positions = pa.StructArray.from_arrays([pa.array(thin[:, 0]), pa.array(thin[:, 1])], names=["x", "y"])
    offsets = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32), pa.int32())
    of_rows = pa.array(np.concatenate([[0], np.cumsum(sizes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32), pa.int32())
    return pa.ListArray.from_arrays(of_rows, pa.ListArray.from_arrays(offsets, positions), mask=sizes.is_null())


def simplify(df: DataFrame, tolerance: float, geom: str = "geometry") -> DataFrame:
    """Douglas-Peucker per ring; a ring that would fall below four positions stays as it is."""

    @arrow_udf(geo.RINGS_TYPE)
    def run(xy: pa.Array, sizes: pa.Array) -> pa.Array:
        return _simplified_rows(xy, sizes, tolerance)

    g = F.col(geom)
    thinned = spread(df).withColumn("__rings", run(*_flat(g["rings"])))
    return thinned.withColumn(geom, geo.geometry(g["type"], F.col("__rings"), g["part"], g["hole"])).drop("__rings")


# --- union --------------------------------------------------------------------------------


def _cuts(edges: np.ndarray) -> np.ndarray:
    """All x positions where the order of edges may change: end points and crossings."""
    xs = [edges[:, 0], edges[:, 2]]
    for i, j in near_edges(edges):
        a, c = edges[i][:, None, :], edges[j][None, :, :]
        r, s, w = a[..., 2:] - a[..., :2], c[..., 2:] - c[..., :2], c[..., :2] - a[..., :2]
        den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
        apart = (den == 0) | (j[None, :] <= i[:, None])
        safe = np.where(apart, 1.0, den)
        t = (w[..., 0] * s[..., 1] - w[..., 1] * s[..., 0]) / safe
        u = (w[..., 0] * r[..., 1] - w[..., 1] * r[..., 0]) / safe
        hit = ~apart & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        xs.append((a[..., 0] + t * r[..., 0])[hit])
    return np.unique(np.concatenate(xs))


def _convex(ring: np.ndarray) -> np.ndarray | None:
    """The ring counter-clockwise if it is convex, else None."""
    p = ring[:-1]
    if len(p) < 3:
        return None
    turn = _cross(p, np.roll(p, -1, axis=0), np.roll(p, -2, axis=0))
    # one turn around, so that a star is not taken for convex
    x = np.sign(np.roll(p[:, 0], -1) - p[:, 0])
    x = x[x != 0]
    if np.count_nonzero(x != np.roll(x, -1)) > 2:
        return None
    if (turn >= 0).all():
        return ring
    return ring[::-1] if (turn <= 0).all() else None


def union_trapezoids(polygons: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Disjoint convex pieces that cover exactly the union of polygons (each a list of rings, even-odd).

    Vertical slabs are cut wherever edges end or cross; inside a slab the edges are ordered, so a running
    count per polygon tells which strips are covered. A single convex ring is its own piece.
    """
    if len(polygons) == 1 and len(polygons[0]) == 1:
        whole = _convex(_closed(polygons[0][0]))
        if whole is not None:
            return [whole]
    edges, owner = [], []
    for index, rings in enumerate(polygons):
        for ring in rings:
            s = _segments(ring)
            s = s[s[:, 0] != s[:, 2]]
            flip = s[:, 0] > s[:, 2]
            s[flip] = s[flip][:, [2, 3, 0, 1]]
            edges.append(s)
            owner.append(np.full(len(s), index))
    e = np.vstack(edges) if edges else np.empty((0, 4))
    if len(e) == 0:
        return []
    own = np.concatenate(owner)
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    result = []
    cuts = _cuts(e)
    # The status of the sweep: edges that began and have not ended.
    begin = np.argsort(e[:, 0], kind="stable")
    until = np.searchsorted(e[begin, 0], cuts, side="right")
    status = np.empty(0, dtype=np.int64)
    at = 0
    for k, (x0, x1) in enumerate(zip(cuts[:-1], cuts[1:])):
        mid = (x0 + x1) / 2
        status = np.concatenate([status[e[status, 2] > x0], begin[at:until[k]]])
        at = until[k]
        active = status[(e[status, 0] <= mid) & (e[status, 2] >= mid)]
        if len(active) == 0:
            continue
        active = np.sort(active)
        y_mid = e[active, 1] + (mid - e[active, 0]) * slope[active]
        inside: set[int] = set()
        start = None
        for k in active[np.argsort(y_mid, kind="stable")]:
            before = bool(inside)
            inside ^= {int(own[k])}
            if not before and inside:
                start = k
            elif before and not inside:
                low = [e[start, 1] + (x - e[start, 0]) * slope[start] for x in (x0, x1)]
                high = [e[k, 1] + (x - e[k, 0]) * slope[k] for x in (x0, x1)]
                # Strips as thin as the rounding of their corners are no area.
                if max(high[0] - low[0], high[1] - low[1]) > 8 * np.spacing(max(map(abs, (*low, *high)))) and x1 - x0 > 8 * np.spacing(max(abs(x0), abs(x1))):
                    result.append(np.array([(x0, low[0]), (x1, low[1]), (x1, high[1]), (x0, high[0]), (x0, low[0])]))
    return result


#: Pairs of a ring and a bucket that are cut at a time.
_PAIRS = 1 << 15


def _cutter(keys: list[str], size: float, origin: tuple[float, float], planar: bool, share: float):
    ox, oy = origin

    def cells(rings: list[np.ndarray]):
        every = np.concatenate(rings)
        low, high = every.min(axis=0), every.max(axis=0)
        for bx in range(int(np.floor((low[0] - ox) / size)), int(np.floor((high[0] - ox) / size)) + 1):
            left, right = bx * size + ox, (bx + 1) * size + ox
            # one column first, so that a long ring is not cut once per cell
            strip = [_clip_ring(r, (left, -np.inf, right, np.inf)) for r in rings]
            strip = [_closed(r) for r in strip if len(r) >= 3]
            if not strip:
                continue
            ys = np.concatenate(strip)[:, 1]
            for by in range(int(np.floor((ys.min() - oy) / size)), int(np.floor((ys.max() - oy) / size)) + 1):
                box = (left, by * size + oy, right, (by + 1) * size + oy)
                kept = [_clip_ring(r, box) for r in strip]
                kept = [_closed(r) for r in kept if len(r) >= 3]
                # ring areas cancel out for holes: the outer ring of a polygon comes first
                areas = [_ring_area(r, planar) for r in kept]
                if areas and max(areas) > 0:
                    whole = (box[2] - box[0]) * (box[3] - box[1]) if planar else _ring_area(_box(box), False)
                    filled = len(kept) == 1 and abs(areas[0] - whole) <= whole * share
                    yield bx, by, np.concatenate(kept).ravel(), [len(r) for r in kept], filled

    def side_by_side(rows: np.ndarray, rings: np.ndarray):
        """Pieces of open rings of one length: (rows, bx, by, flat values, ring sizes, filled), a block of pairs at a time."""
        low = np.floor((rings.min(axis=1) - (ox, oy)) / size).astype(np.int64)
        wide = np.floor((rings.max(axis=1) - (ox, oy)) / size).astype(np.int64) - low + 1
        n = wide.prod(axis=1)
        ends = np.cumsum(n)
        for at in range(0, int(ends[-1]), _PAIRS):
            pair = np.arange(at, min(at + _PAIRS, int(ends[-1])))
            own = np.searchsorted(ends, pair, side="right")
            step = pair - (ends[own] - n[own])
            bx, by = low[own, 0] + step // wide[own, 1], low[own, 1] + step % wide[own, 1]
            boxes = np.column_stack([bx * size + ox, by * size + oy, (bx + 1) * size + ox, (by + 1) * size + oy])
            points, alive = _clip_many(rings[own], boxes)
            area = np.where(alive, _areas(points, planar), 0.0)
            some = np.flatnonzero(area > 0)
            if not len(some):
                continue
            b = boxes[some]
            corners = b[:, [0, 1, 2, 1, 2, 3, 0, 3]].reshape(-1, 4, 2)
            whole = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) if planar else _areas(corners, False)
            values, sizes = _rings_of(points[some])
            yield rows[own[some]], bx[some], by[some], values.ravel(), sizes, np.abs(area[some] - whole) <= whole * share

    def run(batches):
        for batch in batches:
            points, first, count, xy, size_ = _flat_rows(batch)

            def piece(rows, bx, by, values, lengths, sizes, rings, filled):
                return pa.RecordBatch.from_arrays([
                    *[batch.column(k).take(pa.array(rows, pa.int64())) for k in keys], pa.array(bx, pa.int64()), pa.array(by, pa.int64()),
                    _lists(values, lengths, pa.float64()), _lists(sizes, rings, pa.int32()), pa.array(filled, pa.bool_()),
                ], names=[*keys, "bx", "by", "xy", "size", "filled"])

            for n in np.unique(count[count > 0]):
                rows = np.flatnonzero(count == n)
                for own, bx, by, values, sizes, filled in side_by_side(rows, points[first[rows][:, None] + np.arange(n)]):
                    yield piece(own, bx, by, values, 2 * sizes, sizes, np.ones(len(own), dtype=int), filled)
            for row in np.flatnonzero(count == 0):
                found = list(cells(_split(xy[row].as_py(), size_[row].as_py())))
                if found:
                    bx, by, values, sizes, filled = zip(*found)
                    yield piece([row] * len(found), bx, by, np.concatenate(values), [len(v) for v in values], np.concatenate(sizes), [len(z) for z in sizes], filled)

    return run


def _box(box) -> np.ndarray:
    x0, y0, x1, y1 = box
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)])


def _fields(df: DataFrame, keys: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], *more])


def _cut(df: DataFrame, keys: list[str], size: float, origin: tuple[float, float], planar: bool, share: float = 1e-9) -> DataFrame:
    """(keys, bx, by, xy, size, filled): every flat polygon cut to each grid bucket it meets. ``share`` of a bucket may be lacking where it is filled."""
    return df.select(*keys, "xy", "size").mapInArrow(_cutter(keys, size, origin, planar, share), _fields(df, keys, *_PIECE.elementType.fields))


def _largest_span(df: DataFrame, bucket: float) -> float:
    """Most buckets that one polygon's box meets."""

    def along(offset: int) -> Column:
        axis = F.filter("xy", lambda _, i: i % 2 == offset)
        return F.array_max(axis) - F.array_min(axis)

    if "xy" in df.columns:
        wide = [along(0), along(1)]
        df = df.where(F.size("size") > 0)
    else:
        wide = [F.col(f"geometry.bbox.{a}max") - F.col(f"geometry.bbox.{a}min") for a in "xy"]
    x, y = (F.ceil(w / bucket) + 1 for w in wide)
    return df.agg(F.max(x * y)).first()[0] or 0


def bucket_pieces(df: DataFrame, keys: list[str], bucket: float, planar: bool = False,
                  origin: tuple[float, float] = (0.0, 0.0), fanout: int = 16) -> DataFrame:
    """Every polygon cut to each grid bucket it meets, exact copies dropped.

    When some outline meets very many buckets, all are cut to coarse buckets first and shuffled by them, so
    that a huge outline becomes many tasks; a coarse bucket that a piece fills is taken apart without cutting.
    ``filled`` tells that a piece covers its whole bucket.
    """
    far = _largest_span(df, bucket) > 16 * fanout**2
    flat = spread((df if "xy" in df.columns else flat_polygons(df.select(*keys, "geometry"))).select(*keys, "xy", "size"))
    inner = None
    if far:
        # a piece may lack as much of a coarse bucket as of a fine one
        coarse = materialize(_cut(flat, keys, bucket * fanout, origin, planar, 1e-9 / fanout**2))
        filled = coarse.where("filled").select(*keys, "bx", "by").distinct()

        def inside(c: str) -> Column:
            return F.explode(F.sequence(F.col(c) * fanout, F.col(c) * fanout + fanout - 1)).alias(c)

        squares = spread(filled).select(*keys, inside("bx"), "by").select(*keys, "bx", inside("by"))
        x0, y0, x1, y1 = (F.col(c) * bucket + o if not k else (F.col(c) + 1) * bucket + o for k in (0, 1) for c, o in (("bx", origin[0]), ("by", origin[1])))
        inner = squares.select(*keys, "bx", "by", F.array(x0, y0, x1, y0, x1, y1, x0, y1, x0, y0).alias("xy"), F.array(F.lit(5)).alias("size"), F.lit(True).alias("filled"))
        flat = coarse.where("not filled").repartition(*keys, "bx", "by").select(*keys, "xy", "size")
    fine = _cut(flat, keys, bucket, origin, planar).dropDuplicates([*keys, "bx", "by", "xy", "size"])
    # squares of a filled coarse bucket are no copies of each other, but may be of pieces beside them
    return fine if inner is None else fine.unionByName(inner)


def _unite_udf(planar: bool):
    @pandas_udf(_CONVEX)
    def run(xy: pd.Series, sizes: pd.Series, counts: pd.Series) -> pd.Series:
        def one(points, n, c):
            rings, polygons, at = _split(points, n), [], 0
            for k in c:
                polygons.append(rings[at : at + k])
                at += k
            pieces = ((t, _ring_area(t, planar)) for t in union_trapezoids(polygons))
            return [{"xy": t.ravel(), "area": a} for t, a in pieces if a > 0]

        return pd.Series([one(*row) for row in zip(xy, sizes, counts)])

    return run


def _united(df: DataFrame, group: list[str], planar: bool) -> DataFrame:
    """(group, xy, area_m2): convex pieces of each group's union."""
    gathered = df.groupBy(*group).agg(F.collect_list(F.struct("xy", "size")).alias("__polygons"))
    p = F.col("__polygons")
    convex = _unite_udf(planar)(F.flatten(p["xy"]), F.flatten(p["size"]), F.transform(p, lambda s: F.size(s["size"])))
    return _exploded(gathered.select(*group, convex.alias("__c")), group, "__c").select(
        *group, F.col("p.xy").alias("xy"), F.col("p.area").alias("area_m2")
    )


def _convex_many(points: np.ndarray) -> np.ndarray:
    """``_convex`` of many open rings of one length: 1 if counter-clockwise, -1 if clockwise, 0 if not convex."""
    turn = _cross(points, np.roll(points, -1, axis=1), np.roll(points, -2, axis=1))
    way = np.sign(np.roll(points[:, :, 0], -1, axis=1) - points[:, :, 0])
    last, changes = np.zeros(len(points)), np.zeros(len(points), dtype=int)
    for turns in (0, 1):
        # the first round finds the last way of each ring
        for i in range(way.shape[1]):
            moved = way[:, i] != 0
            if turns:
                changes += moved & (way[:, i] != last)
            last = np.where(moved, way[:, i], last)
    left, right = (turn >= 0).all(axis=1), (turn <= 0).all(axis=1)
    return np.where(changes > 2, 0, np.where(left, 1, np.where(right, -1, 0)))


def _alone(df: DataFrame, group: list[str], planar: bool) -> DataFrame:
    """As ``_united`` for groups of one polygon, which need not be gathered; short convex rings are told side by side."""

    def run(batches):
        for batch in batches:
            points, first, count, xy, size = _flat_rows(batch)

            def piece(rows, values, lengths, areas):
                return pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(pa.array(rows, pa.int64())) for k in group], _lists(values, lengths, pa.float64()), pa.array(areas, pa.float64())],
                    names=[*group, "xy", "area_m2"])

            open_ = count == 0
            for n in np.unique(count[count > 0]):
                rows = np.flatnonzero(count == n)
                rings = points[first[rows][:, None] + np.arange(n)]
                way = _convex_many(rings)
                open_[rows[way == 0]] = True
                closed = np.concatenate([rings, rings[:, :1]], axis=1)
                closed[way < 0] = closed[way < 0][:, ::-1]
                area = _areas(rings, planar)
                good = (way != 0) & (area > 0)
                if good.any():
                    yield piece(rows[good], closed[good].ravel(), np.full(good.sum(), 2 * n + 2), area[good])
            for row in np.flatnonzero(open_):
                pieces = [(t, _ring_area(t, planar)) for t in union_trapezoids([_split(xy[row].as_py(), size[row].as_py())])]
                pieces = [(t, a) for t, a in pieces if a > 0]
                if pieces:
                    yield piece([row] * len(pieces), np.concatenate([t.ravel() for t, _ in pieces]), [t.size for t, _ in pieces], [a for _, a in pieces])

    result = _fields(df, group, T.StructField("xy", _XY), T.StructField("area_m2", T.DoubleType()))
    return df.select(*group, "xy", "size").mapInArrow(run, result)


def _whole(df: DataFrame, group: list[str], size: float, origin: tuple[float, float], planar: bool, x: str, y: str) -> DataFrame:
    x0, y0 = F.col(x) * size + origin[0], F.col(y) * size + origin[1]
    x1, y1 = (F.col(x) + 1) * size + origin[0], (F.col(y) + 1) * size + origin[1]
    area = (x1 - x0) * (y1 - y0) if planar else geo.box_area_m2(x0, y0, x1, y1)
    return df.select(*group, F.array(x0, y0, x1, y0, x1, y1, x0, y1, x0, y0).alias("xy"), area.alias("area_m2"))


def dissolve(df: DataFrame, keys: list[str], bucket: float = 0.01, crowd: int = 4000, planar: bool = False,
             origin: tuple[float, float] = (0.0, 0.0), split: int = 4, levels: int = 12) -> DataFrame:
    """Union of polygons per key as disjoint convex pieces: (keys, bx, by, xy, area_m2), rings counter-clockwise.

    Work is split by grid bucket: every polygon is cut to the buckets it meets, exact copies are dropped, and a
    bucket that some piece fills is taken as a whole, without its other pieces. Buckets that still hold more
    than ``crowd`` vertices are cut into ``split`` x ``split`` smaller ones, on a stored level of their own, until none does; so no task
    gathers a crowded place, however many outlines meet there. Only outlines through one point can end at the last level. ``planar``
    measures in the units of the coordinates.
    """
    group = [*keys, "bx", "by"]
    columns = [*group, "xy", "area_m2"]
    rows = bucket_pieces(df, keys, bucket, planar, origin).select(
        *keys, F.col("bx").alias("__gx"), F.col("by").alias("__gy"), "bx", "by", "xy", "size", "filled")
    held = [*keys, "__gx", "__gy"]
    inner = [*held, "bx", "by"]
    home = [*keys, F.col("__gx").alias("bx"), F.col("__gy").alias("by"), "xy", "area_m2"]
    result, size = None, bucket
    for level in range(levels):
        # the pieces of a level are read several times, so they are cut once
        rows = materialize(rows)
        counts = rows.groupBy(*inner).agg(F.sum(F.size("xy") / 2).alias("__n"), F.bool_or("filled").alias("__full"), F.count(F.lit(1)).alias("__k"))
        last = level == levels - 1
        whole = _whole(counts.where("__full"), inner, size, origin, planar, "bx", "by")
        busy = counts.where(~F.col("__full")).select(*inner, (F.lit(not last) & (F.col("__n") > crowd)).alias("__crowded"), "__k")
        # Both sides are dealt out: squares that were made of one coarse bucket count as little as it to Spark, which would broadcast them all.
        told = rows.where("not filled").join(busy.hint("merge"), inner)
        calm = _united(told.where("not __crowded and __k > 1"), inner, planar)
        alone = _alone(told.where("not __crowded and __k = 1"), inner, planar)
        part = whole.select(*home).unionByName(calm.select(*home)).unionByName(alone.select(*home))
        result = part if result is None else result.unionByName(part)
        crowded = told.where("__crowded").select(*held, "xy", "size")
        # one row tells whether another level is needed
        if last or not busy.where("__crowded").limit(1).count():
            break
        size /= split
        rows = _cut(crowded.repartition(*held, F.xxhash64("xy")), held, size, origin, planar).dropDuplicates([*inner, "xy", "size"])
    return result.select(*columns)


def union_area(df: DataFrame, keys: list[str], bucket: float = 0.01) -> DataFrame:
    """Area of the union of polygons per key, in m2."""
    return dissolve(df, keys, bucket).groupBy(*keys).agg(F.sum("area_m2").alias("union_area_m2"))


@pandas_udf(_PART)
def _parts(kind: pd.Series, xy: pd.Series, sizes: pd.Series, part: pd.Series) -> pd.Series:
    rows = []
    for k, points, n, numbers in zip(kind, xy, sizes, part):
        by_part: dict[int, list[np.ndarray]] = {}
        for ring, number in zip(_split(points, n), numbers) if k in ("Polygon", "MultiPolygon") else ():
            if len(ring) >= 3:
                by_part.setdefault(int(number), []).append(_closed(ring))
        rows.append(by_part)
    crossing = iter(_rings_crossing([r for by_part in rows for rings in by_part.values() for r in rings]).tolist())

    def one(by_part):
        result = []
        for rings in by_part.values():
            # every ring takes its own answer
            crosses = any([next(crossing) for _ in rings])
            for p in ([[t] for t in union_trapezoids([rings])] if crosses else [rings]):
                if _ring_area(p[0], False) > 0:
                    result.append({"xy": np.concatenate(p).ravel(), "size": [len(r) for r in p]})
        return result

    return pd.Series([one(by_part) for by_part in rows])


def polygonal_parts(df: DataFrame, geom: str = "geometry") -> DataFrame:
    """One row per polygon with positive area, in flat form: parts split, rings closed, crossing rings repaired.

    A crossing ring is rebuilt from the even-odd convex pieces it encloses, each of which is a polygon.
    """
    g = F.col(geom)
    others = [c for c in df.columns if c != geom]
    xy, size = _flat(g["rings"])
    found = spread(df).withColumn("__p", _parts(g["type"], xy, size, g["part"]))
    return _exploded(found, others, "__p").select(*others, "p.xy", "p.size")


# --- general clipping to a boundary --------------------------------------------------------


@pandas_udf(T.StructType([T.StructField("xy", _XY), T.StructField("area", T.DoubleType())]))
def _meet(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Rings cut by counter-clockwise convex rings, those of equal lengths side by side, and their areas."""
    def opened(p):
        return _closed(np.asarray(p, dtype=float).reshape(-1, 2))[:-1]

    left, right = [opened(p) for p in a], [opened(q) for q in b]
    pieces, areas = [np.empty(0)] * len(left), np.zeros(len(left))
    lengths = np.array([(len(p), len(q)) for p, q in zip(left, right)], dtype=int).reshape(-1, 2)
    for n, m in np.unique(lengths[(lengths > 0).all(axis=1)], axis=0):
        which = np.flatnonzero((lengths == (n, m)).all(axis=1))
        points, window = np.stack([left[i] for i in which]), np.stack([right[i] for i in which])
        alive = np.ones(len(which), dtype=bool)
        for i in range(m):
            c, d = window[:, i, None], window[:, (i + 1) % m, None]
            side = (d[..., 0] - c[..., 0]) * (points[:, :, 1] - c[..., 1]) - (d[..., 1] - c[..., 1]) * (points[:, :, 0] - c[..., 0])
            points, some, _ = _cut_side(points, side)
            alive &= some
        values, sizes = _rings_of(points)
        area = np.where(alive & (sizes > 3), _areas(points, False), 0.0)
        for i, ring, own in zip(which, np.split(values, np.cumsum(sizes)[:-1]), area):
            if own > 0:
                pieces[i], areas[i] = ring.ravel(), own
    return pd.DataFrame({"xy": pieces, "area": areas})


def clip_to_boundary(df: DataFrame, boundary: DataFrame, keys: list[str], bucket: float = 0.01) -> DataFrame:
    """Pieces of each key's polygons inside the boundary: (keys, bx, by, xy, area_m2).

    Both sides are decomposed by grid bucket into disjoint convex pieces and met bucket by bucket, so the
    boundary is never shipped whole to every task.
    """
    mine = dissolve(df, keys, bucket)
    frame = dissolve(boundary.select(F.lit(1).alias("__b"), "geometry"), ["__b"], bucket).select("bx", "by", F.col("xy").alias("__frame"))
    met = mine.join(frame, ["bx", "by"]).withColumn("__m", _meet("xy", "__frame")).where(F.col("__m.area") > 0)
    return met.select(*keys, "bx", "by", F.col("__m.xy").alias("xy"), F.col("__m.area").alias("area_m2"))
