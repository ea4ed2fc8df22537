"""Geometry as a struct column, with measures as native expressions.

A geometry is ``struct<type, rings, part, hole, bbox>``: every point list is a ring, ``part`` numbers
the polygon or line it belongs to and ``hole`` marks inner rings. ``bbox`` is stored so that joins
prune by grid bucket without touching the vertices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"
BBOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
GEOMETRY = f"struct<type:string,rings:{RINGS},part:array<int>,hole:array<boolean>,bbox:{BBOX}>"

RING_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
RINGS_TYPE = T.ArrayType(RING_TYPE)

# WGS84 ellipsoid
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(E2)
METRES_PER_DEGREE = 111320.0


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


# --- construction -------------------------------------------------------------------------


def ring_bounds(rings: Column) -> Column:
    xs = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    return F.struct(
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )


def geometry(kind, rings: Column, part: Column, hole: Column) -> Column:
    return F.struct(
        _col(kind).alias("type"), rings.alias("rings"), part.alias("part"), hole.alias("hole"),
        ring_bounds(rings).alias("bbox"),
    )


def box_ring(xmin, ymin, xmax, ymax) -> Column:
    x0, y0, x1, y1 = map(_col, (xmin, ymin, xmax, ymax))

    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))


def box(xmin, ymin, xmax, ymax) -> Column:
    return F.struct(
        F.lit("Polygon").alias("type"),
        F.array(box_ring(xmin, ymin, xmax, ymax)).alias("rings"),
        F.array(F.lit(0)).alias("part"),
        F.array(F.lit(False)).alias("hole"),
        F.struct(
            _col(xmin).alias("xmin"), _col(ymin).alias("ymin"), _col(xmax).alias("xmax"), _col(ymax).alias("ymax")
        ).alias("bbox"),
    )


def point(x, y) -> Column:
    return geometry(
        F.lit("Point"), F.array(F.array(F.struct(_col(x).alias("x"), _col(y).alias("y")))), F.array(F.lit(0)),
        F.array(F.lit(False)),
    )


def line(*coordinates) -> Column:
    """A line from ``(x, y)`` column pairs."""
    vertices = F.array(*[F.struct(_col(x).alias("x"), _col(y).alias("y")) for x, y in coordinates])
    return geometry(F.lit("LineString"), F.array(vertices), F.array(F.lit(0)), F.array(F.lit(False)))


def from_geojson(kind, coordinates) -> Column:
    """Geometry from a GeoJSON type and its coordinates as JSON text; null for other types.

    Each nesting depth has its own ``from_json`` schema, so no Python code runs.
    """
    k, text = _col(kind), _col(coordinates)

    def parsed(depth: int) -> Column:
        return F.from_json(text, "array<" * depth + "double" + ">" * depth)

    def vertex(c: Column) -> Column:
        return F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))

    def ring(r: Column) -> Column:
        return F.transform(r, vertex)

    def no_holes(items: Column) -> Column:
        return F.transform(items, lambda _: F.lit(False))

    def numbered(items: Column) -> Column:
        return F.transform(items, lambda _, i: i)

    one, two, three, four = (parsed(d) for d in (1, 2, 3, 4))
    points = F.transform(two, lambda c: F.array(vertex(c)))
    lines = F.transform(three, ring)
    shells = F.flatten(F.transform(four, lambda polygon: F.transform(polygon, ring)))
    return (
        F.when(k == "Point", geometry(k, F.array(F.array(vertex(one))), F.array(F.lit(0)), F.array(F.lit(False))))
        .when(k == "MultiPoint", geometry(k, points, numbered(points), no_holes(points)))
        .when(k == "LineString", geometry(k, F.array(ring(two)), F.array(F.lit(0)), F.array(F.lit(False))))
        .when(k == "MultiLineString", geometry(k, lines, numbered(lines), no_holes(lines)))
        .when(
            k == "Polygon",
            geometry(k, lines, F.transform(lines, lambda _: F.lit(0)), F.transform(lines, lambda _, i: i > 0)),
        )
        .when(
            k == "MultiPolygon",
            geometry(
                k,
                shells,
                F.flatten(F.transform(four, lambda polygon, i: F.transform(polygon, lambda _: i))),
                F.flatten(F.transform(four, lambda polygon: F.transform(polygon, lambda _, j: j > 0))),
            ),
        )
    )


def as_multi(geom) -> Column:
    g = _col(geom)
    return F.struct(
        F.when(g["type"] == "Polygon", "MultiPolygon").otherwise(g["type"]).alias("type"),
        g["rings"].alias("rings"), g["part"].alias("part"), g["hole"].alias("hole"), g["bbox"].alias("bbox"),
    )


def bounds(geom) -> Column:
    return _col(geom)["bbox"]


# --- area ---------------------------------------------------------------------------------


def authalic_y(latitude) -> Column:
    """Northing of the cylindrical equal-area projection of the ellipsoid, in metres."""
    s = F.sin(F.radians(_col(latitude)))
    q = (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))
    return q * (A / 2)


def equal_area_x(longitude) -> Column:
    return F.radians(_col(longitude)) * A


def box_area_m2(xmin, ymin, xmax, ymax) -> Column:
    """Ellipsoidal area of a longitude/latitude box."""
    return (equal_area_x(xmax) - equal_area_x(xmin)) * (authalic_y(ymax) - authalic_y(ymin))


def _ring_sum(ring: Column, term) -> Column:
    """Sum of ``term(previous, current)`` over the closed ring."""
    n = F.size(ring)
    pairs = F.transform(
        ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, F.when(i + 1 < n, i + 1).otherwise(F.lit(0))).alias("b"))
    )
    return F.aggregate(pairs, F.lit(0.0), lambda acc, s: acc + term(s["a"], s["b"]))


def _projected(ring: Column) -> Column:
    """Ring in equal-area metres relative to its first vertex, which keeps the shoelace well conditioned."""
    first = F.get(ring, F.lit(0))
    x0, y0 = equal_area_x(first["x"]), authalic_y(first["y"])
    return F.transform(
        ring, lambda p: F.struct((equal_area_x(p["x"]) - x0).alias("x"), (authalic_y(p["y"]) - y0).alias("y"))
    )


def _shoelace(ring: Column) -> Column:
    return _ring_sum(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area_m2(geom) -> Column:
    """Geodesic area: shells minus holes."""
    g = _col(geom)
    signed = F.zip_with(
        g["rings"],
        g["hole"],
        lambda r, h: F.when(h, -F.abs(_shoelace(_projected(r)))).otherwise(F.abs(_shoelace(_projected(r)))),
    )
    return F.aggregate(signed, F.lit(0.0), lambda acc, x: acc + x)


def planar_area(geom) -> Column:
    """Area in squared coordinate units, for projected geometries: shells minus holes."""
    g = _col(geom)

    def local(ring: Column) -> Column:
        o = F.get(ring, F.lit(0))
        return F.transform(ring, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))

    signed = F.zip_with(
        g["rings"],
        g["hole"],
        lambda r, h: F.when(h, -F.abs(_shoelace(local(r)))).otherwise(F.abs(_shoelace(local(r)))),
    )
    return F.aggregate(signed, F.lit(0.0), lambda acc, x: acc + x)


def planar_ring_area(ring: Column) -> Column:
    """Area of one ring in squared coordinate units."""
    o = F.get(ring, F.lit(0))
    return F.abs(_ring_sum(ring, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"]))) / 2


def map_vertices(geom, change) -> Column:
    """Geometry with every vertex replaced by ``change(x, y)``, a struct(x, y) column."""
    g = _col(geom)
    rings = F.transform(g["rings"], lambda r: F.transform(r, lambda p: change(p["x"], p["y"])))
    return geometry(g["type"], rings, g["part"], g["hole"])


def area_km2(geom) -> Column:
    return area_m2(geom) / 1e6


# --- centroids ----------------------------------------------------------------------------


def _ring_moments(ring: Column, hole: Column) -> Column:
    """Signed area and first moments, relative to the ring's first vertex."""
    o = F.get(ring, F.lit(0))

    def cross(a, b):
        return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])

    twice = _ring_sum(ring, cross)
    mx = _ring_sum(ring, lambda a, b: (a["x"] + b["x"] - 2 * o["x"]) * cross(a, b)) / 6
    my = _ring_sum(ring, lambda a, b: (a["y"] + b["y"] - 2 * o["y"]) * cross(a, b)) / 6
    sign = F.when(twice < 0, -1.0).otherwise(1.0) * F.when(hole, -1.0).otherwise(1.0)
    area = sign * twice / 2
    return F.struct(
        area.alias("area"), (sign * mx + area * o["x"]).alias("mx"), (sign * my + area * o["y"]).alias("my")
    )


def centroid(geom) -> Column:
    """Area-weighted centroid of a polygonal geometry, in degrees."""
    g = _col(geom)
    moments = F.zip_with(g["rings"], g["hole"], _ring_moments)
    total = F.aggregate(
        moments,
        F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my")),
        lambda acc, m: F.struct(
            (acc["area"] + m["area"]).alias("area"), (acc["mx"] + m["mx"]).alias("mx"), (acc["my"] + m["my"]).alias("my")
        ),
        lambda acc: F.struct(
            F.try_divide(acc["mx"], acc["area"]).alias("x"), F.try_divide(acc["my"], acc["area"]).alias("y")
        ),
    )
    return total


def vertex_centroid(geom) -> Column:
    """Mean of the vertices of the first ring, as stored (a closing vertex counts)."""
    ring = F.get(_col(geom)["rings"], F.lit(0))
    n = F.size(ring)

    def mean(axis):
        return F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[axis]) / n

    return F.when(n > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


# --- distances ----------------------------------------------------------------------------


def distance_m(lat1, lng1, lat2, lng2) -> Column:
    """Local equirectangular distance."""
    a, b, c, d = map(_col, (lat1, lng1, lat2, lng2))
    north = (c - a) * METRES_PER_DEGREE
    east = (d - b) * METRES_PER_DEGREE * F.cos((a + c) * math.pi / 360)
    return F.hypot(north, east)


def metres_per_degree_lat(latitude) -> Column:
    s = F.sin(F.radians(_col(latitude)))
    return A * (1 - E2) / F.pow(1 - E2 * s * s, 1.5) * (math.pi / 180)


def metres_per_degree_lng(latitude) -> Column:
    s = F.sin(F.radians(_col(latitude)))
    return A * F.cos(F.radians(_col(latitude))) / F.sqrt(1 - E2 * s * s) * (math.pi / 180)


def _segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / length2))
    )
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def segment_distance_deg(x, y, x1, y1, x2, y2) -> Column:
    """Point to segment in plain degrees."""
    return _segment_distance(*map(_col, (x, y, x1, y1, x2, y2)))


def segment_distance_m(x, y, x1, y1, x2, y2) -> Column:
    """Point to segment in metres, in the ellipsoid's tangent plane at the point."""
    px, py, ax, ay, bx, by = map(_col, (x, y, x1, y1, x2, y2))
    kx, ky = metres_per_degree_lng(py), metres_per_degree_lat(py)
    zero = F.lit(0.0)
    return _segment_distance(zero, zero, (ax - px) * kx, (ay - py) * ky, (bx - px) * kx, (by - py) * ky)


def _line_distance(x, y, geom, metric) -> Column:
    g = _col(geom)

    def per_line(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(
            ring,
            lambda p, i: metric(
                x, y, p["x"], p["y"],
                F.coalesce(F.get(ring, i + 1)["x"], p["x"]), F.coalesce(F.get(ring, i + 1)["y"], p["y"]),
            ),
        )

    return F.array_min(F.flatten(F.transform(g["rings"], per_line)))


def distance_point_line(x, y, geom) -> Column:
    """Metres from a point to the nearest part of a line geometry."""
    return _line_distance(_col(x), _col(y), geom, segment_distance_m)


def distance_point_line_deg(x, y, geom) -> Column:
    return _line_distance(_col(x), _col(y), geom, segment_distance_deg)


def line_length_m(geom) -> Column:
    def per_line(ring):
        return F.aggregate(
            F.transform(
                ring,
                lambda p, i: F.coalesce(distance_m(p["y"], p["x"], F.get(ring, i + 1)["y"], F.get(ring, i + 1)["x"]), F.lit(0.0)),
            ),
            F.lit(0.0),
            lambda acc, d: acc + d,
        )

    return F.aggregate(F.transform(_col(geom)["rings"], per_line), F.lit(0.0), lambda acc, d: acc + d)


# --- transverse Mercator (Krueger series, third order in n) -------------------------------

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
]
_DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
]
SCALE = 0.9996
FALSE_EASTING = 500000.0


def central_meridian(zone: int) -> float:
    return zone * 6 - 183.0


def to_utm(longitude, latitude, zone: int = 46) -> Column:
    """struct(x, y): UTM easting and northing (northern hemisphere) in metres."""
    phi, lam = F.radians(_col(latitude)), F.radians(_col(longitude) - central_meridian(zone))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct(
        (FALSE_EASTING + SCALE * _RADIUS * x).alias("x"), (SCALE * _RADIUS * y).alias("y")
    )


def from_utm(easting, northing, zone: int = 46) -> Column:
    """struct(x, y): longitude and latitude in degrees."""
    xi0, eta0 = _col(northing) / (SCALE * _RADIUS), (_col(easting) - FALSE_EASTING) / (SCALE * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, start=1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct(
        (central_meridian(zone) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))).alias("x"), F.degrees(phi).alias("y")
    )


# --- predicates and buckets ---------------------------------------------------------------


def bbox_intersects(a, b) -> Column:
    """Closed overlap test of two bbox structs."""
    l, r = _col(a), _col(b)
    return (
        (l["xmin"] <= r["xmax"]) & (l["xmax"] >= r["xmin"]) & (l["ymin"] <= r["ymax"]) & (l["ymax"] >= r["ymin"])
    )


def bbox_overlap_m2(a, b) -> Column:
    """Ellipsoidal area shared by two boxes, zero when they only touch."""
    l, r = _col(a), _col(b)
    x0, x1 = F.greatest(l["xmin"], r["xmin"]), F.least(l["xmax"], r["xmax"])
    y0, y1 = F.greatest(l["ymin"], r["ymin"]), F.least(l["ymax"], r["ymax"])
    return F.when((x1 > x0) & (y1 > y0), box_area_m2(x0, y0, x1, y1)).otherwise(F.lit(0.0))


def bucket_key(latitude, longitude, size_m: float = 500.0) -> Column:
    """Metre grid key ``row:column`` of a point."""
    lat, lng = _col(latitude), _col(longitude)
    row = F.floor(lat * METRES_PER_DEGREE / size_m)
    column = F.floor(lng * METRES_PER_DEGREE * F.cos(F.radians(lat)) / size_m)
    return F.concat_ws(":", row.cast("string"), column.cast("string"))
