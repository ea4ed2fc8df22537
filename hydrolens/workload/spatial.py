"""G, R, D1-D4: geometry, spatial joins and raster pixel tables."""

from pyspark.sql import functions as F

from hydrolens.functions import geo
from hydrolens.operators import aggregates as A
from hydrolens.operators import polygons, raster, spatial
from hydrolens.plans import features
from hydrolens.session import scratch_path
from hydrolens.sources import geojson
from hydrolens.workload.registry import near, nudged, query, rounded
from hydrolens.workload.relational import MEET


def y_sql(lat: str) -> str:
    s = f"SIN(RADIANS({lat}))"
    return (
        f"(({1 - geo.E2!r}e0) * ({s} / (1e0 - {geo.E2!r}e0 * {s} * {s}) - LN((1e0 - {geo.ECC!r}e0 * {s}) / (1e0 + {geo.ECC!r}e0 * {s})) / {2 * geo.ECC!r}e0) * {geo.A / 2!r}e0)"
    )


def area_sql(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"((RADIANS({x1}) - RADIANS({x0})) * {geo.A!r}e0 * ({y_sql(y1)} - {y_sql(y0)}))"


def utm_sql(lon: str, lat: str) -> tuple[str, str]:
    """Easting and northing of zone 46 as SQL, from the same series."""
    import math

    n = geo._N
    c = 2 * math.sqrt(n) / (1 + n)
    sin, lam = f"SIN(RADIANS({lat}))", f"RADIANS({lon} - {geo.central_meridian(46)!r}e0)"
    at = "(LN((1e0 + {0}) / (1e0 - {0})) / 2)".format
    t = f"SINH({at(sin)} - {c!r}e0 * {at(f'({c!r}e0 * {sin})')})"
    xi, eta = f"ATAN2({t}, COS({lam}))", at(f"(SIN({lam}) / SQRT(1e0 + {t} * {t}))")
    x, y = eta, xi
    for j, a in enumerate(geo._ALPHA, start=1):
        x += f" + CAST({a!r} AS DOUBLE) * COS({2 * j} * {xi}) * SINH({2 * j} * {eta})"
        y += f" + CAST({a!r} AS DOUBLE) * SIN({2 * j} * {xi}) * COSH({2 * j} * {eta})"
    k = geo.SCALE * geo._RADIUS
    return f"(500000e0 + {k!r}e0 * ({x}))", f"({k!r}e0 * ({y}))"


def triangle(x0="xmin", y0="ymin", x1="xmax", y1="ymax"):
    def p(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    ring = F.array(p(x0, y0), p(x1, y0), p(x0, y1), p(x0, y0))
    return geo.geometry(F.lit("Polygon"), F.array(ring), F.array(F.lit(0)), F.array(F.lit(False)))


def boxes(df):
    return df.withColumn("geometry", geo.box("xmin", "ymin", "xmax", "ymax"))


# --- measures -----------------------------------------------------------------------------


@query("g1_centroid", "v_labels", sql="SELECT extent_id, ROUND(xmin + (xmax - xmin) / 3, 9) AS x, ROUND(ymin + (ymax - ymin) / 3, 9) AS y FROM v_labels")
def g1(v):
    c = v.v_labels.select("extent_id", geo.centroid(triangle()).alias("c"))
    return rounded(c.select("extent_id", "c.x", "c.y"), x=9, y=9)


@query("g2_vertex_centroid", "v_labels", sql="SELECT extent_id, ROUND((xmin * 3 + xmax) / 4, 9) AS x, ROUND((ymin * 3 + ymax) / 4, 9) AS y FROM v_labels")
def g2(v):
    c = v.v_labels.select("extent_id", geo.vertex_centroid(triangle()).alias("c"))
    return rounded(c.select("extent_id", "c.x", "c.y"), x=9, y=9)


@query("g3_area", "v_cells", sql=f"SELECT cell_id, ROUND({area_sql('xmin', 'ymin', 'xmax', 'ymax')}, 2) AS area_m2 FROM v_cells")
def g3(v):
    return rounded(boxes(v.v_cells).select("cell_id", geo.area_m2("geometry").alias("area_m2")), area_m2=2)


def paired(v):
    """Every cell with one of all segments."""
    n = v.v_segments.agg(F.count(F.lit(1)).alias("n"))  # one row
    numbered = v.v_cells.crossJoin(F.broadcast(n)).withColumn("segment_id", F.col("cell_id") % F.col("n") + 1).drop("n")
    return numbered.join(v.v_segments, "segment_id")


@query("g4_distance", "v_cells", "v_segments", sql="""
SELECT c.cell_id, s.segment_id, ROUND(SQRT(POW((s.y1 - c.ymin) * 111320e0, 2) + POW((s.x1 - c.xmin) * 111320e0 * COS((s.y1 + c.ymin) * PI() / 360), 2)), 5) AS d
FROM v_cells c JOIN v_segments s ON c.cell_id % (SELECT COUNT(*) FROM v_segments) + 1 = s.segment_id""")
def g4(v):
    j = paired(v)
    return rounded(j.select("cell_id", "segment_id", geo.distance_m("ymin", "xmin", "y1", "x1").alias("d")), d=5)


def seg_sql(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = f"LEAST(1e0, GREATEST(0e0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))))"
    return f"SQRT(POW({px} - ({ax} + {t} * ({bx} - {ax})), 2) + POW({py} - ({ay} + {t} * ({by} - {ay})), 2))"


KX = f"({geo.A!r}e0 * COS(RADIANS(y)) / SQRT(1e0 - {geo.E2!r}e0 * SIN(RADIANS(y)) * SIN(RADIANS(y))) * PI() / 180)"
KY = f"({geo.A * (1 - geo.E2)!r}e0 / POW(1e0 - {geo.E2!r}e0 * SIN(RADIANS(y)) * SIN(RADIANS(y)), 1.5) * PI() / 180)"
METRES = seg_sql("0e0", "0e0", f"((x1 - x) * {KX})", f"((y1 - y) * {KY})", f"((x2 - x) * {KX})", f"((y2 - y) * {KY})")


@query("g5_distance_point_line", "v_cells", "v_segments", sql=f"""
SELECT cell_id, ROUND({METRES}, 3) AS d FROM (SELECT c.cell_id, c.xmin AS x, c.ymin AS y, s.* FROM v_cells c JOIN v_segments s ON c.cell_id % (SELECT COUNT(*) FROM v_segments) + 1 = s.segment_id)""")
def g5(v):
    j = paired(v)
    line = geo.line(("x1", "y1"), ("x2", "y2"))
    return rounded(j.select("cell_id", geo.distance_point_line("xmin", "ymin", line).alias("d")), d=3)


E, N = utm_sql("xmin", "ymin")


@query("g6_to_utm", "v_cells", sql=f"SELECT cell_id, ROUND({E}, 4) AS easting, ROUND({N}, 4) AS northing, ROUND(xmin, 8) AS lon, ROUND(ymin, 8) AS lat FROM v_cells")
def g6(v):
    u = v.v_cells.withColumn("u", geo.to_utm("xmin", "ymin")).withColumn("b", geo.from_utm("u.x", "u.y"))
    return rounded(
        u.select("cell_id", F.col("u.x").alias("easting"), F.col("u.y").alias("northing"), F.col("b.x").alias("lon"), F.col("b.y").alias("lat")),
        easting=4, northing=4, lon=8, lat=8,
    )


@query("g24_bucket_key", "v_cells", sql="""
SELECT cell_id, CAST(FLOOR(ymin * 111320e0 / 500e0) AS BIGINT) || ':' || CAST(FLOOR(xmin * 111320e0 * COS(RADIANS(ymin)) / 500e0) AS BIGINT) AS bucket FROM v_cells""")
def g24(v):
    return v.v_cells.select("cell_id", geo.bucket_key("ymin", "xmin").alias("bucket"))


@query("g26_multi_bounds", "v_labels", sql="SELECT extent_id, 'MultiPolygon' AS type, xmin, ymin, xmax, ymax FROM v_labels")
def g26(v):
    g = boxes(v.v_labels).select("extent_id", geo.as_multi("geometry").alias("g"))
    b = geo.bounds("g")
    return g.select("extent_id", "g.type", *[b[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


# --- polygon work -------------------------------------------------------------------------


@query("g7_polygonal_parts", "v_labels", sql="SELECT extent_id, CASE WHEN extent_id % 7 = 0 THEN 2 ELSE 1 END AS parts FROM v_labels")
def g7(v):
    def p(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    bow = F.array(p("xmin", "ymin"), p("xmax", "ymax"), p("xmax", "ymin"), p("xmin", "ymax"), p("xmin", "ymin"))
    ring = F.when(F.col("extent_id") % 7 == 0, bow).otherwise(geo.box_ring("xmin", "ymin", "xmax", "ymax"))
    g = geo.geometry(F.lit("Polygon"), F.array(ring), F.array(F.lit(0)), F.array(F.lit(False)))
    parts = polygons.polygonal_parts(v.v_labels.select("extent_id", g.alias("geometry")))
    return parts.groupBy("extent_id").agg(F.count(F.lit(1)).alias("parts"))


# union of boxes in SQL: elementary rectangles between all box edges of an event, kept when some box covers them
UNION_SQL = f"""
WITH xs AS (SELECT DISTINCT event_id, x FROM (SELECT event_id, xmin AS x FROM v_labels UNION ALL SELECT event_id, xmax FROM v_labels)),
ys AS (SELECT DISTINCT event_id, y FROM (SELECT event_id, ymin AS y FROM v_labels UNION ALL SELECT event_id, ymax FROM v_labels)),
xi AS (SELECT event_id, x AS x0, LEAD(x) OVER (PARTITION BY event_id ORDER BY x) AS x1 FROM xs),
yi AS (SELECT event_id, y AS y0, LEAD(y) OVER (PARTITION BY event_id ORDER BY y) AS y1 FROM ys)
SELECT xi.event_id, ROUND(SUM({area_sql('x0', 'y0', 'x1', 'y1')}), 0) AS union_area_m2 FROM xi JOIN yi ON xi.event_id = yi.event_id
WHERE x1 IS NOT NULL AND y1 IS NOT NULL AND EXISTS (SELECT 1 FROM v_labels f WHERE f.event_id = xi.event_id AND f.xmin <= x0 AND f.xmax >= x1 AND f.ymin <= y0 AND f.ymax >= y1)
GROUP BY xi.event_id"""


@query("g8_union_area", "v_labels", sql=UNION_SQL)
def g8(v):
    return rounded(polygons.union_area(boxes(v.v_labels), ["event_id"]), union_area_m2=0)


@query("g9_intersects", "v_cells", "v_labels", sql=f"""
SELECT c.cell_id, f.extent_id FROM v_cells c JOIN v_labels f ON {MEET}
WHERE (GREATEST(c.xmin, f.xmin) - f.xmin) / (f.xmax - f.xmin) + (GREATEST(c.ymin, f.ymin) - f.ymin) / (f.ymax - f.ymin) <= 1""")
def g9(v):
    c = v.v_cells.select("cell_id", geo.box("xmin", "ymin", "xmax", "ymax").alias("geometry"))
    e = v.v_labels.select("extent_id", triangle().alias("right_geometry"))
    return spatial.spatial_join(c, e).select("cell_id", "extent_id")


HALF = ("95.45e0", "16.5e0", "95.55e0", "16.62e0")


@query("g10_clip", "v_labels", sql=f"""
SELECT extent_id, ROUND({area_sql(f'GREATEST(xmin, {HALF[0]})', f'GREATEST(ymin, {HALF[1]})', f'LEAST(xmax, {HALF[2]})', f'LEAST(ymax, {HALF[3]})')}, 1) AS area_m2
FROM v_labels WHERE xmin < {HALF[2]} AND xmax > {HALF[0]} AND ymin < {HALF[3]} AND ymax > {HALF[1]}""")
def g10(v):
    x0, y0, x1, y1 = (F.lit(float(h[:-2])) for h in HALF)
    boundary = v.v_labels.limit(1).select(geo.box(x0, y0, x1, y1).alias("geometry"))
    clipped = polygons.clip_to_boundary(boxes(v.v_labels), boundary, ["extent_id"])
    return rounded(clipped.groupBy("extent_id").agg(F.sum("area_m2").alias("area_m2")), area_m2=1)


@query("g11_simplify", "v_labels", sql="SELECT extent_id, 5 AS vertices, xmin, xmax FROM v_labels")
def g11(v):
    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    x0, x1, y0, y1 = (F.col(c) for c in ("xmin", "xmax", "ymin", "ymax"))
    wavy = F.array(p(x0, y0), p((x0 + x1) / 2, y0 + 0.0005), p(x1, y0), p(x1, y1), p((x0 + x1) / 2, y1 - 0.0005), p(x0, y1), p(x0, y0))
    g = geo.geometry(F.lit("Polygon"), F.array(wavy), F.array(F.lit(0)), F.array(F.lit(False)))
    s = polygons.simplify(v.v_labels.select("extent_id", g.alias("geometry")), 0.002)
    return s.select("extent_id", F.size(F.col("geometry.rings")[0]).alias("vertices"), "geometry.bbox.xmin", "geometry.bbox.xmax")


CLIP = area_sql("GREATEST(c.xmin, f.xmin)", "GREATEST(c.ymin, f.ymin)", "LEAST(c.xmax, f.xmax)", "LEAST(c.ymax, f.ymax)")
INNER = "c.xmin < f.xmax AND c.xmax > f.xmin AND c.ymin < f.ymax AND c.ymax > f.ymin"
CELL = area_sql("c.xmin", "c.ymin", "c.xmax", "c.ymax")


@query("g12_flooded_fraction", "v_cells", "v_labels", sql=f"""
SELECT c.cell_id, ROUND(LEAST(1e0, SUM(CASE WHEN {INNER} THEN {CLIP} ELSE 0e0 END) / {CELL}), 6) AS flooded_fraction FROM v_cells c JOIN v_labels f ON {MEET} GROUP BY c.cell_id, c.xmin, c.ymin, c.xmax, c.ymax""")
def g12(v):
    cells = spatial.with_box(v.v_cells)
    o = spatial.box_overlaps(cells, spatial.with_box(v.v_labels))
    return rounded(spatial.flooded_fraction(cells, o), flooded_fraction=6)


@query("g12_polygon_fraction", "v_cells", "v_labels", sql=f"""
SELECT c.cell_id, ROUND(LEAST(1e0, SUM(CASE WHEN {INNER} THEN {CLIP} ELSE 0e0 END) / {CELL}), 6) AS flooded_fraction FROM v_cells c JOIN v_labels f ON {MEET} GROUP BY c.cell_id, c.xmin, c.ymin, c.xmax, c.ymax""")
def g12_polygon(v):
    cells = spatial.with_box(v.v_cells)
    o = spatial.polygon_overlaps(cells, boxes(v.v_labels))
    return rounded(spatial.flooded_fraction(cells, o), flooded_fraction=6)


# elementary rectangles that some box of an event covers
RECTANGLES = """xs AS (SELECT DISTINCT event_id, x FROM (SELECT event_id, xmin AS x FROM v_labels UNION ALL SELECT event_id, xmax FROM v_labels)),
ys AS (SELECT DISTINCT event_id, y FROM (SELECT event_id, ymin AS y FROM v_labels UNION ALL SELECT event_id, ymax FROM v_labels)),
xi AS (SELECT event_id, x AS x0, LEAD(x) OVER (PARTITION BY event_id ORDER BY x) AS x1 FROM xs),
yi AS (SELECT event_id, y AS y0, LEAD(y) OVER (PARTITION BY event_id ORDER BY y) AS y1 FROM ys),
covered AS (SELECT DISTINCT xi.event_id, x0, x1, y0, y1 FROM v_labels f JOIN xi ON f.event_id = xi.event_id AND x0 >= f.xmin AND x1 <= f.xmax JOIN yi ON f.event_id = yi.event_id AND y0 >= f.ymin AND y1 <= f.ymax)"""


def fraction_sql(limits: str = "(-1e9, -1e9, 1e9, 1e9)") -> str:
    """Share of each cell that each event covers inside a box, from the elementary rectangles."""
    part = area_sql("GREATEST(c.xmin, f.x0)", "GREATEST(c.ymin, f.y0)", "LEAST(c.xmax, f.x1)", "LEAST(c.ymax, f.y1)")
    a, b, c, d = limits.strip("()").split(", ")
    return f"""WITH {RECTANGLES},
f AS (SELECT event_id, GREATEST(x0, {a}) AS x0, GREATEST(y0, {b}) AS y0, LEAST(x1, {c}) AS x1, LEAST(y1, {d}) AS y1 FROM covered)
SELECT f.event_id, c.cell_id, ROUND(LEAST(1e0, SUM({part}) / MAX({CELL})), 6) AS flooded_fraction
FROM f JOIN v_cells c ON c.xmin < f.x1 AND c.xmax > f.x0 AND c.ymin < f.y1 AND c.ymax > f.y0 WHERE f.x0 < f.x1 AND f.y0 < f.y1 GROUP BY f.event_id, c.cell_id"""


@query("g12_union_fraction", "v_cells", "v_labels", sql=fraction_sql())
def g12_union(v):
    f = spatial.union_fraction(spatial.with_box(v.v_cells), boxes(v.v_labels))
    return rounded(f, flooded_fraction=6)


# --- imports, from files to an overlay ------------------------------------------------------


def feature_json(geom: str = "geometry", **properties):
    """A GeoJSON feature of a polygon with one ring."""
    ring = F.transform(F.col(geom)["rings"][0], lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
        F.struct(*[c.cast("string").alias(n) for n, c in properties.items()]).alias("properties")))


def written(df, name: str, **options) -> str:
    """Write the one text column of ``df`` to a new folder below the shared checkpoint folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).text(path)
    return path


def label_features(v):
    event = {"event_id": F.col("event_id"), "event_start_date": F.col("observed_date"), "event_end_date": F.date_add("observed_date", 5), "extent_id": F.col("extent_id")}
    return boxes(v.v_labels).select("extent_id", "event_id", feature_json(**event).alias("value"))


@query("io1_read_features", "v_labels", sql=f"SELECT extent_id, ROUND({area_sql('xmin', 'ymin', 'xmax', 'ymax')}, 1) AS area_m2, CAST(observed_date AS VARCHAR) AS start_date FROM v_labels")
def io1(v):
    # collections of a hundred features, one file each
    rows = label_features(v).withColumn("part", F.floor(F.col("extent_id") / 100))
    documents = rows.groupBy("part").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("value"))
    read = geojson.read_features(v.spark, written(documents.select("value"), "collections", maxRecordsPerFile=1))
    return rounded(read.select(F.col("properties")["extent_id"].cast("bigint").alias("extent_id"), geo.area_m2("geometry").alias("area_m2"), F.col("properties")["event_start_date"].alias("start_date")), area_m2=1)


def boundary_file(v, limits=None) -> str:
    hull = area_of_cells(v) if limits is None else area_of_cells(v).select(geo.box(*[F.lit(float(h[:-2])) for h in limits]).alias("geometry"))
    return written(hull.select(feature_json(pcode=F.lit("demo-1"), township=F.lit("Demo")).alias("value")), "boundary")


@query("io2_read_boundary", "v_cells", sql="SELECT MIN(xmin) AS xmin, MIN(ymin) AS ymin, MAX(xmax) AS xmax, MAX(ymax) AS ymax, 'demo-1' AS pcode FROM v_cells")
def io2(v):
    b = geojson.read_boundary(v.spark, boundary_file(v))
    return b.select("geometry.bbox.*", F.col("properties")["pcode"].alias("pcode"))


@query("g18_boundary_feature", "v_cells", sql="SELECT 'Demo' AS name, 'township_boundary' AS asset_type, 'boundary:demo-1' AS source_key, MIN(xmin) AS xmin, MAX(ymax) AS ymax FROM v_cells")
def g18(v):
    b = geojson.boundary_feature(geojson.read_boundary(v.spark, boundary_file(v)), "none", "none")
    return b.select("name", "asset_type", "source_key", "geometry.bbox.xmin", "geometry.bbox.ymax")


UNION_COUNT_SQL = f"SELECT u.event_id AS group_value, 'demo:event_id=' || u.event_id AS source_key, u.union_area_m2, n.features FROM ({UNION_SQL}) u JOIN (SELECT event_id, COUNT(*) AS features FROM v_labels GROUP BY event_id) n ON u.event_id = n.event_id"


@query("d6_import_extents", "v_labels", sql=UNION_COUNT_SQL)
def d6(v):
    lines = written(label_features(v).select("value"), "features")
    extents, _, _, _ = features.import_extents(geojson.read_feature_lines(v.spark, lines), None, "event_id", "demo")
    return rounded(extents.select("group_value", "source_key", (F.col("area_km2") * 1e6).alias("union_area_m2"), F.col("source_feature_count").alias("features")), union_area_m2=0)


@query("d7_import_to_fraction", "v_cells", "v_labels", sql=fraction_sql(f"({', '.join(HALF)})"))
def d7(v):
    lines = written(label_features(v).select("value"), "features")
    boundary = geojson.read_boundary(v.spark, boundary_file(v, HALF))
    _, pieces, _, _ = features.import_gfd_events(geojson.read_feature_lines(v.spark, lines), boundary)
    return rounded(spatial.outline_fraction(spatial.with_box(v.v_cells), pieces, ["event_id"], bucket_deg=0.01), flooded_fraction=6)


@query("d8_import_sar", "v_labels", sql=f"""
SELECT 'demo:sar:event:sar-' || u.event_id AS source_key, u.event_id AS reference_gfd_event_id, 'sar' AS label_source, u.union_area_m2, e.start_date
FROM ({UNION_SQL}) u JOIN (SELECT event_id, MIN(observed_date) AS start_date FROM v_labels GROUP BY event_id) e ON u.event_id = e.event_id""")
def d8(v):
    event = {"event_id": F.concat(F.lit("sar-"), "event_id"), "event_start_date": F.col("observed_date"), "event_end_date": F.date_add("observed_date", 5)}
    lines = written(boxes(v.v_labels).select(feature_json(**event).alias("value")), "sar-features")
    extents, _, _, _ = features.import_sar_events(geojson.read_feature_lines(v.spark, lines), None)
    return rounded(extents.select("source_key", "reference_gfd_event_id", "label_source", (F.col("area_km2") * 1e6).alias("union_area_m2"), F.col("observed_start_date").alias("start_date")), union_area_m2=0)


@query("a11_cell_overlap", "v_cells", "v_labels", sql=f"""
SELECT c.cell_id, ROUND(SUM(CASE WHEN {INNER} THEN {CLIP} ELSE 0e0 END), 1) AS flooded_area_m2, MAX(f.event_count) AS event_count_max,
  ROUND(SUM(CASE WHEN {INNER} THEN {CLIP} ELSE 0e0 END * f.event_count), 1) AS weighted_area_events FROM v_cells c JOIN v_labels f ON {MEET} GROUP BY c.cell_id""")
def a11(v):
    o = spatial.box_overlaps(spatial.with_box(v.v_cells), spatial.with_box(v.v_labels), keep=["event_count"])
    return rounded(A.cell_overlap(o), flooded_area_m2=1, weighted_area_events=1)


# --- grids and lines ----------------------------------------------------------------------


def area_of_cells(v):
    """The hull of all cells as one boundary row."""
    c = v.v_cells.agg(*[f(n).alias(n) for f, n in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))])
    return boxes(c).select("geometry")


@query("g13_square_grid", "v_cells")
def g13(v):
    g = spatial.square_grid(area_of_cells(v), 500)
    return rounded(g.select("grid_i", "grid_j", "coverage_fraction"), coverage_fraction=6)


EAST, NORTH = utm_sql("xmin", "ymin")


# a rectangle of the plane, so that SQL can cut it by the squares
@query("g13_utm_rectangle", "v_cells", sql=f"""
WITH r AS (SELECT MIN({EAST}) AS x0, MAX({EAST}) AS x1, MIN({NORTH}) AS y0, MAX({NORTH}) AS y1 FROM v_cells),
i AS (SELECT UNNEST(GENERATE_SERIES(CAST(FLOOR(x0 / 500) AS BIGINT), CAST(FLOOR(x1 / 500) AS BIGINT))) AS grid_i FROM r),
j AS (SELECT UNNEST(GENERATE_SERIES(CAST(FLOOR(y0 / 500) AS BIGINT), CAST(FLOOR(y1 / 500) AS BIGINT))) AS grid_j FROM r)
SELECT grid_i, grid_j, ROUND((LEAST(x1, grid_i * 500e0 + 500) - GREATEST(x0, grid_i * 500e0)) * (LEAST(y1, grid_j * 500e0 + 500) - GREATEST(y0, grid_j * 500e0)) / 250000e0, 4) AS coverage_fraction
FROM r, i, j""")
def g13_utm(v):
    corner = v.v_cells.select(geo.to_utm("xmin", "ymin").alias("u"))
    r = corner.agg(F.min("u.x").alias("x0"), F.min("u.y").alias("y0"), F.max("u.x").alias("x1"), F.max("u.y").alias("y1"))
    boundary = r.select(geo.map_vertices(geo.box("x0", "y0", "x1", "y1"), lambda x, y: geo.from_utm(x, y)).alias("geometry"))
    p = spatial.grid_pieces(boundary).groupBy("grid_i", "grid_j").agg((F.sum("area_m2") / 250000.0).alias("coverage_fraction"))
    return rounded(p, coverage_fraction=4)


@query("g19_grid_weights", "v_cells")
def g19(v):
    return rounded(spatial.grid_weights(area_of_cells(v)), weight=6)


A1, B1 = utm_sql("x1", "y1")
A2, B2 = utm_sql("x2", "y2")


def hull_corner(i: int, lon: str, lat: str) -> str:
    x, y = utm_sql(lon, lat)
    return f"SELECT {i} AS i, {x} AS x, {y} AS y FROM hull"


# each line cut by the four sides of the projected hull
@query("g17_segment_lines", "v_segments", "v_cells", sql=f"""
WITH hull AS (SELECT MIN(xmin) AS hx0, MIN(ymin) AS hy0, MAX(xmax) AS hx1, MAX(ymax) AS hy1 FROM v_cells),
corners AS ({' UNION ALL '.join(hull_corner(i, x, y) for i, (x, y) in enumerate((('hx0', 'hy0'), ('hx1', 'hy0'), ('hx1', 'hy1'), ('hx0', 'hy1'))))}),
sides AS (SELECT p.x AS px, p.y AS py, q.x - p.x AS dx, q.y - p.y AS dy FROM corners p JOIN corners q ON q.i = (p.i + 1) % 4),
s AS (SELECT segment_id, {A1} AS ax, {B1} AS ay, {A2} AS bx, {B2} AS bz FROM v_segments),
f AS (SELECT segment_id, SQRT(POW(bx - ax, 2) + POW(bz - ay, 2)) AS d, dx * (ay - py) - dy * (ax - px) AS f0, dx * (bz - py) - dy * (bx - px) AS f1 FROM s, sides),
t AS (SELECT segment_id, MAX(d) AS d, MAX(CASE WHEN f1 > f0 THEN GREATEST(0e0, -f0 / (f1 - f0)) WHEN f1 = f0 AND f0 < 0 THEN 2e0 ELSE 0e0 END) AS low,
  MIN(CASE WHEN f1 < f0 THEN LEAST(1e0, -f0 / (f1 - f0)) ELSE 1e0 END) AS high FROM f GROUP BY segment_id)
SELECT segment_id, CAST(CEIL((high - low) * d / 100 - 1e-9) AS BIGINT) AS pieces, ROUND((high - low) * d, 3) AS length_m FROM t WHERE low < high""")
def g17(v):
    lines = v.v_segments.select(
        F.col("segment_id").alias("line_id"), F.concat(F.lit("line "), F.col("segment_id")).alias("name"), F.lit("river").alias("waterway"),
        geo.line(("x1", "y1"), ("x2", "y2")).alias("geometry"),
    )
    pieces = spatial.segment_lines(lines, area_of_cells(v), 100.0)
    whole = pieces.groupBy(F.col("line_id").alias("segment_id")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("segment_length_m").alias("length_m"))
    return rounded(whole, length_m=3)


CENTRES = "(SELECT cell_id, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM v_cells)"


def centres(v):
    return v.v_cells.select("cell_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))


@query("g20_nearest_waterway", "v_cells", "v_segments", sql=f"""
WITH d AS (SELECT cell_id, asset_type, segment_id, {seg_sql('x', 'y', 'x1', 'y1', 'x2', 'y2')} AS deg, {METRES} AS m FROM {CENTRES} c, v_segments s),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id, asset_type ORDER BY deg, segment_id) AS r FROM d)
SELECT cell_id, ROUND(MAX(m) FILTER (WHERE asset_type = 'river_segment'), 2) AS distance_to_river_m, ROUND(MAX(m) FILTER (WHERE asset_type = 'canal_segment'), 2) AS distance_to_canal_m,
  ROUND(MIN(m), 2) AS distance_to_waterway_m FROM n WHERE r = 1 GROUP BY cell_id""")
def g20(v):
    n = spatial.nearest_waterway(centres(v), v.v_segments)
    return rounded(n, distance_to_river_m=2, distance_to_canal_m=2, distance_to_waterway_m=2)


@query("j8_three_nearest", "v_cells", "v_segments", sql=f"""
WITH d AS (SELECT cell_id, asset_type, segment_id, {seg_sql('x', 'y', 'x1', 'y1', 'x2', 'y2')} AS deg, {METRES} AS m FROM {CENTRES} c, v_segments s),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id, asset_type ORDER BY deg, segment_id) AS r FROM d)
SELECT cell_id, asset_type, r AS rank, ROUND(deg, 9) AS distance_deg, ROUND(m, 2) AS distance_m FROM n WHERE r <= 3""")
def j8(v):
    n = spatial.nearest_segments(centres(v), v.v_segments, k=3)
    return rounded(n.select("cell_id", "asset_type", F.col("rank").cast("bigint").alias("rank"), "distance_deg", "distance_m"), distance_deg=9, distance_m=2)


CX, CY = utm_sql("x", "y")


@query("g21_distance_to_network", "v_cells", "v_segments", sql=f"""
WITH c AS (SELECT cell_id, {CX} AS px, {CY} AS py FROM {CENTRES}), s AS (SELECT {A1} AS ax, {B1} AS ay, {A2} AS bx, {B2} AS bz FROM v_segments)
SELECT cell_id, ROUND(MIN({seg_sql('px', 'py', 'ax', 'ay', 'bx', 'bz')}), 2) AS distance_to_waterway_m FROM c, s GROUP BY cell_id""")
def g21(v):
    return rounded(spatial.distance_to_network(centres(v), v.v_segments), distance_to_waterway_m=2)


# sample points: pixel positions against cell centres; one cell is wider than the radius, so 3x3 cells suffice in SQL
POINTS = """points AS (SELECT p.px_row * 100000 + p.px_col AS point_id, FLOOR(p.px_col / 5) AS gi, FLOOR(p.px_row / 5) AS gj, 95.4e0 + p.px_col * 0.001e0 + 0.0005e0 AS lng, 16.45e0 + p.px_row * 0.001e0 + 0.0005e0 AS lat FROM v_pixels p),
samples AS (SELECT c.cell_id AS sample_id, grid_i, grid_j, (c.xmin + c.xmax) / 2 AS lng, (c.ymin + c.ymax) / 2 AS lat, q.probability AS value FROM v_cells c JOIN v_predictions q ON c.cell_id = q.cell_id),
pairs AS (SELECT point_id, sample_id, value, SQRT(POW((s.lat - p.lat) * 111320e0, 2) + POW((s.lng - p.lng) * 111320e0 * COS((p.lat + s.lat) * PI() / 360), 2)) AS d
  FROM points p, (SELECT unnest([-1, 0, 1]) AS di) a, (SELECT unnest([-1, 0, 1]) AS dj) b, samples s WHERE s.grid_i = p.gi + di AND s.grid_j = p.gj + dj)"""


def points_samples(v):
    px = v.v_pixels
    points = px.select(
        (F.col("px_row").cast("bigint") * 100000 + F.col("px_col")).alias("point_id"), (95.4 + F.col("px_col") * 0.001 + 0.0005).alias("lng"), (16.45 + F.col("px_row") * 0.001 + 0.0005).alias("lat")
    )
    cells = v.v_cells.join(v.v_predictions, "cell_id")
    samples = cells.select(
        F.col("cell_id").alias("sample_id"), ((F.col("xmin") + F.col("xmax")) / 2).alias("lng"), ((F.col("ymin") + F.col("ymax")) / 2).alias("lat"), F.col("probability").alias("value")
    )
    return points, samples


@query("g22_idw", "v_pixels", "v_cells", "v_predictions", sql=f"""WITH {POINTS},
n AS (SELECT point_id, MIN(d) AS least, ARG_MIN(value, d) AS nearest, SUM(value / (d * d)) / SUM(1 / (d * d)) AS mean FROM pairs WHERE d <= {spatial.IDW_RADIUS_M!r}e0 GROUP BY point_id)
SELECT p.point_id, ROUND(CASE WHEN least < 0.5e0 THEN nearest ELSE mean END, 6) AS value FROM points p LEFT JOIN n ON p.point_id = n.point_id""")
def g22(v):
    return rounded(spatial.idw(*points_samples(v)), value=6)


@query("g23_nearest_sample", "v_pixels", "v_cells", "v_predictions", sql=f"""WITH {POINTS},
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id ORDER BY ROUND(d, 6), sample_id) AS r FROM pairs WHERE d < 275e0)
SELECT point_id, ROUND(d, 4) AS distance_m FROM n WHERE r = 1""")
def g23(v):
    n = spatial.nearest_sample(*points_samples(v))
    return rounded(n.select("point_id", "distance_m"), distance_m=4)


# --- zonal --------------------------------------------------------------------------------


@query("g14_zonal_stats", "v_pixels", sql="""
SELECT cell_id, COUNT(value) AS n, ROUND(AVG(value), 6) AS mean, MIN(value) AS low, MAX(value) AS high, ROUND(STDDEV_POP(value), 5) AS dev FROM v_pixels GROUP BY cell_id""")
def g14(v):
    z = raster.zonal_stats(v.v_pixels)
    named = z.select(
        "cell_id", F.col("elevation_sample_count").alias("n"), F.col("elevation_mean_m").alias("mean"), F.col("elevation_min_m").alias("low"),
        F.col("elevation_max_m").alias("high"), F.col("elevation_stddev_m").alias("dev"),
    )
    return rounded(named, mean=6, dev=5)


CLASS_SQL = """
WITH n AS (SELECT cell_id, class_code, COUNT(*) AS c FROM v_pixels GROUP BY 1, 2), t AS (SELECT *, SUM(c) OVER (PARTITION BY cell_id) AS total, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY c DESC, class_code) AS r FROM n)
SELECT cell_id, CAST(SUM(c) AS BIGINT) AS land_cover_pixel_count, MAX(class_code) FILTER (WHERE r = 1) AS land_cover_dominant_code,
  ROUND(COALESCE(MAX(FLOOR((c * 20000 + total) / (total * 2)) / 100e0) FILTER (WHERE class_code = 40), 0), 2) AS cropland_pct FROM t GROUP BY cell_id"""


@query("g15_zonal_classes", "v_pixels", sql=CLASS_SQL)
def g15(v):
    z = raster.zonal_classes(v.v_pixels)
    return z.select("cell_id", "land_cover_pixel_count", "land_cover_dominant_code", F.coalesce(F.try_element_at("land_cover_percentages", F.lit(40)), F.lit(0.0)).alias("cropland_pct"))


@query("g16_clip_pixels", "v_pixels", sql="""
SELECT px_row, px_col FROM (SELECT px_row, px_col, 95.4e0 + px_col * 0.001e0 + 0.0004e0 AS x, 16.45e0 + px_row * 0.001e0 + 0.0004e0 AS y FROM v_pixels)
WHERE x > 95.41e0 AND y > 16.46e0 AND (x - 95.41e0) / 0.2e0 + (y - 16.46e0) / 0.15e0 < 1""")
def g16(v):
    p = v.v_pixels.withColumns({"lon": 95.4 + F.col("px_col") * 0.001 + 0.0004, "lat": 16.45 + F.col("px_row") * 0.001 + 0.0004})
    b = v.v_pixels.limit(1).select(*[F.lit(x).alias(n) for x, n in ((95.41, "xmin"), (16.46, "ymin"), (95.61, "xmax"), (16.61, "ymax"))])
    return raster.clip_pixels(p, b.select(triangle().alias("geometry"))).select("px_row", "px_col")


# --- change detection ---------------------------------------------------------------------

IMAGES = "(SELECT CAST(o_orderdate AS DATE) AS image_date, CAST(o_custkey % 8 AS INT) AS px_row, CAST(o_orderkey % 8 AS INT) AS px_col, -o_totalprice / 20000e0 AS value FROM orders)"
DATED = "(SELECT event_id, MIN(observed_date) AS s, MIN(observed_date) + 5 AS e FROM v_labels GROUP BY event_id)"
COMPOSITE = f"""(SELECT event_id, px_row, px_col, MEDIAN(value) FILTER (WHERE image_date < s) AS baseline, MEDIAN(value) FILTER (WHERE image_date >= s) AS during
  FROM {IMAGES} i JOIN {DATED} d ON (image_date >= s - 21 AND image_date < s - 1) OR (image_date >= s AND image_date < e + 3) GROUP BY 1, 2, 3)"""


def images_events(v):
    o = v.table("orders")
    images = o.select(
        F.col("o_orderdate").cast("date").alias("image_date"), (F.col("o_custkey") % 8).cast("int").alias("px_row"), (F.col("o_orderkey") % 8).cast("int").alias("px_col"),
        (-F.col("o_totalprice") / 20000.0).alias("value"),
    )
    events = v.v_labels.groupBy("event_id").agg(F.min("observed_date").alias("event_start_date")).withColumn("event_end_date", F.date_add("event_start_date", 5))
    return images, events


@query("r1_composite", "v_labels", sql=f"SELECT event_id, px_row, px_col, {near('baseline', 7)} AS baseline, {near('during', 7)} AS during FROM {COMPOSITE}")
def r1(v):
    return nudged(raster.composite(*images_events(v)), baseline=7, during=7)


NEIGHBOURS = "(SELECT unnest([-1, 0, 1]) AS dr) a, (SELECT unnest([-1, 0, 1]) AS dc) b"


@query("r2_focal_median", "v_pixels", sql=f"""
SELECT p.px_row, p.px_col, MEDIAN(n.value) AS value FROM v_pixels p, {NEIGHBOURS}, v_pixels n WHERE n.px_row = p.px_row + dr AND n.px_col = p.px_col + dc GROUP BY 1, 2""")
def r2(v):
    return raster.focal_median(v.v_pixels)


@query("r3_detect_water", "v_labels", sql=f"""
SELECT event_id, px_row, px_col, COALESCE(POW(10e0, (during - baseline) / 10) < 0.5e0, FALSE) AS by_ratio, COALESCE(during < -17, FALSE) AS by_level, COALESCE(baseline - during > 3, FALSE) AS by_drop,
  COALESCE(POW(10e0, (during - baseline) / 10) < 0.5e0, FALSE) OR COALESCE(during < -17, FALSE) OR COALESCE(baseline - during > 3, FALSE) AS water FROM {COMPOSITE}""")
def r3(v):
    return raster.detect_water(raster.composite(*images_events(v))).drop("baseline", "during")


@query("r4_mask_pixels", "v_pixels", sql="""
SELECT px_row, px_col, CAST(class_code IN (40, 80) AND px_row % 3 <> 0 AND value <= 15 AS INT) AS flooded FROM v_pixels""")
def r4(v):
    px = v.v_pixels.withColumn("water", F.col("class_code").isin(40, 80))
    water = px.select("px_row", "px_col", F.when(F.col("px_row") % 3 == 0, 80.0).otherwise(10.0).alias("occurrence"))
    hand = px.select("px_row", "px_col", F.col("value").alias("hand_m"))
    return raster.mask_pixels(px, water, hand).select("px_row", "px_col", "flooded")


@query("r5_close_mask", "v_pixels", sql=f"""
WITH m AS (SELECT px_row, px_col, CAST(class_code = 80 AS INT) AS f FROM v_pixels),
g AS (SELECT p.px_row, p.px_col, MAX(n.f) AS f FROM m p, {NEIGHBOURS}, m n WHERE dr * dr + dc * dc <= 1 AND n.px_row = p.px_row + dr AND n.px_col = p.px_col + dc GROUP BY 1, 2)
SELECT p.px_row, p.px_col, MIN(n.f) AS flooded FROM g p, {NEIGHBOURS}, g n WHERE dr * dr + dc * dc <= 1 AND n.px_row = p.px_row + dr AND n.px_col = p.px_col + dc GROUP BY 1, 2""")
def r5(v):
    return raster.close_mask(v.v_pixels.withColumn("flooded", (F.col("class_code") == 80).cast("int")))


@query("r6_label_patches", "v_pixels")
def r6_patches(v):
    wet = v.v_pixels.withColumn("flooded", F.col("class_code").isin(80, 90, 95).cast("int"))
    return raster.label_patches(wet, connectivity=4, min_px=3, size=64)


@query("r7_tag_patches", "v_labels", sql=f"""
SELECT 'sar-' || event_id AS event_id, event_id AS reference_event_id, px_row, px_col, CAST(YEAR(s) AS INT) AS event_year, 'VH' AS sar_polarization FROM {COMPOSITE} JOIN {DATED} USING (event_id)""")
def r7(v):
    images, events = images_events(v)
    t = raster.tag_patches(raster.composite(images, events), events, {"sar_polarization": "VH"})
    return t.select("event_id", "reference_event_id", "px_row", "px_col", "event_year", "sar_polarization")


@query("r8_flood_frequency", "v_pixels", "v_labels", sql="""
SELECT px_row, px_col, COUNT(*) AS event_count FROM v_pixels, (SELECT DISTINCT event_count AS e FROM v_labels) WHERE (px_row * 7 + px_col * 3 + e) % 4 = 0 AND class_code <> 80 GROUP BY 1, 2""")
def r8(v):
    wet = v.v_pixels.withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(8)))).withColumns(
        {"flooded": ((F.col("px_row") * 7 + F.col("px_col") * 3 + F.col("e")) % 4 == 0).cast("int"), "permanent_water": (F.col("class_code") == 80).cast("int")}
    )
    return raster.flood_frequency(wet)


@query("r9_paired_events", "v_labels", sql=f"SELECT event_id FROM {COMPOSITE} GROUP BY event_id HAVING COUNT(baseline) > 0 AND COUNT(during) > 0")
def r9(v):
    return raster.paired_events(raster.composite(*images_events(v)))


# --- enrichment pipelines -----------------------------------------------------------------


@query("d1_terrain_grid", "v_pixels", "v_cells", "v_segments")
def d1(v):
    p = v.v_pixels.withColumns({"lon": 95.4 + F.col("px_col") * 0.001 + 0.0005, "lat": 16.45 + F.col("px_row") * 0.001 + 0.0005})
    g = features.build_terrain_grid(area_of_cells(v), p, v.v_segments)
    return rounded(
        g.select("cell_id", "coverage_fraction", "elevation_mean_m", "elevation_sample_count", "distance_to_waterway_m", "elevation_percentile", "local_relief_m"),
        coverage_fraction=6, elevation_mean_m=6, distance_to_waterway_m=2, elevation_percentile=6, local_relief_m=6,
    )


@query("d2_land_cover", "v_cells", "v_pixels", sql=f"SELECT c.cell_id, c.grid_i, k.land_cover_dominant_code FROM v_cells c LEFT JOIN ({CLASS_SQL}) k ON c.cell_id = k.cell_id")
def d2(v):
    e = features.enrich_land_cover(v.v_cells.drop("land_cover_pixel_count"), v.v_pixels)
    return e.select("cell_id", "grid_i", "land_cover_dominant_code")


@query("d3_hand", "v_cells", "v_pixels", sql="""
SELECT c.cell_id, CASE WHEN h.low >= 0 THEN ROUND(h.mean, 6) END AS hand_mean_m FROM v_cells c LEFT JOIN
(SELECT cell_id, AVG(value - 2) AS mean, MIN(value - 2) AS low FROM v_pixels WHERE value - 2 <> -1e0 GROUP BY cell_id HAVING AVG(value - 2) BETWEEN 0 AND 5000) h ON c.cell_id = h.cell_id""")
def d3(v):
    e = features.enrich_hand(v.v_cells, v.v_pixels.withColumn("value", F.col("value") - 2), nodata=-1.0)
    return rounded(e.select("cell_id", "hand_mean_m"), hand_mean_m=6)


@query("d4_waterways", "v_cells", "v_segments", sql=f"""
WITH d AS (SELECT cell_id, asset_type, segment_id, {seg_sql('x', 'y', 'x1', 'y1', 'x2', 'y2')} AS deg, {METRES} AS m FROM {CENTRES} c, v_segments s),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id, asset_type ORDER BY deg, segment_id) AS r FROM d)
SELECT COUNT(*) AS cells, ROUND(AVG(w), 3) AS mean_m FROM (SELECT cell_id, MIN(m) AS w FROM n WHERE r = 1 GROUP BY cell_id)""")
def d4(v):
    cells = v.v_cells.withColumns({"x": (F.col("xmin") + F.col("xmax")) / 2, "y": (F.col("ymin") + F.col("ymax")) / 2})
    e = features.enrich_waterways(cells, v.v_segments)
    return rounded(e.agg(F.count("distance_to_waterway_m").alias("cells"), F.avg("distance_to_waterway_m").alias("mean_m")), mean_m=3)
