"""P, T, U, J, A, W: relational work over the product tables."""

from pyspark.sql import functions as F

from hydrolens.functions import geo
from hydrolens.functions import scalars as S
from hydrolens.operators import aggregates as A
from hydrolens.operators import joins as J
from hydrolens.operators import outlines, raster
from hydrolens.operators import ranking
from hydrolens.operators import relational as P
from hydrolens.operators import spatial
from hydrolens.workload.registry import near, nudged, query, rounded

BAND = "CASE WHEN probability < 0.25e0 THEN 'LOW' WHEN probability < 0.5e0 THEN 'MODERATE' WHEN probability < 0.75e0 THEN 'HIGH' ELSE 'VERY_HIGH' END"

ASSETS = """
SELECT CONCAT('cell:', cell_id) AS asset_id, 'terrain_cell' AS asset_type, xmin, ymin, xmax, ymax, elevation_min_m, elevation_max_m, CAST(NULL AS DOUBLE) AS segment_length_m, hand_mean_m FROM v_cells
UNION ALL SELECT CONCAT('segment:', segment_id), asset_type, x1, y1, x2, y2, NULL, NULL, 100e0 + segment_id % 400, NULL FROM v_segments"""


def assets(v):
    from hydrolens.adapters import with_views

    return v.sql(with_views(("v_cells", "v_segments"), ASSETS))


# --- paging, filters, lookups -------------------------------------------------------------


@query("p1_paginate", "v_cells", sql="SELECT cell_id, elevation_mean_m FROM v_cells ORDER BY elevation_mean_m DESC, cell_id LIMIT 50 OFFSET 100")
def p1(v):
    return P.paginate(v.v_cells.select("cell_id", "elevation_mean_m"), [F.col("elevation_mean_m").desc(), F.col("cell_id")], 3, 50)


@query("p1_page_meta", "v_cells", sql="SELECT 3 AS page, 50 AS page_size, COUNT(*) AS total, CAST(CEIL(COUNT(*) / 50e0) AS BIGINT) AS pages FROM v_cells")
def p1_meta(v):
    return P.page_meta(v.v_cells, 3, 50)


@query("p2_list_assets", "v_cells", "v_segments", sql=f"SELECT asset_id, segment_length_m FROM ({ASSETS}) WHERE asset_type = 'canal_segment'")
def p2(v):
    return P.list_assets(assets(v), "canal_segment").select("asset_id", "segment_length_m")


@query("p3_assets_in_bounds", "v_cells", sql="""
SELECT cell_id FROM v_cells WHERE xmin <= 95.5011e0 AND xmax >= 95.4511e0 AND ymin <= 16.5512e0 AND ymax >= 16.4712e0""")
def p3(v):
    cells = v.v_cells.withColumn("geometry", geo.box("xmin", "ymin", "xmax", "ymax"))
    return P.assets_in_bounds(cells, 95.4511, 16.4712, 95.5011, 16.5512).select("cell_id")


@query("p4_list_layers", "v_layers", sql="SELECT layer_key, category, name FROM v_layers WHERE quality_status = 'limited' AND is_active")
def p4(v):
    return P.list_layers(v.v_layers, quality_status="limited", is_active=True).select("layer_key", "category", "name")


@query("p5_extents_overlapping", "v_labels", sql="""
SELECT extent_id FROM v_labels WHERE classification = 'flood' AND COALESCE(observed_end_date, observed_date) >= DATE '1997-01-01'
  AND COALESCE(observed_start_date, observed_date) <= DATE '1998-06-30'""")
def p5(v):
    return P.extents_overlapping(v.v_labels, "1997-01-01", "1998-06-30", "flood").select("extent_id")


@query("p6_list_observations", "v_observations", sql="""
SELECT observation_id, observed_at FROM v_observations WHERE quality_status = 'verified' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at <= TIMESTAMP '2024-01-20'""")
def p6(v):
    return P.list_observations(v.v_observations, quality_status="verified", since="2024-01-05", until="2024-01-20").select("observation_id", "observed_at")


@query("p7_list_alerts", "v_alerts", sql="SELECT alert_id, station_id, water_level_cm FROM v_alerts WHERE status = 'open' AND risk_level = 'HIGH'")
def p7(v):
    return P.list_alerts(v.v_alerts, "open", "HIGH").select("alert_id", "station_id", "water_level_cm")


@query("p8_list_stations", "v_stations", sql="SELECT station_id, name FROM v_stations WHERE status = 'active'")
def p8(v):
    return P.list_stations(v.v_stations, "active").select("station_id", "name")


@query("p9_rain_history", "v_rain", sql=f"""
SELECT observed_date, {near('mean_precipitation_mm')} AS mean_mm FROM v_rain WHERE observed_date >= DATE '1996-01-01' ORDER BY observed_date DESC LIMIT 365""")
def p9(v):
    h = P.rain_history(v.v_rain, "1996-01-01")
    return nudged(h.select("observed_date", F.col("mean_precipitation_mm").alias("mean_mm")), mean_mm=6)


@query("p10_with_keys", "v_cells", sql="SELECT cell_id FROM v_cells WHERE hand_mean_m IS NOT NULL")
def p10(v):
    p = F.map_filter(F.create_map(F.lit("hand_mean_m"), F.col("hand_mean_m"), F.lit("relief"), F.col("local_relief_m")), lambda _, x: x.isNotNull())
    return P.with_keys(v.v_cells.withColumn("properties", p), "hand_mean_m", "relief").select("cell_id")


@query("p11_by_label_source", "v_labels", sql="SELECT extent_id, source_key FROM v_labels WHERE source_key LIKE 'demo:sar:event:%'")
def p11(v):
    return P.by_label_source(v.v_labels, " SAR ", "demo").select("extent_id", "source_key")


@query("p12_get", "v_runs", sql="SELECT run_id, status, COUNT(*) OVER () AS n FROM v_runs WHERE run_id = (SELECT MAX(o_orderkey) FROM orders)")
def p12(v):
    newest = v.table("orders").agg(F.max("o_orderkey")).first()[0]
    return P.get(v.v_runs, "run_id", newest).select("run_id", "status").withColumn("n", F.lit(1).cast("bigint"))


@query("p13_apply_patches", "v_labels", sql="""
SELECT extent_id, CASE WHEN extent_id % 4 = 0 THEN 'possible_flood' ELSE classification END AS classification,
  CASE WHEN extent_id % 8 = 0 THEN NULL ELSE event_name END AS event_name, event_count FROM v_labels""")
def p13(v):
    target = v.v_labels.select("extent_id", "classification", "event_name", "event_count")
    change = F.when(
        F.col("extent_id") % 8 == 0, F.create_map(F.lit("classification"), F.lit("possible_flood"), F.lit("event_name"), F.lit(None).cast("string"))
    ).otherwise(F.create_map(F.lit("classification"), F.lit("possible_flood")))
    patches = v.v_labels.where("extent_id % 4 = 0").select("extent_id", change.alias("changes"))
    return P.apply_patches(target, patches, "extent_id")


@query("p13_acknowledge", "v_alerts", sql="""
SELECT alert_id, CASE WHEN alert_id % 2 = 0 THEN 'acknowledged' ELSE status END AS status,
  CASE WHEN alert_id % 2 = 0 AND status = 'open' THEN 'duty' END AS acknowledged_by FROM v_alerts""")
def p13_ack(v):
    acks = v.v_alerts.where("alert_id % 2 = 0").select(
        "alert_id", F.lit("duty").alias("acknowledged_by"), F.col("created_at").alias("acknowledged_at"), F.lit("seen").alias("notes")
    )
    return P.acknowledge(v.v_alerts, acks).select("alert_id", "status", "acknowledged_by")


@query("p13_delete_ids", "v_labels", sql="SELECT extent_id FROM v_labels WHERE event_count <> 3")
def p13_delete(v):
    return P.delete_ids(v.v_labels, v.v_labels.where("event_count = 3"), "extent_id").select("extent_id")


@query("p14_search_segments", "v_segments", sql="""
SELECT segment_id FROM v_segments WHERE asset_type = 'river_segment' AND contains(LOWER(CONCAT('Segment ', segment_id, ' w', segment_id % 9)), 't 1')""")
def p14(v):
    s = v.v_segments.withColumns({"name": F.concat(F.lit("Segment "), F.col("segment_id")), "osm_id": F.concat(F.lit("w"), F.col("segment_id") % 9)})
    return P.search_segments(s, " T 1", "river_segment", ("name", "osm_id")).select("segment_id")


@query("p15_to_feature_rows", "v_labels", sql="""
SELECT 'Feature' AS type, extent_id AS id, event_id, CAST(printf('%.3f', area_km2 / 7e0) AS DOUBLE) AS area FROM v_labels""")
def p15(v):
    f = P.to_feature_rows(v.v_labels.withColumn("area", F.col("area_km2") / 7.0), "extent_id", ["event_id", "area"], rounded={"area": 3})
    return f.select("type", "id", "properties.event_id", "properties.area")


@query("p16_layer_availability", "v_cells", "v_segments", sql=f"""
SELECT bool_or(asset_type = 'river_segment') AS has_river, bool_or(asset_type = 'canal_segment') AS has_canal, bool_or(asset_type LIKE '%road%') AS has_road,
  FALSE AS has_land_cover, bool_or(asset_type = 'terrain_cell' AND hand_mean_m IS NOT NULL) AS has_hand, FALSE AS has_flood_history FROM ({ASSETS})""")
def p16(v):
    p = F.map_filter(F.create_map(F.lit("hand_mean_m"), F.col("hand_mean_m").cast("string")), lambda _, x: x.isNotNull())
    return P.layer_availability(assets(v).withColumn("properties", p))


# --- order, top-k -------------------------------------------------------------------------


@query("t1_order_screening", "v_scores", sql="SELECT row_key, probability * 100e0 AS screening_score FROM v_scores ORDER BY probability DESC, CAST(row_key AS VARCHAR)")
def t1(v):
    s = v.v_scores.select("row_key", (F.col("probability") * 100.0).alias("screening_score"))
    return P.order_screening(s, "row_key")


@query("t2_order_probability", "v_scores", sql="SELECT row_key, probability FROM v_scores ORDER BY probability DESC, row_key")
def t2(v):
    return P.order_probability(v.v_scores.select("row_key", "probability"), "row_key")


@query("t3_latest", "v_runs", sql="SELECT run_id, run_version FROM v_runs WHERE status = 'completed' ORDER BY created_at DESC, run_id DESC LIMIT 1")
def t3(v):
    return P.latest(v.v_runs, "created_at", "run_id", status="completed").select("run_id", "run_version")


@query("t4_list_runs", "v_runs", sql="SELECT run_id, status, (SELECT COUNT(*) FROM v_runs) AS total FROM v_runs ORDER BY created_at DESC, run_id DESC LIMIT 20")
def t4(v):
    return P.list_runs(v.v_runs).select("run_id", "status", "total")


@query("t5_top_contributions", "v_cells", sql="""
WITH c AS (SELECT cell_id, unnest(['a', 'b', 'c', 'd']) AS feature, unnest([0, 1, 2, 3]) AS i,
  unnest([lc_cropland * 0.5e0, lc_built * -1e0, lc_water * 2e0, lc_wetland * -1.5e0]) AS contribution FROM v_cells),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY ABS(contribution) DESC, i) AS n FROM c)
SELECT cell_id, string_agg(feature, ',' ORDER BY n) AS features, MAX(ABS(contribution)) AS largest FROM r WHERE n <= 3 GROUP BY cell_id""")
def t5(v):
    cols = [F.col(c) for c in ("lc_cropland", "lc_built", "lc_water", "lc_wetland")]
    t = v.v_cells.select("cell_id", P.top_contributions(["a", "b", "c", "d"], cols, [0.5, -1.0, 2.0, -1.5]).alias("t"))
    return t.select("cell_id", F.array_join(F.transform("t", lambda x: x["feature"]), ",").alias("features"), F.abs(F.col("t")[0]["contribution"]).alias("largest"))


RANKED = "(SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY probability DESC, row_key) AS rn, COUNT(*) OVER (PARTITION BY event_id) AS n, SUM(label) OVER (PARTITION BY event_id) AS pos FROM v_scores)"


@query("t6_top_fraction", "v_scores", sql=f"""
SELECT event_id, f AS fraction, COUNT(*) AS cells, CAST(SUM(label) AS BIGINT) AS true_positive_cells, ROUND(AVG(label), 6) AS precision,
  ROUND(SUM(label) * 1e0 / GREATEST(1, MAX(pos)), 6) AS recall
FROM {RANKED} CROSS JOIN (SELECT unnest([0.01e0, 0.05e0, 0.1e0]) AS f) WHERE rn <= GREATEST(1, CEIL(n * f)) GROUP BY event_id, f""")
def t6(v):
    return rounded(ranking.top_fraction(v.v_scores, "probability", "label", "row_key", keys=["event_id"]), precision=6, recall=6)


@query("t7_top_false_positives", "v_scores", sql="""
SELECT row_key, event_id, probability AS decision_probability FROM v_scores WHERE label = 0 AND probability >= 0.6e0 ORDER BY probability DESC, row_key LIMIT 50""")
def t7(v):
    s = v.v_scores.withColumn("decision_probability", F.col("probability"))
    return P.top_false_positives(s, 0.6).select("row_key", "event_id", "decision_probability")


@query("t8_importance", "v_scores", sql="""
WITH m AS (SELECT event_id AS feature, AVG(probability) AS w FROM v_scores GROUP BY event_id)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY w DESC) AS INT) AS rank, feature, ROUND(w / SUM(w) OVER (), 6) AS importance FROM m""")
def t8(v):
    from hydrolens.plans.training import importance_table

    m = v.v_scores.groupBy("event_id").agg(F.avg("probability").alias("w")).collect()  # one row per event
    return rounded(importance_table(v.v_scores, [r[0] for r in m], [r[1] for r in m]), importance=6)


@query("t9_pick_winner", "v_scores", sql="""
WITH m AS (SELECT event_id AS algorithm, CASE WHEN label = 1 THEN 'balanced' ELSE 'screening' END AS mode, ROUND(AVG(probability), 6) AS precision, ROUND(AVG(surface_water), 6) AS f1,
  ROUND(MAX(probability), 6) AS recall, ROUND(MIN(probability), 6) AS pr_auc FROM v_scores GROUP BY 1, 2),
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY algorithm ORDER BY precision DESC, f1 DESC, recall DESC) AS r FROM m),
w AS (SELECT *, ROW_NUMBER() OVER (ORDER BY precision DESC, f1 DESC, pr_auc DESC) AS q FROM b WHERE r = 1)
SELECT algorithm, mode, precision, precision > (SELECT precision FROM w WHERE algorithm = 'E1') + 0.01e0 AS improved FROM w WHERE q = 1""")
def t9(v):
    from hydrolens.plans.training import pick_winner

    m = v.v_scores.groupBy(F.col("event_id").alias("algorithm"), F.when(F.col("label") == 1, "balanced").otherwise("screening").alias("mode")).agg(
        F.avg("probability").alias("precision"), F.avg("surface_water").alias("f1"), F.max("probability").alias("recall"), F.min("probability").alias("pr_auc")
    )
    w = pick_winner(rounded(m, precision=6, f1=6, recall=6, pr_auc=6), "E1")
    return w.select("algorithm", "mode", "precision", F.col("beats_baseline_by_precision").alias("improved"))


@query("t10_select_event", "v_event_predictions", sql="""
SELECT event_id, split, COUNT(*) AS total_cells FROM v_event_predictions GROUP BY event_id, event_start_date, split ORDER BY (split = 'test') DESC, event_start_date DESC, event_id LIMIT 1""")
def t10(v):
    return P.select_event(A.event_summary(v.v_event_predictions, 0.1)).select("event_id", "split", "total_cells")


@query("t11_highest_alert", "v_alerts", sql="""
SELECT alert_id, risk_level FROM v_alerts WHERE status = 'open' ORDER BY CASE risk_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END DESC, created_at DESC, alert_id LIMIT 1""")
def t11(v):
    return P.highest_alert(v.v_alerts).select("alert_id", "risk_level")


GROUPS = "(SELECT DISTINCT CASE WHEN event_count % 2 = 0 THEN event_id ELSE CAST(extent_id % 90 AS VARCHAR) END AS g FROM v_labels)"


@query("t12_order_groups", "v_labels", sql=f"""
SELECT g, ROW_NUMBER() OVER (ORDER BY TRY_CAST(g AS DOUBLE) IS NULL, COALESCE(TRY_CAST(g AS DOUBLE), 0), g) AS position FROM {GROUPS}""")
def t12(v):
    g = v.v_labels.select(F.when(F.col("event_count") % 2 == 0, F.col("event_id")).otherwise((F.col("extent_id") % 90).cast("string")).alias("g")).distinct()
    keyed = g.select("g", *[c.alias(n) for c, n in zip(P.group_keys("g"), ("k1", "k2"))])
    return ranking.running_totals(keyed, [("k1", True), ("k2", True), ("g", True)], rank="position").select("g", "position")


@query("t13_extreme_cells", "v_cells", "v_predictions", sql="""
SELECT (SELECT cell_id FROM v_cells ORDER BY elevation_mean_m, cell_id LIMIT 1) AS lowest_elevation,
  (SELECT cell_id FROM v_predictions ORDER BY probability DESC, cell_id LIMIT 1) AS top_susceptibility,
  (SELECT cell_id FROM v_predictions WHERE model_version = 'm2' ORDER BY flooded_fraction DESC, cell_id LIMIT 1) AS top_forecast""")
def t13(v):
    return P.extreme_cells(v.v_cells, {"susceptibility": (v.v_predictions, "probability"), "forecast": (v.v_predictions.where("model_version = 'm2'"), "flooded_fraction")})


# --- sets ---------------------------------------------------------------------------------


@query("u1_distinct_events", "v_labels", sql="SELECT DISTINCT event_id, observed_start_date FROM v_labels WHERE observed_start_date IS NOT NULL")
def u1(v):
    return P.distinct_events(v.v_labels)


@query("u2_map_assets", "v_cells", "v_segments", sql="""
SELECT asset_type, COUNT(*) AS n, COUNT(segment_id) AS segments FROM (SELECT 'terrain_cell' AS asset_type, cell_id, NULL AS segment_id FROM v_cells
UNION ALL SELECT asset_type, NULL, segment_id FROM v_segments) GROUP BY asset_type""")
def u2(v):
    m = P.map_assets(v.v_cells.select(F.lit("terrain_cell").alias("asset_type"), "cell_id"), v.v_segments.select("asset_type", "segment_id"))
    return m.groupBy("asset_type").agg(F.count(F.lit(1)).alias("n"), F.count("segment_id").alias("segments"))


@query("u3_shared_assets", "v_predictions", sql="""
SELECT cell_id FROM v_predictions WHERE probability >= 0.4e0 INTERSECT SELECT cell_id FROM v_predictions WHERE flooded_fraction >= 0.4e0""")
def u3(v):
    return P.shared_assets(v.v_predictions.where("probability >= 0.4"), v.v_predictions.where("flooded_fraction >= 0.4"))


@query("u4_merge_rain", "v_rain", sql=f"""
SELECT observed_date AS date, {near('CASE WHEN grid_cell_count % 2 = 0 THEN max_precipitation_mm ELSE mean_precipitation_mm END')} AS precipitation_mm FROM v_rain""")
def u4(v):
    h = v.v_rain.select(F.col("observed_date").alias("date"), F.col("mean_precipitation_mm").alias("precipitation_mm"))
    f = v.v_rain.where("grid_cell_count % 2 = 0").select(F.col("observed_date").alias("date"), F.col("max_precipitation_mm").alias("precipitation_mm"))
    return nudged(P.merge_rain(f, h), precipitation_mm=6)


@query("u5_merge_feed", "v_readings", sql="""
SELECT message_id, CASE WHEN message_id % 3 = 0 THEN -1e0 ELSE soil_moisture_percent END AS soil FROM v_readings ORDER BY observed_at DESC, message_id DESC LIMIT 500""")
def u5(v):
    new = v.v_readings.where("message_id % 3 = 0").withColumn("soil_moisture_percent", F.lit(-1.0))
    return P.merge_feed(v.v_readings, new).select("message_id", F.col("soil_moisture_percent").alias("soil"))


# --- joins --------------------------------------------------------------------------------

EVENTS = "(SELECT event_id, MIN(observed_start_date) AS event_start_date, MAX(observed_end_date) AS event_end_date FROM v_labels WHERE observed_start_date IS NOT NULL GROUP BY event_id)"


@query("j1_join_event_rain", "v_labels", "v_rain", sql=f"""
SELECT e.event_id, e.event_start_date, {near('r.mean_precipitation_mm')} AS mean_mm FROM {EVENTS} e LEFT JOIN v_rain r ON r.observed_date = e.event_start_date""")
def j1(v):
    j = J.join_event_rain(A.event_bounds(v.v_labels), v.v_rain, "left")
    return nudged(j.select("event_id", "event_start_date", F.col("mean_precipitation_mm").alias("mean_mm")), mean_mm=6)


@query("j2_event_cell_product", "v_labels", "v_cells", sql=f"""
SELECT e.event_id, COUNT(*) AS cells, CAST(SUM(c.cell_id) AS BIGINT) AS ids FROM {EVENTS} e CROSS JOIN v_cells c GROUP BY e.event_id""")
def j2(v):
    p = J.event_cell_product(A.event_bounds(v.v_labels), v.v_cells.select("cell_id"))
    return p.groupBy("event_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("cell_id").alias("ids"))


@query("j3_with_default_zero", "v_cells", "v_predictions", sql="""
SELECT cell_id, COALESCE(flooded_fraction, 0) AS flooded_fraction FROM v_cells LEFT JOIN (SELECT * FROM v_predictions WHERE model_version = 'm1') p USING (cell_id)""")
def j3(v):
    facts = v.v_predictions.where("model_version = 'm1'").select("cell_id", "flooded_fraction")
    return J.with_default_zero(v.v_cells.select("cell_id"), facts, ["flooded_fraction"])


MEET = "c.xmin <= f.xmax AND c.xmax >= f.xmin AND c.ymin <= f.ymax AND c.ymax >= f.ymin"


@query("j4_left_spatial_join", "v_cells", "v_labels", sql=f"""
SELECT c.cell_id, COUNT(f.extent_id) AS extents, MAX(f.event_count) AS event_count FROM v_cells c
LEFT JOIN v_labels f ON f.source_key LIKE 'demo:gfd:frequency:%' AND {MEET} GROUP BY c.cell_id""")
def j4(v):
    e = spatial.with_box(v.v_labels).select("extent_id", "source_key", "event_count", "bbox")
    j = spatial.left_spatial_join(spatial.with_box(v.v_cells).select("cell_id", "bbox"), e, "demo:gfd:frequency:")
    return j.groupBy("cell_id").agg(F.count("extent_id").alias("extents"), F.max("event_count").alias("event_count"))


# the lower left half of each label box
TRIANGLE = f"{MEET} AND (GREATEST(c.xmin, f.xmin) - f.xmin) / (f.xmax - f.xmin) + (GREATEST(c.ymin, f.ymin) - f.ymin) / (f.ymax - f.ymin) <= 1"


def triangles(df):
    def p(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmin", "ymax"), p("xmin", "ymin"))
    return df.withColumn("geometry", geo.geometry(F.lit("Polygon"), F.array(ring), F.array(F.lit(0)), F.array(F.lit(False))))


@query("j4_left_outline_join", "v_cells", "v_labels", sql=f"""
SELECT c.cell_id, COUNT(f.extent_id) AS extents, MAX(f.event_count) AS event_count FROM v_cells c
LEFT JOIN v_labels f ON f.source_key LIKE 'demo:gfd:frequency:%' AND {TRIANGLE} GROUP BY c.cell_id""")
def j4_outline(v):
    e = triangles(v.v_labels).select("extent_id", "source_key", "event_count", "geometry")
    j = spatial.left_spatial_join(spatial.with_box(v.v_cells).select("cell_id", "bbox"), e, "demo:gfd:frequency:")
    return j.groupBy("cell_id").agg(F.count("extent_id").alias("extents"), F.max("event_count").alias("event_count"))


@query("a10_event_cells", "v_cells", "v_labels", sql=f"""
SELECT f.event_id, COUNT(DISTINCT c.cell_id) AS cells, CAST(SUM(DISTINCT c.cell_id) AS BIGINT) AS ids FROM v_cells c JOIN v_labels f ON {TRIANGLE} GROUP BY f.event_id""")
def a10(v):
    pieces = outlines.outline(triangles(v.v_labels), ["event_id"])
    met = outlines.meeting(spatial.with_box(v.v_cells), pieces, ["event_id"])
    return met.groupBy("event_id").agg(F.count("cell_id").alias("cells"), F.sum("cell_id").alias("ids"))


@query("j5_spatial_join", "v_cells", "v_labels", sql=f"SELECT c.cell_id, f.extent_id FROM v_cells c JOIN v_labels f ON {MEET}")
def j5(v):
    c = v.v_cells.select("cell_id", geo.box("xmin", "ymin", "xmax", "ymax").alias("geometry"))
    e = v.v_labels.select("extent_id", geo.box("xmin", "ymin", "xmax", "ymax").alias("right_geometry"))
    return spatial.spatial_join(c, e).select("cell_id", "extent_id")


@query("j6_pixel_cell_join", "v_cells", "v_pixels", sql="""
SELECT c.cell_id, COUNT(*) AS pixels, ROUND(SUM(value), 6) AS total FROM v_pixels p JOIN v_cells c ON FLOOR(p.px_col / 5) = c.grid_i AND FLOOR(p.px_row / 5) = c.grid_j GROUP BY c.cell_id""")
def j6(v):
    p = v.v_pixels.drop("cell_id").withColumns({"grid_i": F.floor(F.col("px_col") / 5).cast("int"), "grid_j": F.floor(F.col("px_row") / 5).cast("int")})
    j = raster.pixel_cell_join(v.v_cells.select("cell_id", "grid_i", "grid_j"), p)
    return rounded(j.groupBy("cell_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("value").alias("total")), total=6)


@query("j7_explode_grid", "v_labels", sql="""
SELECT extent_id, i, j FROM (SELECT extent_id, unnest(range(CAST(FLOOR(xmin / 0.005e0) AS BIGINT), CAST(FLOOR(xmax / 0.005e0) AS BIGINT) + 1)) AS i, ymin, ymax FROM v_labels) q,
  LATERAL (SELECT unnest(range(CAST(FLOOR(q.ymin / 0.005e0) AS BIGINT), CAST(FLOOR(q.ymax / 0.005e0) AS BIGINT) + 1)) AS j) r""")
def j7(v):
    def index(c):
        return F.floor(F.col(c) / 0.005).cast("bigint")

    return J.explode_grid(v.v_labels, (index("xmin"), index("xmax")), (index("ymin"), index("ymax"))).select("extent_id", "i", "j")


@query("j9_semi_by_id", "v_cells", "v_predictions", sql="SELECT cell_id FROM v_cells WHERE cell_id IN (SELECT cell_id FROM v_predictions WHERE probability > 0.8e0)")
def j9(v):
    return J.semi_by_id(v.v_cells, v.v_predictions.where("probability > 0.8"), "cell_id").select("cell_id")


@query("j10_latest_per_key", "v_observations", sql="""
SELECT station_id, observation_id, observed_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY observed_at DESC, observation_id DESC) AS n FROM v_observations) WHERE n = 1""")
def j10(v):
    return J.latest_per_key(v.v_observations.select("station_id", "observation_id", "observed_at"), "station_id", "observed_at", "observation_id")


@query("j11_pair_labels", "v_scores", sql="""
WITH s AS (SELECT event_id, row_key // 10 AS cell_id, probability FROM v_scores)
SELECT g.event_id AS reference_event_id, t.event_id AS sar_event_id, COUNT(*) AS cells, ROUND(SUM(ABS(g.probability - t.probability)), 4) AS delta
FROM s g JOIN s t ON g.cell_id = t.cell_id AND CAST(SUBSTR(t.event_id, 2) AS INT) = CAST(SUBSTR(g.event_id, 2) AS INT) + 1 GROUP BY 1, 2""")
def j11(v):
    s = v.v_scores.select("event_id", F.floor(F.col("row_key") / 10).alias("cell_id"), "probability")
    ids = s.select("event_id").distinct()
    following = F.concat(F.lit("E"), F.substring("event_id", 2, 9).cast("int") + 1)
    mapping = ids.select(F.col("event_id").alias("reference_event_id"), following.alias("sar_event_id"))
    p = J.pair_labels(s, s, mapping)
    return rounded(
        p.groupBy("reference_event_id", "sar_event_id").agg(
            F.count(F.lit(1)).alias("cells"), F.sum(F.abs(F.col("gfd_probability") - F.col("sar_probability"))).alias("delta")
        ), delta=4)


@query("j12_attach_by_id", "v_cells", "v_predictions", sql="""
SELECT c.cell_id, a.probability AS first_p, b.flooded_fraction AS second_f FROM v_cells c LEFT JOIN (SELECT * FROM v_predictions WHERE model_version = 'm1') a USING (cell_id)
LEFT JOIN (SELECT * FROM v_predictions WHERE model_version = 'm2') b USING (cell_id)""")
def j12(v):
    one = {m: v.v_predictions.where(F.col("model_version") == m) for m in ("m1", "m2")}
    j = J.attach_by_id(v.v_cells.select("cell_id"), {"a": one["m1"], "b": one["m2"]})
    return j.select("cell_id", F.col("a.probability").alias("first_p"), F.col("b.flooded_fraction").alias("second_f"))


@query("j13_has_sar", "v_labels", sql="""
SELECT event_id, event_id IN (SELECT event_id FROM v_labels WHERE source_key LIKE 'demo:sar:event:%' AND event_count = 1) AS sar_detected FROM v_labels GROUP BY event_id""")
def j13(v):
    return J.has_sar(v.v_labels.select("event_id").distinct(), v.v_labels.where("event_count = 1"), "demo").select("event_id", "sar_detected")


@query("j14_merge_properties", "v_cells", "v_predictions", sql="""
SELECT cell_id, CAST(grid_i AS VARCHAR) AS grid_i, CAST(p.historical_event_count AS VARCHAR) AS events FROM v_cells LEFT JOIN (SELECT * FROM v_predictions WHERE model_version = 'm1') p USING (cell_id)""")
def j14(v):
    base = v.v_cells.select("cell_id", F.create_map(F.lit("grid_i"), F.col("grid_i").cast("string")).alias("properties"))
    s = v.v_predictions.where("model_version = 'm1'").select("cell_id", F.col("historical_event_count").alias("events"))
    m = J.merge_properties(base, s)
    return m.select("cell_id", F.try_element_at("properties", F.lit("grid_i")).alias("grid_i"), F.try_element_at("properties", F.lit("events")).alias("events"))


@query("j15_enrich_stations", "v_readings", "v_stations", sql="SELECT r.message_id, s.name FROM v_readings r JOIN v_stations s ON r.station_id = s.station_id WHERE s.status = 'active'")
def j15(v):
    return J.enrich_stations(v.v_readings, v.v_stations.where("status = 'active'")).select("message_id", "name")


@query("j15_unknown_stations", "v_readings", "v_stations", sql="SELECT message_id FROM v_readings WHERE station_id NOT IN (SELECT station_id FROM v_stations WHERE status = 'active')")
def j15_unknown(v):
    return J.unknown_stations(v.v_readings, v.v_stations.where("status = 'active'")).select("message_id")


@query("j16_new_only", "v_readings", sql="SELECT message_id FROM v_readings WHERE NOT (message_id % 5 < 2)")
def j16(v):
    return J.new_only(v.v_readings, v.v_readings.where("message_id % 5 < 2"), "message_id").select("message_id")


@query("j17_with_total", "v_pixels", sql="""
SELECT cell_id, class_code, n, CAST(SUM(n) OVER (PARTITION BY cell_id) AS BIGINT) AS total FROM (SELECT cell_id, class_code, COUNT(*) AS n FROM v_pixels GROUP BY 1, 2)""")
def j17(v):
    return J.with_total(v.v_pixels.groupBy("cell_id", "class_code").agg(F.count(F.lit(1)).alias("n")), ["cell_id"], "n")


# --- aggregates ---------------------------------------------------------------------------


@query("a1_extent_summary", "v_labels", sql="""
SELECT COUNT(*) AS total_features, COUNT(DISTINCT COALESCE(event_id, event_name)) AS event_count, ROUND(SUM(area_km2), 4) AS total_area_km2,
  MIN(observed_date) AS observed_from, MAX(observed_date) AS observed_to, COUNT(*) FILTER (WHERE field_validated) AS field_validated_features FROM v_labels""")
def a1(v):
    return rounded(A.extent_summary(v.v_labels), total_area_km2=4)


@query("a2_quality_counts", "v_layers", sql="""
SELECT k.quality_status, COUNT(l.layer_id) AS count FROM (SELECT unnest(['verified', 'limited', 'unreviewed', 'deprecated']) AS quality_status) k
LEFT JOIN v_layers l USING (quality_status) GROUP BY k.quality_status""")
def a2(v):
    return A.quality_counts(v.v_layers)


@query("a3_band_summary", "v_scores", sql=f"""
SELECT event_id, COUNT(*) AS total_cells, ROUND(AVG(probability), 6) AS mean_probability, COUNT(*) FILTER (WHERE b = 'LOW') AS low_cells, COUNT(*) FILTER (WHERE b = 'MODERATE') AS moderate_cells,
  COUNT(*) FILTER (WHERE b = 'HIGH') AS high_cells, COUNT(*) FILTER (WHERE b = 'VERY_HIGH') AS very_high_cells FROM (SELECT *, {BAND} AS b FROM v_scores) GROUP BY event_id""")
def a3(v):
    s = A.band_summary(v.v_scores.withColumn("risk_band", S.risk_band("probability")), keys=["event_id"])
    return rounded(s, mean_probability=6)


@query("a4_event_summary", "v_event_predictions", sql="""
SELECT event_id, event_start_date, split, COUNT(*) AS total_cells, COUNT(*) FILTER (WHERE flooded_fraction >= 0.1e0) AS observed_positive_cells FROM v_event_predictions GROUP BY 1, 2, 3""")
def a4(v):
    return A.event_summary(v.v_event_predictions, 0.1)


@query("a5_mean_probability", "v_predictions", sql="SELECT model_version, ROUND(AVG(probability), 6) AS mean_probability FROM v_predictions GROUP BY 1")
def a5(v):
    return rounded(A.mean_probability(v.v_predictions, ["model_version"]), mean_probability=6)


@query("a6_confusion", "v_scores", sql="""
SELECT event_id, tp, fp, fn, tn, ROUND(CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE 0 END, 6) AS precision, ROUND(CASE WHEN tp + fn > 0 THEN tp * 1e0 / (tp + fn) ELSE 0 END, 6) AS recall
FROM (SELECT event_id, COUNT(*) FILTER (WHERE probability >= 0.6e0 AND label = 1) AS tp, COUNT(*) FILTER (WHERE probability >= 0.6e0 AND label = 0) AS fp,
  COUNT(*) FILTER (WHERE probability < 0.6e0 AND label = 1) AS fn, COUNT(*) FILTER (WHERE probability < 0.6e0 AND label = 0) AS tn FROM v_scores GROUP BY event_id)""")
def a6(v):
    s = v.v_scores.withColumns({"predicted": F.col("probability") >= 0.6, "observed": F.col("label") == 1})
    return rounded(A.confusion(s, ["event_id"]), precision=6, recall=6)


CLASSES = "SELECT cell_id, land_cover_pixel_count AS px, unnest([40, 50, 80, 90]) AS class_code, unnest([lc_cropland, lc_built, lc_water, lc_wetland]) AS share FROM v_cells"


def _with_shares(v):
    shares = F.create_map(F.lit(40), F.col("lc_cropland"), F.lit(50), F.col("lc_built"), F.lit(80), F.col("lc_water"), F.lit(90), F.col("lc_wetland"))
    return v.v_cells.withColumn("land_cover_percentages", shares)


@query("a7_land_cover_summary", "v_cells", sql=f"""
WITH k AS (SELECT class_code, CAST(SUM(CAST(round_even(px * share / 100, 0) AS BIGINT)) AS BIGINT) AS pixel_count FROM ({CLASSES}) GROUP BY class_code)
SELECT class_code, pixel_count, ROUND(pixel_count * 100e0 / SUM(pixel_count) OVER (), 6) AS percentage FROM k""")
def a7(v):
    return rounded(A.land_cover_summary(_with_shares(v)), percentage=6).select("class_code", "pixel_count", "percentage")


@query("a8_class_shares", "v_pixels", sql="SELECT class_code, n AS pixel_count, ROUND(n * 100e0 / SUM(n) OVER (), 6) AS percentage FROM (SELECT class_code, COUNT(*) AS n FROM v_pixels GROUP BY 1)")
def a8(v):
    return rounded(A.class_shares(raster.class_counts(v.v_pixels)), percentage=6)


@query("a9_event_bounds", "v_labels", sql=f"SELECT * FROM {EVENTS}")
def a9(v):
    return A.event_bounds(v.v_labels)


@query("a12_historical_count", "v_cells", "v_labels", sql=f"""
SELECT c.cell_id, COALESCE(MAX(f.event_count), 0) AS historical_event_count FROM v_cells c LEFT JOIN v_labels f ON f.source_key LIKE 'demo:gfd:frequency:%' AND {MEET} GROUP BY c.cell_id""")
def a12(v):
    return spatial.historical_count(spatial.with_box(v.v_cells), spatial.with_box(v.v_labels), "demo:gfd:frequency:")


@query("a12_outline_count", "v_cells", "v_labels", sql=f"""
SELECT c.cell_id, COALESCE(MAX(f.event_count), 0) AS historical_event_count FROM v_cells c LEFT JOIN v_labels f ON f.source_key LIKE 'demo:gfd:frequency:%' AND {TRIANGLE} GROUP BY c.cell_id""")
def a12_outline(v):
    return spatial.historical_count(spatial.with_box(v.v_cells), triangles(v.v_labels), "demo:gfd:frequency:")


@query("a13_grid_summary", "v_cells", sql="""
SELECT COUNT(*) AS cell_count, MIN(elevation_mean_m) AS min_elevation_mean_m, MAX(elevation_mean_m) AS max_elevation_mean_m, ROUND(AVG(elevation_mean_m), 6) AS mean_elevation_mean_m,
  MIN(hand_mean_m) AS min_hand_mean_m, MAX(hand_mean_m) AS max_hand_mean_m, ROUND(AVG(hand_mean_m), 6) AS mean_hand_mean_m FROM v_cells""")
def a13(v):
    return rounded(A.grid_summary(v.v_cells, ["elevation_mean_m", "hand_mean_m"]), mean_elevation_mean_m=6, mean_hand_mean_m=6)


@query("a13_hand_summary", "v_cells", sql="""
SELECT COUNT(*) AS cell_count, MIN(hand_mean_m) AS min_hand_m, MAX(hand_mean_m) AS max_hand_m, ROUND(AVG(hand_mean_m), 6) AS mean_hand_m FROM v_cells WHERE hand_mean_m BETWEEN 0 AND 5000""")
def a13_hand(v):
    c = v.v_cells.withColumns({"hand_min_m": F.col("hand_mean_m"), "hand_max_m": F.col("hand_mean_m")})
    return rounded(A.hand_summary(c), mean_hand_m=6)


@query("a17_count_label_events", "v_labels", sql="SELECT COUNT(DISTINCT event_id) AS event_count FROM v_labels WHERE source_key LIKE 'demo:sar:event:%' AND observed_start_date IS NOT NULL")
def a17(v):
    return A.count_label_events(v.v_labels, "sar", "demo")


@query("a18_network_totals", "v_cells", "v_segments", sql=f"""
SELECT SUM(segment_length_m) / 1000 AS total_length_km, COUNT(*) FILTER (WHERE asset_type = 'river_segment') AS river_segments,
  COUNT(*) FILTER (WHERE asset_type = 'canal_segment') AS canal_segments, MIN(elevation_min_m) AS terrain_min_m, MAX(elevation_max_m) AS terrain_max_m FROM ({ASSETS})""")
def a18(v):
    return A.network_totals(assets(v))


@query("a19_exposure", "v_cells", "v_predictions", sql="""
WITH f AS (SELECT cell_id FROM v_predictions WHERE probability >= 0.5e0),
b AS (SELECT LEAST(1e0, CASE WHEN lc_built > 1 THEN lc_built / 100e0 ELSE lc_built END) * 0.25e0 AS km2 FROM v_cells JOIN f USING (cell_id))
SELECT (SELECT COUNT(*) FROM f) AS flagged_cells, (SELECT COUNT(*) FROM f) * 0.25e0 AS affected_area_km2,
  CAST(SUM(CASE WHEN km2 > 0 THEN GREATEST(1, CAST(round_even(km2 * 450, 0) AS BIGINT)) ELSE 0 END) AS BIGINT) AS buildings_at_risk,
  ROUND(SUM(km2), 6) AS built_up_area_km2, (SELECT COUNT(*) FROM v_predictions WHERE probability >= 0.7e0) AS high_risk_cells,
  'historical_ml_susceptibility' AS risk_basis FROM b""")
def a19(v):
    p = v.v_predictions.withColumns({"risk_band": S.risk_band("probability"), "predicted_label": F.col("probability") >= 0.5})
    cells = v.v_cells.withColumn("built_fraction", S.as_fraction("lc_built"))
    return rounded(A.exposure(p, cells, 0.7), built_up_area_km2=6)


@query("a20_split_counts", "v_event_predictions", sql="SELECT split, COUNT(*) AS rows FROM v_event_predictions GROUP BY split")
def a20(v):
    return A.split_counts(v.v_event_predictions)


@query("a21_station_roster", "v_stations", "v_readings", sql="""
SELECT COALESCE(s.station_id, r.station_id) AS station_id, COALESCE(s.name, 'seen ' || CAST(r.station_id AS VARCHAR)) AS name
FROM (SELECT * FROM v_stations WHERE status <> 'offline') s FULL JOIN (SELECT DISTINCT station_id FROM v_readings) r ON s.station_id = r.station_id""")
def a21(v):
    seen = v.v_readings.withColumn("station_name", F.concat(F.lit("seen "), F.col("station_id")))
    return A.station_roster(v.v_stations.where("status <> 'offline'"), seen)


@query("a22_sar_reference", "v_labels", sql="""
SELECT reference_event_id, sar_event_id FROM (SELECT reference_event_id, event_id AS sar_event_id, ROW_NUMBER() OVER (PARTITION BY reference_event_id ORDER BY source_key DESC) AS n
FROM v_labels WHERE source_key LIKE 'demo:sar:event:%' AND reference_event_id IS NOT NULL) WHERE n = 1""")
def a22(v):
    return A.sar_reference(v.v_labels, "demo")


@query("a23_area_totals", "v_scores", sql="""
SELECT event_id, COUNT(*) FILTER (WHERE probability >= 0.6e0) * 0.25e0 AS predicted_area_km2, COUNT(*) FILTER (WHERE label = 1) * 0.25e0 AS observed_area_km2 FROM v_scores GROUP BY event_id""")
def a23(v):
    s = v.v_scores.withColumns({"predicted": F.col("probability") >= 0.6, "observed": F.col("label") == 1})
    return A.area_totals(s, ["event_id"])


# --- windows ------------------------------------------------------------------------------


@query("w1_elevation_percentile", "v_cells", sql="SELECT cell_id, ROUND(PERCENT_RANK() OVER (ORDER BY elevation_mean_m) * 100, 6) AS elevation_percentile FROM v_cells")
def w1(v):
    p = ranking.with_percentile(v.v_cells.select("cell_id", "elevation_mean_m"), "elevation_mean_m", name="elevation_percentile")
    return rounded(p, elevation_percentile=6).select("cell_id", "elevation_percentile")


@query("w2_percentiles", "v_cells", sql="""
SELECT cell_id, ROUND(PERCENT_RANK() OVER (PARTITION BY lc_wetland ORDER BY distance_to_waterway_m) * 100, 6) AS d, ROUND(PERCENT_RANK() OVER (PARTITION BY lc_wetland ORDER BY local_relief_m) * 100, 6) AS r FROM v_cells""")
def w2(v):
    c = v.v_cells.select("cell_id", "lc_wetland", "distance_to_waterway_m", "local_relief_m")
    p = ranking.with_percentile(ranking.with_percentile(c, "distance_to_waterway_m", ["lc_wetland"], "d"), "local_relief_m", ["lc_wetland"], "r")
    return rounded(p, d=6, r=6).select("cell_id", "d", "r")


@query("w6_latest_observations", "v_observations", sql="""
SELECT station_id, observation_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY observed_at DESC, observation_id DESC) AS n FROM v_observations)
WHERE n = 1 ORDER BY observed_at DESC, observation_id DESC LIMIT 20""")
def w6(v):
    return P.latest_observations(v.v_observations, 20).select("station_id", "observation_id")


@query("w7_dominant_class", "v_pixels", sql="""
SELECT cell_id, class_code AS land_cover_dominant_code FROM (SELECT cell_id, class_code, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY COUNT(*) DESC, class_code) AS n FROM v_pixels GROUP BY 1, 2) WHERE n = 1""")
def w7(v):
    return raster.dominant_class(raster.class_counts(v.v_pixels))


@query("w7_dominant_from_map", "v_cells", sql="""
SELECT cell_id, CASE WHEN cell_id % 3 = 0 THEN 10 WHEN lc_cropland >= lc_built AND lc_cropland >= lc_water THEN 40 WHEN lc_built >= lc_water THEN 50 ELSE 80 END AS code FROM v_cells""")
def w7_map(v):
    shares = F.create_map(F.lit(40), F.col("lc_cropland"), F.lit(50), F.col("lc_built"), F.lit(80), F.col("lc_water"))
    c = v.v_cells.withColumns({"shares": shares, "stored": F.when(F.col("cell_id") % 3 == 0, 10)})
    return c.select("cell_id", raster.dominant_from_map("stored", "shares").alias("code"))


@query("w9_tie_ranks", "v_scores", sql="""
SELECT event_id, probability, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(r), 3) AS mean_rank FROM (SELECT event_id, probability, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY probability) AS r FROM v_scores) GROUP BY 1, 2""")
def w9(v):
    r = ranking.value_ranks(v.v_scores, "probability", ["event_id"])
    return r.select("event_id", "probability", "n", F.round(F.col("n_before") + (F.col("n") + 1) / 2, 3).alias("mean_rank"))


@query("w10_cumulative_precision", "v_scores", sql="""
SELECT row_key, ROW_NUMBER() OVER w AS row_rank, ROUND(SUM(label) OVER w * 1e0 / ROW_NUMBER() OVER w, 6) AS cumulative_precision FROM v_scores
WINDOW w AS (PARTITION BY event_id ORDER BY probability DESC, row_key ROWS UNBOUNDED PRECEDING)""")
def w10(v):
    c = ranking.cumulative_precision(v.v_scores, "probability", "label", "row_key", ["event_id"])
    return rounded(c.select("row_key", "row_rank", "cumulative_precision"), cumulative_precision=6)


@query("w11_last_levels", "v_readings", sql="""
SELECT message_id, station_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY observed_at DESC, message_id DESC) AS n FROM v_readings WHERE water_level_cm IS NOT NULL) WHERE n <= 48""")
def w11(v):
    return P.last_levels(v.v_readings).select("message_id", "station_id")


@query("w12_with_share", "v_rain", sql="SELECT observed_date, ROUND(mean_precipitation_mm / SUM(mean_precipitation_mm) OVER (), 9) AS share FROM v_rain")
def w12(v):
    return rounded(A.with_share(v.v_rain, "mean_precipitation_mm").select("observed_date", "share"), share=9)


@query("w15_global_max", "v_labels", sql="SELECT extent_id, (SELECT MAX(area_km2) FROM v_labels) AS max_area_km2 FROM v_labels")
def w15(v):
    return A.with_global_max(v.v_labels, "area_km2", "max_area_km2").select("extent_id", "max_area_km2")

