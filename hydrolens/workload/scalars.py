"""F: scalar rules. V: validation rule sets. IO: keyed tables."""

from pyspark.sql import functions as F

from hydrolens.functions import scalars as S
from hydrolens.operators import aggregates as A
from hydrolens.operators import validate as V
from hydrolens.sources.readings import to_observation
from hydrolens.workload.registry import query, r6, rounded



def land_cover_shares():
    """One pattern for the land-cover map that both engines can build from the share columns."""
    return F.create_map(
        F.lit(40), F.col("lc_cropland"), F.lit(50), F.col("lc_built"), F.lit(80), F.col("lc_water"), F.lit(90), F.col("lc_wetland")
    )


def frac(x: str) -> str:
    return f"LEAST(1e0, GREATEST(0e0, CASE WHEN {x} > 1e0 THEN {x} / 100e0 ELSE {x} END))"


WATER3 = f"LEAST(1e0, {frac('lc_water')} + {frac('lc_wetland')} + {frac('0e0')})"


@query("f1_json_double", sql="""
SELECT event_id, COALESCE(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0e0) AS k,
  COALESCE(CAST(json_extract_string(props, '$.missing') AS DOUBLE), value) AS fallback FROM events""")
def f1(v):
    e = v.table("events")
    return e.select("event_id", S.json_double("props", "$.k", 0.0).alias("k"), S.json_double("props", "$.missing", "value").alias("fallback"))


@query("f2_json_merge", "v_cells", sql="""
SELECT cell_id, CAST(grid_i + 1000 AS VARCHAR) AS grid_i, CAST(grid_j AS VARCHAR) AS grid_j, FALSE AS has_dropped, TRUE AS has_added FROM v_cells""")
def f2(v):
    base = F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for x in ("grid_i", "grid_j", "land_cover_pixel_count") for i in (0, 1)])
    patch = F.create_map(F.lit("grid_i"), (F.col("grid_i") + 1000).cast("string"))
    c = v.v_cells.withColumn("p", S.json_drop(S.json_set(S.json_merge(base, patch), "added", F.lit("x")), "land_cover_pixel_count"))
    return c.select(
        "cell_id", F.col("p")["grid_i"].alias("grid_i"), F.col("p")["grid_j"].alias("grid_j"),
        F.map_contains_key("p", F.lit("land_cover_pixel_count")).alias("has_dropped"), S.has_keys("p", "added", "grid_i").alias("has_added"),
    )


@query("f3_class_map", "v_pixels", sql="""
SELECT cell_id, string_agg(CAST(class_code AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY class_code) AS classes
FROM (SELECT cell_id, class_code, COUNT(*) AS n FROM v_pixels GROUP BY 1, 2) GROUP BY cell_id""")
def f3(v):
    counts = v.v_pixels.groupBy("cell_id", "class_code").agg(F.count(F.lit(1)).alias("n"))
    m = counts.groupBy("cell_id").agg(S.class_map("class_code", "n").alias("m"))
    text = F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return m.select("cell_id", F.array_join(text, ",").alias("classes"))


@query("f4_as_fraction", "v_cells", sql=f"SELECT cell_id, {frac('lc_cropland')} AS cropland, {frac('lc_water')} AS water FROM v_cells")
def f4(v):
    return v.v_cells.select("cell_id", S.as_fraction("lc_cropland").alias("cropland"), S.as_fraction("lc_water").alias("water"))


@query("f5_flood_excess", "v_cells", "v_predictions", sql=f"""
SELECT cell_id, ROUND(GREATEST(0e0, flooded_fraction - {WATER3}), 6) AS excess FROM v_cells JOIN v_predictions USING (cell_id)""")
def f5(v):
    j = v.v_cells.join(v.v_predictions, "cell_id")
    return j.select("cell_id", r6(S.flood_excess("flooded_fraction", "lc_water", "lc_wetland", F.lit(0.0))).alias("excess"))


@query("f6_target_label", "v_cells", "v_predictions", sql=f"""
SELECT cell_id, CAST(flooded_fraction >= 0.1e0 AS INT) AS extent_label,
  CAST(GREATEST(0e0, flooded_fraction - {WATER3}) >= 0.1e0 AS INT) AS excess_label FROM v_cells JOIN v_predictions USING (cell_id)""")
def f6(v):
    names = {"water": "lc_water", "wetland": "lc_wetland", "mangrove": F.lit(0.0)}
    j = v.v_cells.join(v.v_predictions, "cell_id")
    return j.select(
        "cell_id", S.target_label(0.1, "flood_extent").alias("extent_label"), S.target_label(0.1, "flood_excess", **names).alias("excess_label")
    )


@query("f7_surface_water", "v_cells", sql="""
SELECT cell_id, LEAST(1e0, GREATEST(0e0, CASE WHEN lc_water + lc_wetland > 1 THEN (lc_water + lc_wetland) / 100e0 ELSE lc_water + lc_wetland END)) AS water,
  LEAST(1e0, GREATEST(0e0, CASE WHEN lc_built > 1 THEN lc_built / 100e0 ELSE lc_built END)) AS built FROM v_cells""")
def f7(v):
    return v.v_cells.select("cell_id", S.surface_water(land_cover_shares()).alias("water"), S.built_up(land_cover_shares()).alias("built"))


@query("f8_temper", "v_scores", sql="""
SELECT row_key, ROUND(LEAST(1e0, GREATEST(0e0, probability * (1e0 - 0.5e0 * LEAST(1e0, GREATEST(0e0, surface_water))))), 6) AS tempered FROM v_scores""")
def f8(v):
    return v.v_scores.select("row_key", r6(S.temper("probability", "surface_water", F.lit(0.5))).alias("tempered"))


@query("f9_sigmoid", "v_cells", sql="""
SELECT cell_id, ROUND(1e0 / (1e0 + EXP(-LEAST(35e0, GREATEST(-35e0, elevation_mean_m * 10e0 - 90e0)))), 6) AS p FROM v_cells""")
def f9(v):
    return v.v_cells.select("cell_id", r6(S.sigmoid(F.col("elevation_mean_m") * 10.0 - 90.0)).alias("p"))


@query("f10_risk_band", "v_scores", sql="""
SELECT row_key, CASE WHEN probability < 0.25e0 THEN 'LOW' WHEN probability < 0.5e0 THEN 'MODERATE' WHEN probability < 0.75e0 THEN 'HIGH' ELSE 'VERY_HIGH' END AS risk_band FROM v_scores""")
def f10(v):
    return v.v_scores.select("row_key", S.risk_band("probability").alias("risk_band"))


@query("f11_screening_band", "v_scores", sql="""
SELECT row_key, CASE WHEN probability * 100e0 >= 75 THEN 'VERY_HIGH' WHEN probability * 100e0 >= 50 THEN 'HIGH' WHEN probability * 100e0 >= 25 THEN 'MODERATE' ELSE 'LOWER' END AS band FROM v_scores""")
def f11(v):
    return v.v_scores.select("row_key", S.screening_band(F.col("probability") * 100.0).alias("band"))


def rexact(x: str, n: int) -> str:
    return f"CAST(printf('%.{n}f', {x}) AS DOUBLE)"


@query("f12_screening", "v_cells", sql=f"""
WITH c AS (SELECT cell_id, {rexact('LEAST(100e0, GREATEST(0e0, 100e0 - lc_cropland)) * 0.55e0', 1)} AS a,
  {rexact('LEAST(100e0, GREATEST(0e0, 100e0 - lc_built * 5e0)) * 0.3e0', 1)} AS b,
  {rexact('LEAST(100e0, GREATEST(0e0, 100e0 - elevation_mean_m)) * 0.15e0', 1)} AS c FROM v_cells)
SELECT cell_id, a, b, c, {rexact('a + b + c', 1)} AS score FROM c""")
def f12(v):
    s = v.v_cells.withColumn("s", S.screening("lc_cropland", F.col("lc_built") * 5.0, "elevation_mean_m"))
    return s.select(
        "cell_id", F.col("s.low_elevation_contribution").alias("a"), F.col("s.waterway_proximity_contribution").alias("b"),
        F.col("s.flatness_contribution").alias("c"), F.col("s.score").alias("score"),
    )


LEVEL = """CASE WHEN r.water_level_cm IS NULL OR s.warning_level_cm IS NULL OR s.danger_level_cm IS NULL OR s.critical_level_cm IS NULL THEN 'UNAVAILABLE'
  WHEN r.water_level_cm >= s.critical_level_cm THEN 'CRITICAL' WHEN r.water_level_cm >= s.danger_level_cm THEN 'HIGH'
  WHEN r.water_level_cm >= s.warning_level_cm THEN 'MEDIUM' ELSE 'LOW' END"""
CROSSED = """CASE WHEN r.water_level_cm >= s.critical_level_cm THEN s.critical_level_cm WHEN r.water_level_cm >= s.danger_level_cm THEN s.danger_level_cm
  WHEN r.water_level_cm >= s.warning_level_cm THEN s.warning_level_cm END"""


@query("f13_classify_level", "v_readings", "v_stations", sql=f"""
SELECT r.message_id, {LEVEL} AS risk_level, {CROSSED} AS threshold_cm FROM v_readings r JOIN v_stations s ON r.station_id = s.station_id""")
def f13(v):
    j = v.v_readings.join(v.v_stations, "station_id")
    a = S.classify_level("water_level_cm", "warning_level_cm", "danger_level_cm", "critical_level_cm")
    return j.withColumn("a", a).select("message_id", "a.risk_level", "a.threshold_cm")


@query("f14_early_warning", "v_scores", sql="""
SELECT row_key, probability, CASE WHEN probability < 0.25e0 THEN 'LOW' WHEN probability < 0.5e0 THEN 'MODERATE' WHEN probability < 0.75e0 THEN 'HIGH' ELSE 'CRITICAL' END AS level FROM v_scores""")
def f14(v):
    return v.v_scores.withColumn("w", S.early_warning("probability")).select("row_key", "w.probability", "w.level")


@query("f15_scenario", "v_scores", sql="""
SELECT row_key, CASE WHEN probability >= 0.5e0 AND label = 1 THEN 'confirmed_high_risk' WHEN probability >= 0.5e0 THEN 'high_predicted_risk'
  WHEN label = 1 THEN 'observed_flood_alert' ELSE 'low_risk' END AS scenario FROM v_scores""")
def f15(v):
    return v.v_scores.withColumn("s", S.scenario("probability", F.col("label") == 1)).select("row_key", "s.scenario")


@query("f16_outcome", "v_scores", sql="""
SELECT row_key, CASE WHEN probability >= 0.6e0 AND label = 1 THEN 'tp' WHEN probability >= 0.6e0 THEN 'fp' WHEN label = 1 THEN 'fn' ELSE 'tn' END AS outcome FROM v_scores""")
def f16(v):
    return v.v_scores.select("row_key", S.outcome(F.col("probability") >= 0.6, F.col("label") == 1).alias("outcome"))


@query("f17_recommendation", "v_scores", sql="""
WITH m AS (SELECT event_id, AVG(probability) AS p, AVG(label) AS r, AVG(surface_water) AS rp FROM v_scores GROUP BY event_id)
SELECT event_id, CASE WHEN p < 0.2e0 THEN 'Keep' WHEN p < 0.35e0 OR rp < 0.25e0 THEN 'Pilot' WHEN r < 0.25e0 THEN 'Precision' ELSE 'Discrimination' END AS advice FROM m""")
def f17(v):
    m = v.v_scores.groupBy("event_id").agg(F.avg("probability").alias("p"), F.avg("label").alias("r"), F.avg("surface_water").alias("rp"))
    return m.select("event_id", F.regexp_extract(S.recommendation("p", "r", "rp"), "^[A-Za-z]+", 0).alias("advice"))


KEY_SQL = "sha256(CONCAT_WS('|', CAST(r.station_id AS VARCHAR), strftime(r.observed_at, '%Y-%m-%dT%H:%M:%S.%f'), TRIM(r.source)))"


@query("f18_ingestion_key", "v_readings", sql=f"SELECT r.message_id, {KEY_SQL} AS ingestion_key FROM v_readings r")
def f18(v):
    return v.v_readings.select("message_id", S.ingestion_key("station_id", "observed_at", "source").alias("ingestion_key"))


BLOCK_SQL = "CAST(FLOOR(xmin / 0.04e0) AS BIGINT) || ':' || CAST(FLOOR(ymin / 0.04e0) AS BIGINT)"
BUCKET_SQL = f"CAST(CAST('0x' || SUBSTR(sha256({BLOCK_SQL}), 1, 8) AS BIGINT) % 10 AS INT)"


@query("f19_spatial_bucket", "v_cells", sql=f"SELECT cell_id, {BUCKET_SQL} AS bucket FROM v_cells")
def f19(v):
    return v.v_cells.select("cell_id", S.spatial_bucket("xmin", "ymin").alias("bucket"))


@query("f20_key_parts", "v_labels", sql="""
SELECT extent_id, NULLIF(regexp_replace(regexp_replace(event_name, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS suffix,
  CASE WHEN source_key LIKE 'demo:sar:%' THEN SUBSTR(source_key, 10) ELSE source_key END AS bare,
  CASE WHEN source_key LIKE 'demo:%:event:%' THEN SUBSTR(source_key, 6, 3) END AS captured FROM v_labels""")
def f20(v):
    topic = F.substring_index(F.translate("source_key", ":", "/"), "/", 3)
    return v.v_labels.select(
        "extent_id", S.key_suffix("event_name").alias("suffix"), S.strip_prefix("source_key", "demo:sar:").alias("bare"),
        S.topic_station("demo/+/event", topic).alias("captured"),
    )


@query("f21_normalize_sar", "v_labels", sql="""
SELECT extent_id, CASE WHEN extent_id % 2 = 0 THEN 'VH' ELSE 'VV' END AS polarization, '21' AS window_days,
  CASE WHEN extent_id % 3 = 0 THEN 'true' ELSE 'false' END AS water_excluded FROM v_labels""")
def f21(v):
    i = F.col("extent_id")
    p = F.when(i % 2 == 0, F.create_map(F.lit("polarization"), F.lit("VH"))).otherwise(F.create_map(F.lit("sar_polarization"), F.lit("VV")))
    p = F.when(i % 3 == 0, F.map_concat(p, F.create_map(F.lit("permanent_water_excluded"), F.lit("true")))).otherwise(p)
    n = v.v_labels.withColumn("n", S.normalize_sar(p))
    return n.select(
        "extent_id", F.col("n")["sar_polarization"].alias("polarization"), F.col("n")["baseline_window_days"].alias("window_days"),
        F.col("n")["permanent_water_excluded"].alias("water_excluded"),
    )


@query("f22_parse_iso_date", "v_labels", sql="""
SELECT extent_id, CASE WHEN extent_id % 4 = 0 THEN NULL ELSE observed_date END AS parsed FROM v_labels""")
def f22(v):
    text = F.when(F.col("extent_id") % 4 == 0, F.date_format("observed_date", "yyyy/MM/dd")).otherwise(F.col("observed_date").cast("string"))
    return v.v_labels.select("extent_id", S.parse_iso_date(text).alias("parsed"))


@query("f23_relief", "v_cells", sql="""
SELECT cell_id, ROUND(elevation_max_m - elevation_min_m, 6) AS relief, ROUND(DEGREES(ATAN((elevation_max_m - elevation_min_m) / 500e0)), 6) AS angle FROM v_cells""")
def f23(v):
    return v.v_cells.select(
        "cell_id", r6(S.relief("elevation_min_m", "elevation_max_m")).alias("relief"),
        r6(S.relief_angle("elevation_min_m", "elevation_max_m", F.lit(500.0))).alias("angle"),
    )


@query("f24_to_observation", "v_readings", sql=f"""
SELECT {KEY_SQL} AS ingestion_key, r.station_id, r.observed_at, r.rainfall_mm, r.water_level_cm / 100e0 AS water_level_m, 'unverified' AS quality_status FROM v_readings r""")
def f24(v):
    return to_observation(v.v_readings).select("ingestion_key", "station_id", "observed_at", "rainfall_mm", "water_level_m", "quality_status")


@query("f25_alert_message", "v_alerts", "v_stations", sql="""
SELECT alert_id, s.name || ' reported ' || printf('%.1f', a.water_level_cm) || ' cm. ' || a.risk_level AS message
FROM v_alerts a JOIN v_stations s ON a.station_id = s.station_id""")
def f25(v):
    j = v.v_alerts.drop("status").join(v.v_stations, "station_id")
    return j.select("alert_id", S.alert_message("name", "water_level_cm", "risk_level").alias("message"))


@query("f26_class_name", "v_pixels", sql="""
SELECT px_row, px_col, CASE class_code WHEN 10 THEN 'Tree cover' WHEN 40 THEN 'Cropland' WHEN 50 THEN 'Built-up' WHEN 80 THEN 'Permanent water bodies'
  WHEN 90 THEN 'Herbaceous wetland' WHEN 95 THEN 'Mangroves' ELSE 'Unknown' END AS class_name FROM v_pixels""")
def f26(v):
    return v.v_pixels.select("px_row", "px_col", S.class_name("class_code").alias("class_name"))


def pct(x: str) -> str:
    return f"CASE WHEN {x} > 1 THEN {x} / 100e0 ELSE {x} END"


@query("f27_class_columns", "v_cells", sql=f"""
SELECT cell_id, 0e0 AS landcover_tree_pct, {pct('lc_cropland')} AS landcover_cropland_pct, {pct('lc_water')} AS landcover_water_pct FROM v_cells""")
def f27(v):
    c = S.class_columns(land_cover_shares())
    return v.v_cells.select("cell_id", *[c[n].alias(n) for n in ("landcover_tree_pct", "landcover_cropland_pct", "landcover_water_pct")])


@query("f28_area_risk_level", "v_predictions", sql="""
SELECT model_version, CASE WHEN high * 1e0 / total >= 0.12e0 OR flagged >= 400 THEN 'HIGH' WHEN high * 1e0 / total >= 0.04e0 OR flagged >= 80 THEN 'MODERATE' ELSE 'LOW' END AS level
FROM (SELECT model_version, COUNT(*) AS total, COUNT(*) FILTER (WHERE probability >= 0.95e0) AS high, COUNT(*) FILTER (WHERE probability >= 0.99e0) AS flagged FROM v_predictions GROUP BY model_version)""")
def f28(v):
    s = v.v_predictions.groupBy("model_version").agg(
        F.struct(
            F.count(F.lit(1)).alias("total_cells"), F.count_if(F.col("probability") >= 0.95).alias("high_cells"),
            F.count_if(F.col("probability") >= 0.99).alias("flagged_cells"),
        ).alias("f")
    )
    return s.select("model_version", S.area_risk_level(forecast="f").alias("level"))


@query("f29_people_at_risk", "v_cells", "v_predictions", sql="""
SELECT CAST(FLOOR(COALESCE(SUM(lc_built / 100e0 * 0.25e0), 0) * 450 + 0.5e0) AS BIGINT) AS people_at_risk FROM v_cells JOIN v_predictions USING (cell_id) WHERE probability >= 0.5e0""")
def f29(v):
    p = v.v_predictions.withColumn("risk_band", S.risk_band("probability"))
    return A.people_at_risk(v.v_cells, p, use_label=False)


# --- validation ---------------------------------------------------------------------------


def counted(marked, *keys):
    """Violation counts: rows per message, and rows without any."""
    one = F.when(F.size("violations") == 0, F.array(F.lit("ok"))).otherwise(F.col("violations"))
    return marked.select(F.explode(one).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("rows"))


def unpivot(source: str, rules: dict[str, str]) -> str:
    """Oracle twin of ``counted``: each rule as a filtered count, zero counts left out."""
    bad = " OR ".join(f"COALESCE({c}, FALSE)" for c in rules.values())
    parts = [f"SELECT '{m}' AS violation, COUNT(*) AS rows FROM ({source}) WHERE COALESCE({c}, FALSE)" for m, c in rules.items()]
    parts.append(f"SELECT 'ok' AS violation, COUNT(*) AS rows FROM ({source}) WHERE NOT ({bad})")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE rows > 0"


@query("v1_geometry_rules", "v_labels", sql="SELECT extent_id, extent_id % 9 = 0 AS off_range, extent_id % 7 = 0 AS crossing FROM v_labels")
def v1(v):
    from hydrolens.functions import geo
    from hydrolens.operators.polygons import spread

    i = F.col("extent_id")
    shift = F.when(i % 9 == 0, 100.0).otherwise(0.0)
    x0, x1 = F.col("xmin") + shift, F.col("xmax") + shift

    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    y0, y1 = F.col("ymin"), F.col("ymax")
    square = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))
    bow = F.array(p(x0, y0), p(x1, y1), p(x1, y0), p(x0, y1), p(x0, y0))
    g = geo.geometry(F.lit("Polygon"), F.array(F.when(i % 7 == 0, bow).otherwise(square)), F.array(F.lit(0)), F.array(F.lit(False)))
    marked = V.flagged(spread(v.v_labels).withColumn("geometry", g), V.geometry_rules())
    return marked.select(
        "extent_id", F.array_contains("violations", "coordinates must be longitude [-180, 180] and latitude [-90, 90]").alias("off_range"),
        F.array_contains("violations", "geometry intersects itself").alias("crossing"),
    )


@query("v2_required_text", "v_labels", sql=unpivot("SELECT event_name, source_key FROM v_labels", {
    "event_name must not be blank": "event_name IS NULL OR TRIM(event_name) = ''", "source_key is too long": "LENGTH(source_key) > 18"}))
def v2(v):
    return counted(V.flagged(v.v_labels, V.required_text(event_name=255, source_key=18)))


@query("v3_reading_rules", "v_readings", sql=unpivot("SELECT * FROM v_readings", {
    "rainfall_mm out of range": "rainfall_mm < 0 OR rainfall_mm > 5000",
    "water_level_cm out of range": "water_level_cm < -2000 OR water_level_cm > 10000",
    "soil_moisture_percent out of range": "soil_moisture_percent * 1 > 100",
    "waterLevelCm or rainfallMm is required": "water_level_cm IS NULL AND rainfall_mm IS NULL"}))
def v3(v):
    return counted(V.flagged(v.v_readings.withColumn("station_id", F.col("station_id").cast("string")), V.reading_rules()))


@query("v4_topic_rules", "v_readings", sql="SELECT message_id, station_id % 5 = 0 AS mismatch FROM v_readings")
def v4(v):
    r = v.v_readings.withColumn("station_id", F.col("station_id").cast("string"))
    other = F.when(F.col("station_id").cast("bigint") % 5 == 0, F.lit("other")).otherwise(F.col("station_id"))
    topic = F.concat(F.lit("sensors/"), other, F.lit("/readings"))
    marked = V.flagged(r.withColumn("topic_station", S.topic_station("sensors/+/readings", topic)), V.topic_rules())
    return marked.select("message_id", (F.size("violations") > 0).alias("mismatch"))


@query("v5_observation_rules", "v_observations", sql=unpivot("SELECT * FROM v_observations", {
    "a measurement is required": "rainfall_mm IS NULL AND water_level_m IS NULL",
    "water_level_m out of range": "water_level_m < -20 OR water_level_m > 100", "rainfall_mm out of range": "rainfall_mm < 0 OR rainfall_mm > 5000"}))
def v5(v):
    none = F.lit(None).cast("double")
    o = v.v_observations.withColumns({"discharge_m3s": none, "soil_moisture_percent": none, "battery_percent": none})
    return counted(V.flagged(o, V.observation_rules()))


@query("v6_station_rules", "v_stations", sql=unpivot("""SELECT status, CASE WHEN station_id % 8 = 0 THEN NULL ELSE warning_level_cm END AS w, danger_level_cm AS d,
    CASE WHEN station_id % 9 = 0 THEN 100e0 ELSE critical_level_cm END AS c FROM v_stations""", {
    "thresholds must be set together": "NOT ((w IS NULL AND d IS NULL AND c IS NULL) OR (w IS NOT NULL AND d IS NOT NULL AND c IS NOT NULL))",
    "danger_level_cm must be below critical_level_cm": "d >= c", "warning_level_cm must be below danger_level_cm": "w >= d"}))
def v6(v):
    i = F.col("station_id")
    s = v.v_stations.withColumns(
        {
            "warning_level_cm": F.when(i % 8 != 0, F.col("warning_level_cm")),
            "critical_level_cm": F.when(i % 9 == 0, 100.0).otherwise(F.col("critical_level_cm")),
        }
    )
    return counted(V.flagged(s, V.station_rules()))


@query("v7_extent_rules", "v_labels", sql=unpivot("SELECT *, CASE WHEN extent_id % 6 = 1 THEN 'http://x' ELSE 'https://x' END AS url FROM v_labels", {
    "source_url must use https": "NOT starts_with(url, 'https://')", "area_km2 must be positive": "area_km2 <= 0",
    "observed_end_date must not precede the start": "observed_end_date < COALESCE(observed_start_date, observed_date)"}))
def v7(v):
    e = v.v_labels.withColumns(
        {"source_url": F.when(F.col("extent_id") % 6 == 1, "http://x").otherwise("https://x"), "confidence": F.lit("unknown")}
    )
    return counted(V.flagged(e, V.extent_rules(geometry=False)))


@query("v8_layer_rules", "v_layers", sql=unpivot("""SELECT CASE WHEN layer_id % 10 = 0 THEN UPPER(layer_key) ELSE layer_key END AS k, spatial_resolution_m - 5 AS res, quality_status FROM v_layers""", {
    "layer_key has an unsupported form": "NOT regexp_matches(k, '^[a-z0-9][a-z0-9._:-]*$')", "spatial_resolution_m must be positive": "res <= 0"}))
def v8(v):
    day = F.lit(None).cast("timestamp")
    layers = v.v_layers.withColumns(
        {
            "layer_key": F.when(F.col("layer_id") % 10 == 0, F.upper("layer_key")).otherwise(F.col("layer_key")),
            "spatial_resolution_m": F.col("spatial_resolution_m") - 5, "source_url": F.lit("https://x"), "license_url": F.lit(None).cast("string"),
            "temporal_coverage_start": day, "temporal_coverage_end": day,
        }
    )
    return counted(V.flagged(layers, V.layer_rules()))


@query("v9_rain_rules", "v_history", sql=unpivot("SELECT mean_precipitation_mm - 5 AS m, max_precipitation_mm - 30 AS x, grid_cell_count, accumulation_3d_mm AS a FROM v_history", {
    "mean must not be negative": "m < 0", "max must not be below mean": "x < m", "grid_cell_count must be positive": "grid_cell_count <= 0"}))
def v9(v):
    h = v.v_history.withColumns({"mean_precipitation_mm": F.col("mean_precipitation_mm") - 5, "max_precipitation_mm": F.col("max_precipitation_mm") - 30})
    return counted(V.flagged(h, V.rain_rules()))


@query("v10_unique_predictions", "v_predictions", sql="""
SELECT model_version, CAST(cell_id % 700 AS BIGINT) AS slot, COUNT(*) AS rows FROM v_predictions GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def v10(v):
    return V.duplicate_keys(v.v_predictions.withColumn("slot", F.col("cell_id") % 700), ["model_version", "slot"])


#: Readings and observations of which every rule finds some at fault, and values on the edges that none may.
FAULTY_READINGS = """
SELECT message_id, CASE message_id % 23 WHEN 1 THEN '  ' WHEN 2 THEN repeat('s', 101) WHEN 3 THEN repeat('s', 100) WHEN 4 THEN NULL ELSE CAST(station_id AS STRING) END AS station_id,
  CASE WHEN message_id % 23 <> 5 THEN observed_at END AS observed_at,
  CASE message_id % 23 WHEN 6 THEN -2000.5e0 WHEN 7 THEN 10000.5e0 WHEN 8 THEN 10000e0 WHEN 9 THEN -2000e0 WHEN 20 THEN NULL ELSE water_level_cm END AS water_level_cm,
  CASE message_id % 23 WHEN 10 THEN -0.5e0 WHEN 11 THEN 5000.5e0 WHEN 12 THEN 5000e0 WHEN 20 THEN NULL ELSE rainfall_mm END AS rainfall_mm,
  CASE message_id % 23 WHEN 13 THEN -1e0 WHEN 14 THEN 100.5e0 WHEN 15 THEN NULL ELSE soil_moisture_percent END AS soil_moisture_percent,
  CASE message_id % 23 WHEN 13 THEN -1e0 WHEN 16 THEN 101e0 ELSE battery_percent END AS battery_percent,
  CASE message_id % 23 WHEN 17 THEN '' WHEN 18 THEN repeat('x', 256) WHEN 19 THEN NULL ELSE source END AS source
FROM v_readings"""

FAULTY_OBSERVATIONS = """
SELECT observation_id, CASE observation_id % 19 WHEN 1 THEN NULL WHEN 2 THEN -0.5e0 WHEN 3 THEN 5001e0 ELSE rainfall_mm END AS rainfall_mm,
  CASE observation_id % 19 WHEN 1 THEN NULL WHEN 4 THEN -20.5e0 WHEN 5 THEN 100.5e0 WHEN 6 THEN 100e0 ELSE water_level_m END AS water_level_m,
  CASE observation_id % 19 WHEN 7 THEN -1e0 WHEN 8 THEN 1000001e0 WHEN 9 THEN 1000000e0 END AS discharge_m3s,
  CASE observation_id % 19 WHEN 10 THEN 100.5e0 WHEN 11 THEN 100e0 END AS soil_moisture_percent,
  CASE observation_id % 19 WHEN 12 THEN -1e0 WHEN 13 THEN 0e0 END AS battery_percent,
  CASE observation_id % 19 WHEN 14 THEN NULL WHEN 15 THEN 'Verified' ELSE quality_status END AS quality_status
FROM v_observations"""


@query("v3_faulty_readings", "v_readings", sql=unpivot(FAULTY_READINGS, {
    "station_id must not be blank": "station_id IS NULL OR station_id = '  '", "station_id is too long": "LENGTH(station_id) > 100", "timestamp must be present": "observed_at IS NULL",
    "water_level_cm out of range": "water_level_cm < -2000 OR water_level_cm > 10000", "rainfall_mm out of range": "rainfall_mm < 0 OR rainfall_mm > 5000",
    "soil_moisture_percent out of range": "soil_moisture_percent < 0 OR soil_moisture_percent > 100", "battery_percent out of range": "battery_percent < 0 OR battery_percent > 100",
    "source must not be blank": "source IS NULL OR source = ''", "source is too long": "LENGTH(source) > 255", "waterLevelCm or rainfallMm is required": "water_level_cm IS NULL AND rainfall_mm IS NULL"}))
def v3_faulty(v):
    return counted(V.flagged(v.spark.sql(FAULTY_READINGS.replace("v_readings", "{rows}"), rows=v.v_readings), V.reading_rules()))


@query("v5_faulty_observations", "v_observations", sql=unpivot(FAULTY_OBSERVATIONS, {
    "a measurement is required": "rainfall_mm IS NULL AND water_level_m IS NULL AND discharge_m3s IS NULL", "rainfall_mm out of range": "rainfall_mm < 0 OR rainfall_mm > 5000",
    "water_level_m out of range": "water_level_m < -20 OR water_level_m > 100", "discharge_m3s out of range": "discharge_m3s < 0 OR discharge_m3s > 1000000",
    "soil_moisture_percent out of range": "soil_moisture_percent > 100", "battery_percent out of range": "battery_percent < 0",
    "unknown quality_status": "quality_status IS NULL OR quality_status = 'Verified'"}))
def v5_faulty(v):
    return counted(V.flagged(v.spark.sql(FAULTY_OBSERVATIONS.replace("v_observations", "{rows}"), rows=v.v_observations), V.observation_rules()))


@query("v10_repeated_readings", "v_readings", sql="""
SELECT station_id, CAST(observed_at AS DATE) AS day, COUNT(*) AS rows FROM v_readings GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def v10_repeated(v):
    return V.duplicate_keys(v.v_readings.withColumn("day", F.col("observed_at").cast("date")), ["station_id", "day"])


@query("v11_feature_gaps", "v_cells", sql="""
SELECT COUNT(*) FILTER (WHERE hand_mean_m IS NULL) AS hand_mean_m, COUNT(*) FILTER (WHERE elevation_mean_m IS NULL) AS elevation_mean_m FROM v_cells""")
def v11(v):
    return V.feature_gaps(v.v_cells, ["hand_mean_m", "elevation_mean_m"])


@query("v12_event_properties", "v_labels", sql="""
SELECT event_id, COUNT(*) AS features,
  COALESCE(MIN(observed_start_date) = MAX(observed_start_date), FALSE) AND COUNT(*) FILTER (WHERE observed_start_date IS NULL) = 0
    AND COALESCE(MIN(observed_date) = MAX(observed_date), FALSE) AS consistent,
  CASE WHEN MIN(classification) = MAX(classification) THEN MIN(classification) END AS classification FROM v_labels GROUP BY event_id""")
def v12(v):
    e = V.event_properties(v.v_labels, required=("observed_start_date", "observed_date"), optional=("classification",))
    return e.select("event_id", "features", "consistent", "classification")


@query("v13_group_rules", "v_labels", sql="SELECT extent_id, event_name IS NULL AS missing FROM v_labels")
def v13(v):
    p = F.when(F.col("event_name").isNotNull(), F.create_map(F.lit("event"), F.col("event_name"))).otherwise(F.create_map().cast("map<string,string>"))
    marked = V.flagged(v.v_labels.withColumn("properties", p), V.group_rules("properties", "event"))
    return marked.select("extent_id", F.array_contains("violations", "missing group property event").alias("missing"))


@query("v14_source_counts", "v_segments", sql="""
SELECT k.asset_type, COUNT(s.segment_id) AS count, COUNT(s.segment_id) > 0 AS available
FROM (SELECT unnest(['terrain_cell', 'river_segment', 'canal_segment']) AS asset_type) k LEFT JOIN v_segments s USING (asset_type) GROUP BY k.asset_type""")
def v14(v):
    return V.source_counts(v.v_segments)


@query("v15_scrub_hand", "v_cells", sql="""
SELECT cell_id, CASE WHEN hand_mean_m * 200 <= 5000 THEN hand_mean_m * 200 END AS hand_mean_m FROM v_cells""")
def v15(v):
    return V.scrub_hand(v.v_cells.select("cell_id", (F.col("hand_mean_m") * 200).alias("hand_mean_m")))


# --- keyed tables -------------------------------------------------------------------------


@query("io8_upsert", "v_cells", "v_predictions", sql="""
SELECT cell_id, probability, 'new' AS state FROM v_predictions WHERE cell_id % 3 = 0
UNION ALL SELECT cell_id, elevation_mean_m AS probability, 'old' AS state FROM v_cells WHERE cell_id % 3 <> 0""")
def io8(v):
    target = v.v_cells.select("cell_id", F.col("elevation_mean_m").alias("probability"), F.lit("old").alias("state"))
    updates = v.v_predictions.where("cell_id % 3 = 0").select("cell_id", "probability", F.lit("new").alias("state"))
    from hydrolens.session import scratch_path
    from hydrolens.sources.tables import read_table, upsert

    # bands of cells are fixed by the key; the updates touch two of six
    def banded(df):
        return df.withColumn("band", F.col("cell_id") % 6)

    path = scratch_path(v.spark, "upsert")
    upsert(v.spark, path, banded(target), ["cell_id"], ["band"])
    upsert(v.spark, path, banded(updates), ["cell_id"], ["band"])
    return read_table(v.spark, path).drop("band")


@query("io9_replace_partition", "v_predictions", sql="""
SELECT model_version, COUNT(*) AS rows, ROUND(SUM(probability), 6) AS total
FROM (SELECT model_version, CASE WHEN model_version = 'm1' THEN 1e0 - probability ELSE probability END AS probability FROM v_predictions) GROUP BY model_version""")
def io9(v):
    from hydrolens.session import scratch_path
    from hydrolens.sources.tables import replace_partition

    path = scratch_path(v.spark, "replace")
    replace_partition(v.v_predictions, path, ["model_version"])
    replace_partition(v.v_predictions.where("model_version = 'm1'").withColumn("probability", 1.0 - F.col("probability")), path, ["model_version"])
    stored = v.spark.read.parquet(path)
    return rounded(stored.groupBy("model_version").agg(F.count(F.lit(1)).alias("rows"), F.sum("probability").alias("total")), total=6)


@query("io10_write_run", "v_predictions", sql="SELECT model_version AS run_version, COUNT(*) AS cells FROM v_predictions GROUP BY 1")
def io10(v):
    from hydrolens.session import scratch_path
    from hydrolens.sources.tables import write_run

    path = scratch_path(v.spark, "runs")
    for version in ("m1", "m2", "m3"):
        mine = v.v_predictions.where(F.col("model_version") == version).withColumnRenamed("model_version", "run_version")
        write_run(mine.groupBy("run_version").agg(F.count(F.lit(1)).alias("cells")), mine, path)
    runs, predictions = v.spark.read.parquet(f"{path}/runs"), v.spark.read.parquet(f"{path}/predictions")
    return predictions.groupBy("run_version").agg(F.count(F.lit(1)).alias("cells")).join(runs.select("run_version"), "run_version", "left_semi")


@query("io11_export_dataset", "v_cells", sql="SELECT cell_id, elevation_mean_m, hand_mean_m FROM v_cells")
def io11(v):
    from hydrolens.session import scratch_path
    from hydrolens.sources.tables import export_dataset

    path = scratch_path(v.spark, "export")
    export_dataset(v.v_cells, path, ["cell_id", "elevation_mean_m", "hand_mean_m"])
    return v.spark.read.schema("cell_id bigint, elevation_mean_m double, hand_mean_m double").option("header", True).csv(path)


@query("io12_export_catalog", "v_labels", sql="SELECT extent_id, CAST(observed_date AS VARCHAR) AS observed_date, area_km2 FROM v_labels")
def io12(v):
    from hydrolens.session import scratch_path
    from hydrolens.sources.tables import export_catalog

    path = scratch_path(v.spark, "catalog")
    export_catalog(v.v_labels, path, ["extent_id", "observed_date", "area_km2"])
    return v.spark.read.schema("extent_id bigint, observed_date string, area_km2 double").json(f"{path}/json")


@query("io13_read_event_dataset", "v_scores", sql="SELECT row_key, event_id, probability, label AS target_label FROM v_scores")
def io13(v):
    from hydrolens.session import scratch_path
    from hydrolens.sources.tables import export_dataset, read_event_dataset

    path = scratch_path(v.spark, "training")
    s = v.v_scores.withColumns({"target_label": F.col("label"), "temporal_split": F.lit("train")})
    export_dataset(s, path, ["row_key", "event_id", "probability", "target_label", "temporal_split"])
    back = read_event_dataset(v.spark, path, ["probability"])
    return back.select(F.col("row_key").cast("bigint").alias("row_key"), "event_id", "probability", "target_label")


@query("io6_read_pixels", "v_pixels", sql="SELECT px_row, px_col, value FROM v_pixels WHERE value <> 0e0")
def io6(v):
    from hydrolens.operators.raster import drop_nodata

    return drop_nodata(v.v_pixels, 0.0).select("px_row", "px_col", "value")


@query("io7_tiles", "v_pixels", sql="""
SELECT CAST(FLOOR(px_row / 256) AS INT) AS tile_row, CAST(FLOOR(px_col / 256) AS INT) AS tile_col, CAST(MIN(px_col) AS DOUBLE) AS xmin, CAST(MAX(px_row) AS DOUBLE) AS ymax, COUNT(*) AS pixels FROM v_pixels GROUP BY 1, 2""")
def io7(v):
    from hydrolens.operators.raster import tile_footprints, with_tile

    p = with_tile(v.v_pixels).withColumns({"lon": F.col("px_col").cast("double"), "lat": F.col("px_row").cast("double")})
    return tile_footprints(p).select("tile_row", "tile_col", "xmin", "ymax", "pixels")


def _payloads(v):
    """Forecast documents built from the readings: one per station, hours as parallel arrays."""
    hour = F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm")
    items = F.sort_array(F.collect_list(F.struct(hour.alias("t"), "rainfall_mm", "message_id")))
    g = v.v_readings.groupBy("station_id").agg(items.alias("i"))
    hourly = F.struct(
        F.transform("i", lambda x: x["t"]).alias("time"), F.transform("i", lambda x: x["rainfall_mm"]).alias("precipitation"),
        F.slice(F.transform("i", lambda x: (x["message_id"] % 100).cast("double")), 1, 2).alias("precipitation_probability"),
    )
    empty = F.struct(
        F.array().cast("array<string>").alias("time"), F.array().cast("array<double>").alias("precipitation_sum"),
        F.array().cast("array<double>").alias("precipitation_probability_max"),
    )
    return g.select("station_id", hourly.alias("hourly"), empty.alias("daily"))


@query("io4_explode_forecast", "v_readings", sql="""
SELECT station_id, COUNT(*) AS hours, ROUND(SUM(COALESCE(rainfall_mm, 0e0)), 6) AS rain_mm, LEAST(COUNT(*), 2) AS with_probability FROM v_readings GROUP BY station_id""")
def io4(v):
    from hydrolens.sources.rain import explode_forecast

    hourly, _, _ = explode_forecast(_payloads(v))
    g = hourly.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("hours"), F.sum("precipitation_mm").alias("rain_mm"), F.count("probability_percent").alias("with_probability")
    )
    return rounded(g, rain_mm=6)


@query("io3_explode_archive", "v_rain_samples", sql="""
SELECT observed_date, COUNT(*) AS n, ROUND(SUM(precipitation_mm * weight), 6) AS weighted FROM v_rain_samples GROUP BY observed_date""")
def io3(v):
    from hydrolens.sources.rain import explode_archive

    s = v.v_rain_samples
    # one document per (year, weight) holding that location's series
    items = F.sort_array(F.collect_list(F.struct(F.col("observed_date").cast("string").alias("t"), F.col("precipitation_mm").alias("p"))))
    per = s.groupBy(F.year("observed_date").cast("string").alias("chunk"), "weight").agg(items.alias("i"))
    location = F.struct(
        F.struct(F.transform("i", lambda x: x["t"]).alias("time"), F.transform("i", lambda x: x["p"]).alias("precipitation_sum")).alias("daily")
    )
    payloads = per.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("weight", location.alias("l")))), lambda x: x["l"]).alias("locations"))
    positions = v.spark.range(4).select(F.col("id").cast("int").alias("position"), (F.col("id") + 1).cast("double").alias("weight"))
    g = explode_archive(payloads, positions).groupBy("observed_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("precipitation_mm") * F.col("weight")).alias("weighted")
    )
    return rounded(g, weighted=6)


@query("io5_parse_readings", "v_readings", sql="SELECT CAST(station_id AS VARCHAR) AS station_id, observed_at, water_level_cm, rainfall_mm, source FROM v_readings")
def io5(v):
    from hydrolens.sources.readings import parse_readings

    text = F.to_json(
        F.struct(
            F.col("station_id").cast("string").alias("stationId"), F.concat(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
            F.col("water_level_cm").alias("waterLevelCm"), F.col("rainfall_mm").alias("rainfallMm"), "source",
        )
    )
    p = parse_readings(v.v_readings.select(text.alias("value")))
    utc = F.to_timestamp_ntz(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("observed_at").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return p.select("station_id", utc.alias("observed_at"), "water_level_cm", "rainfall_mm", "source")


@query("io16_extents_to_assets", "v_labels", sql="""
SELECT source_key, event_name AS name, 'historical_flood_extent' AS asset_type, classification, 'true' AS training_label FROM v_labels""")
def io16(v):
    from hydrolens.sources.geojson import extents_to_assets

    a = extents_to_assets(v.v_labels)
    p = F.col("properties")
    return a.select("source_key", "name", "asset_type", p["classification"].alias("classification"), p["training_label"].alias("training_label"))
