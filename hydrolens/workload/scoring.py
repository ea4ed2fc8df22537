"""M: metrics, thresholds, models. D: datasets. I: products."""

from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.functions import geo
from hydrolens.functions import scalars as S
from hydrolens.operators import aggregates as A
from hydrolens.operators import rain as R
from hydrolens.operators import spatial
from hydrolens.operators.ranking import with_percentile
from hydrolens.plans import agreement, features, products, training
from hydrolens.plans import metrics as M

from hydrolens.workload.registry import near, nudged, query, r6, rounded
from hydrolens.workload.relational import BAND, EVENTS, MEET
from hydrolens.workload.scalars import frac, rexact
from hydrolens.workload.spatial import CELL, CLIP, INNER

RANKS = """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY probability DESC, row_key) AS n,
  SUM(label) OVER (PARTITION BY event_id ORDER BY probability DESC, row_key ROWS UNBOUNDED PRECEDING) AS tp FROM v_scores),
a AS (SELECT event_id, probability, label, AVG(q) OVER (PARTITION BY event_id, probability) AS ar FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY probability) AS q FROM v_scores)),
auc AS (SELECT event_id, (SUM(ar) FILTER (WHERE label = 1) - SUM(label) * (SUM(label) + 1) / 2e0) / (SUM(label) * (COUNT(*) - SUM(label))) AS roc FROM a GROUP BY event_id),
ap AS (SELECT event_id, SUM(label * tp * 1e0 / n) / SUM(label) AS ap FROM r GROUP BY event_id)"""


@query("m6_evaluate", "v_scores", sql=f"""WITH {RANKS},
c AS (SELECT event_id, COUNT(*) AS rows, CAST(SUM(label) AS BIGINT) AS positives, COUNT(*) FILTER (WHERE probability >= 0.6e0 AND label = 1) AS tp, COUNT(*) FILTER (WHERE probability >= 0.6e0 AND label = 0) AS fp,
  AVG((probability - label) * (probability - label)) AS brier FROM v_scores GROUP BY event_id)
SELECT c.event_id, rows, positives, tp, fp, ROUND(tp * 1e0 / (tp + fp), 6) AS precision, ROUND(tp * 1e0 / positives, 6) AS recall,
  ROUND(2e0 * tp / (tp + fp + positives), 6) AS f1, ROUND(roc, 6) AS roc_auc, ROUND(ap, 6) AS pr_auc, {near('brier')} AS brier_score FROM c JOIN auc USING (event_id) JOIN ap USING (event_id)""")
def m6(v):
    e = M.evaluate(v.v_scores, ["event_id"], 0.6, digits=None)
    e = e.select("event_id", "rows", "positives", "tp", "fp", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score")
    return nudged(rounded(e, precision=6, recall=6, f1=6, roc_auc=6, pr_auc=6), brier_score=6)


@query("m7_roc_auc", "v_scores", sql=f"WITH {RANKS} SELECT event_id, ROUND(roc, 6) AS roc_auc FROM auc")
def m7(v):
    return rounded(M.roc_auc(v.v_scores, ["event_id"]), roc_auc=6)


@query("m8_average_precision", "v_scores", sql=f"WITH {RANKS} SELECT event_id, ROUND(ap, 6) AS average_precision FROM ap")
def m8(v):
    return rounded(M.average_precision(v.v_scores, ["event_id"]), average_precision=6)


STEPS = "(SELECT k, CASE WHEN k = 91 THEN 0.95e0 ELSE 0.05e0 + (k - 1) * ((0.95e0 - 0.05e0) / 90) END AS t FROM (SELECT CAST(unnest(range(1, 92)) AS INT) AS k))"


def sweep_sql(rows: str, keys: str) -> str:
    """Metrics at every threshold from (keys, p, label) rows collapsed to distinct scores."""
    precision = "CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE 0e0 END"
    recall = "CASE WHEN positives > 0 THEN tp * 1e0 / positives ELSE 0e0 END"
    f1 = f"CASE WHEN ({precision}) + ({recall}) > 0 THEN 2 * ({precision}) * ({recall}) / (({precision}) + ({recall})) ELSE 0e0 END"
    return f"""g AS (SELECT {keys}, p, COUNT(*) AS n, SUM(label) AS y FROM {rows} GROUP BY {keys}, p), tot AS (SELECT {keys}, SUM(y) AS positives FROM g GROUP BY {keys}),
s AS (SELECT {keys}, k, t, CAST(COALESCE(SUM(y) FILTER (WHERE p >= t), 0) AS BIGINT) AS tp, CAST(COALESCE(SUM(n - y) FILTER (WHERE p >= t), 0) AS BIGINT) AS fp FROM g, {STEPS} GROUP BY {keys}, k, t),
w AS (SELECT {keys}, k, t, tp, fp, {rexact(precision, 4)} AS precision, {rexact(recall, 4)} AS recall, {rexact(f1, 4)} AS f1 FROM s JOIN tot USING ({keys}))"""


SCORED = "(SELECT event_id, probability AS p, label FROM v_scores)"


@query("m9_threshold_sweep", "v_scores", sql=f"WITH {sweep_sql(SCORED, 'event_id')} SELECT event_id, k AS step, tp, fp, precision, recall, f1 FROM w")
def m9(v):
    return M.threshold_sweep(v.v_scores, ["event_id"]).select("event_id", "step", "tp", "fp", "precision", "recall", "f1")


def pick_sql(where: str, order: str) -> str:
    return f"""WITH {sweep_sql(SCORED, 'event_id')},
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY f1 DESC, precision DESC, ABS(t - 0.5e0), k) AS q FROM w),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY {order}, k) AS q FROM w WHERE {where})
SELECT b.event_id, {rexact('COALESCE(c.t, b.t)', 4)} AS threshold, COALESCE(c.precision, b.precision) AS precision, COALESCE(c.recall, b.recall) AS recall
FROM (SELECT * FROM b WHERE q = 1) b LEFT JOIN (SELECT * FROM c WHERE q = 1) c ON b.event_id = c.event_id"""


def _pick(v, mode):
    return M.pick_threshold(M.threshold_sweep(v.v_scores, ["event_id"]), mode, ["event_id"]).select("event_id", "threshold", "precision", "recall")


@query("m10_pick_balanced", "v_scores", sql=pick_sql("FALSE", "t"))
def m10(v):
    return _pick(v, "balanced")


@query("m11_pick_conservative", "v_scores", sql=pick_sql("recall >= 0.2e0 AND tp + fp > 0", "precision DESC, f1 DESC, t DESC"))
def m11(v):
    return _pick(v, "conservative")


@query("m12_pick_screening", "v_scores", sql=pick_sql("precision >= 0.1e0 AND tp + fp > 0", "recall DESC, f1 DESC, t"))
def m12(v):
    return _pick(v, "screening")


TEMPERED = """(SELECT event_id || '|' || beta AS grp, LEAST(1e0, GREATEST(0e0, probability * (1e0 - beta * LEAST(1e0, GREATEST(0e0, surface_water))))) AS p, label
  FROM v_scores, (SELECT unnest([0e0, 0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0]) AS beta))"""


@query("m13_threshold_profile", "v_scores", sql=f"""WITH {sweep_sql(TEMPERED, 'grp')},
b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY f1 DESC, precision DESC, ABS(t - 0.5e0), k) AS q FROM w),
c AS (SELECT *, split_part(grp, '|', 1) AS event_id, CAST(split_part(grp, '|', 2) AS DOUBLE) AS beta FROM b WHERE q = 1),
d AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY f1 DESC, precision DESC, recall DESC, ABS(beta - 0.3e0), beta) AS z FROM c)
SELECT event_id, 'balanced' AS mode, {rexact('t', 4)} AS threshold, beta AS water_temper_beta, precision, recall, f1 FROM d WHERE z = 1""")
def m13(v):
    return M.select_profile(v.v_scores, "balanced", ["event_id"]).select("event_id", "mode", "threshold", "water_temper_beta", "precision", "recall", "f1")


EDGES = " + ".join(f"CAST(probability >= {i}e0 * 0.1e0 AS INT)" for i in range(1, 10))
CURVE = f"""(SELECT event_id, {EDGES} AS bin, COUNT(*) AS n, AVG(probability) AS p, AVG(label) AS o FROM v_scores GROUP BY 1, 2)"""


@query("m14_calibration", "v_scores", sql=f"""
SELECT event_id, CAST(SUM(n) AS BIGINT) AS rows, ROUND(SUM(n * ABS(p - o)) / SUM(n), 6) AS expected_calibration_error, ROUND(MAX(ABS(p - o)), 6) AS maximum_calibration_error FROM {CURVE} GROUP BY event_id""")
def m14(v):
    c = M.calibration(v.v_scores, keys=["event_id"])
    return rounded(c, expected_calibration_error=6, maximum_calibration_error=6).select("event_id", "rows", "expected_calibration_error", "maximum_calibration_error")


@query("m14_reliability_curve", "v_scores", sql=f"SELECT event_id, bin, n AS count, ROUND(p, 6) AS mean_probability, ROUND(o, 6) AS observed_rate FROM {CURVE}")
def m14_curve(v):
    return rounded(M.reliability_curve(v.v_scores, keys=["event_id"]), mean_probability=6, observed_rate=6).select("event_id", "bin", "count", "mean_probability", "observed_rate")


@query("m15_ranking", "v_scores", sql=f"""
WITH r AS (SELECT probability, label, ROW_NUMBER() OVER (ORDER BY probability DESC, row_key) AS rn, COUNT(*) OVER () AS n, SUM(label) OVER () AS pos FROM v_scores)
SELECT f AS fraction, COUNT(*) AS cells, CAST(SUM(label) AS BIGINT) AS true_positive_cells, {rexact('AVG(label)', 4)} AS precision, {rexact('SUM(label) * 1e0 / MAX(pos)', 4)} AS recall
FROM r, (SELECT unnest([0.01e0, 0.05e0, 0.1e0]) AS f) WHERE rn <= CEIL(n * f) GROUP BY f""")
def m15(v):
    return M.ranking(v.v_scores)


@query("m17_event_metrics", "v_scores", sql="""
SELECT event_id, CAST(COUNT(*) FILTER (WHERE probability >= 0.6e0) - SUM(label) AS BIGINT) AS predicted_area_error_cells, COUNT(*) FILTER (WHERE probability < 0.6e0 AND label = 1) AS fn FROM v_scores GROUP BY event_id""")
def m17(v):
    return M.event_metrics(v.v_scores, 0.6).select("event_id", "predicted_area_error_cells", "fn")


@query("m18_false_positives", "v_scores", sql="""
SELECT row_key, ROUND(probability * (1 - 0.5e0 * LEAST(1e0, surface_water)), 6) AS decision_probability FROM v_scores
WHERE label = 0 AND probability * (1 - 0.5e0 * LEAST(1e0, surface_water)) >= 0.5e0 ORDER BY ROUND(probability * (1 - 0.5e0 * LEAST(1e0, surface_water)), 6) DESC, row_key LIMIT 50""")
def m18(v):
    s = v.v_scores.withColumn("decision_probability", S.temper("probability", "surface_water", F.lit(0.5)))
    kept = s.where(F.col("decision_probability") >= 0.5).withColumn("decision_probability", r6("decision_probability"))
    return M.false_positives(kept, 0.5).select("row_key", "decision_probability")


# --- models -------------------------------------------------------------------------------

MODEL_FEATURES = ["quantity", "price", "discount", "surface_water", "lag_days"]


def model_rows(v):
    """Lineitem rows as labelled samples of seven events."""
    # dealt out by key first: a task that reads a file would hold a table of all its keys
    li = v.table("lineitem").repartition("l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.max("l_discount").alias("discount"),
        (F.max("l_tax") * 10).alias("surface_water"), F.max(F.day("l_shipdate")).cast("double").alias("lag_days"),
    )
    number = F.col("l_linenumber")
    return li.select(
        (F.col("l_orderkey") * 10 + number).alias("row_key"), F.concat(F.lit("E"), number).alias("event_id"),
        F.date_add(F.lit("2001-01-01").cast("date"), number * 100).alias("event_start_date"), *MODEL_FEATURES,
        (F.col("quantity") / 50 + F.pmod(F.xxhash64("l_orderkey", number), F.lit(1000)) / 1500.0 > 0.85).cast("int").alias("target_label"),
        F.when(number >= 6, "test").when(number >= 4, "validation").otherwise("train").alias("temporal_split"),
    )


@query("m1_scaler", sql="""
SELECT ROUND(AVG(l_quantity), 6) AS mean_quantity, ROUND(STDDEV_POP(l_quantity), 6) AS scale_quantity, ROUND(AVG(l_discount), 6) AS mean_discount, ROUND(STDDEV_POP(l_discount), 6) AS scale_discount FROM lineitem""")
def m1(v):
    mean, scale = training.fit_scaler(v.table("lineitem"), ["l_quantity", "l_discount"])
    values = [round(x, 6) for pair in zip(mean, scale) for x in pair]
    return v.spark.createDataFrame([tuple(values)], "mean_quantity double, scale_quantity double, mean_discount double, scale_discount double")


ARTIFACT = {"feature_names": ["quantity", "discount"], "mean": [25.0, 0.05], "scale": [14.0, 0.03], "coefficients": [0.8, -0.4], "intercept": -0.2}


@query("m4_score", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, ROUND(1e0 / (1e0 + EXP(-(-0.2e0 + (l_quantity - 25e0) / 14e0 * 0.8e0 + (l_discount - 0.05e0) / 0.03e0 * -0.4e0))), 6) AS probability FROM lineitem""")
def m4(v):
    rows = v.table("lineitem").withColumnsRenamed({"l_quantity": "quantity", "l_discount": "discount"})
    return rounded(training.score(rows, ARTIFACT), probability=6).select("l_orderkey", "l_linenumber", "l_partkey", "probability")


@query("m5_explain", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ABS((l_quantity - 25e0) / 14e0 * 0.8e0) >= ABS((l_discount - 0.05e0) / 0.03e0 * 0.4e0) THEN 'quantity' ELSE 'discount' END AS top_feature FROM lineitem""")
def m5(v):
    rows = v.table("lineitem").withColumnsRenamed({"l_quantity": "quantity", "l_discount": "discount"})
    e = training.explain(rows, ARTIFACT, 1)
    return e.select("l_orderkey", "l_linenumber", "l_partkey", F.col("top_linear_contributions")[0]["feature"].alias("top_feature"))


@query("m2_logistic")
def m2(v):
    rows = model_rows(v)
    artifact = training.fit_logistic(rows, MODEL_FEATURES)
    return training.importance_table(rows, MODEL_FEATURES, artifact["coefficients"])


@query("m3_susceptibility", "v_cells", "v_labels")
def m3(v):
    return training.train_susceptibility(susceptibility(v))["metrics"]


@query("m16_rolling_origin")
def m16(v):
    return training.rolling_origin(model_rows(v), MODEL_FEATURES, water="surface_water")["summary"]


@query("m19_event_model")
def m19(v):
    r = training.train_event_model(model_rows(v), MODEL_FEATURES, water="surface_water")
    return r["test_by_event"]


@query("m21_compare_models")
def m21(v):
    r = training.compare_models(model_rows(v), MODEL_FEATURES, water="surface_water")
    return r["results"].select("algorithm", "mode", "precision", "recall", "f1", "pr_auc")


@query("m20_persist_model", "v_scores", sql="SELECT event_id, COUNT(*) AS rows FROM v_scores WHERE event_id IN ('E4', 'E5', 'E6', 'E7') GROUP BY event_id")
def m20(v):
    from hydrolens.session import scratch_path

    p = v.v_event_predictions.where("split <> 'train'").select(F.lit("event-v1").alias("model_version"), "event_id", "cell_key", "probability")
    path = scratch_path(v.spark, "model")
    training.persist_model({"predictions": p, "artifact": {**ARTIFACT, "model_version": "event-v1"}}, path)
    training.persist_model({"predictions": p, "artifact": {**ARTIFACT, "model_version": "event-v1"}}, path)
    return v.spark.read.parquet(f"{path}/predictions").groupBy("event_id").agg(F.count(F.lit(1)).alias("rows"))


def sensor_rows(v):
    s = v.v_scores.select(
        "event_id", F.floor(F.col("row_key") / 10).alias("cell_id"), F.col("probability").alias("flooded_fraction"), F.col("label").alias("target_label"),
        F.col("probability").alias("quantity"), F.col("surface_water").alias("discount"),
    )
    following = F.concat(F.lit("E"), F.substring("event_id", 2, 9).cast("int") + 1)
    return s, s.select(F.col("event_id").alias("reference_event_id"), following.alias("sar_event_id")).distinct()


@query("m23_label_agreement", "v_scores", sql="""
WITH s AS (SELECT event_id, row_key // 10 AS cell_id, probability, label FROM v_scores)
SELECT g.event_id AS reference_event_id, COUNT(*) AS compared_cells, ROUND(AVG(ABS(g.probability - t.probability)), 6) AS mean_fraction_delta, ROUND(AVG(CAST(g.label = t.label AS INT)), 6) AS label_agreement_rate,
  ROUND(SUM(g.label * t.label) * 1e0 / SUM(GREATEST(g.label, t.label)), 6) AS binary_iou, CAST(SUM(g.label) AS BIGINT) AS gfd_positive_cells, CAST(SUM(t.label) AS BIGINT) AS sar_positive_cells
FROM s g JOIN s t ON g.cell_id = t.cell_id AND CAST(SUBSTR(t.event_id, 2) AS INT) = CAST(SUBSTR(g.event_id, 2) AS INT) + 1 GROUP BY 1""")
def m23(v):
    s, mapping = sensor_rows(v)
    pairs = agreement.agreement_pairs(s.drop("quantity", "discount"), s.drop("quantity", "discount"), mapping)
    return rounded(agreement.summarize_agreement(pairs, ["reference_event_id"]), mean_fraction_delta=6, label_agreement_rate=6, binary_iou=6)


@query("m24_sar_validation", "v_scores")
def m24(v):
    s, mapping = sensor_rows(v)
    r = agreement.sar_validation(s, s, mapping, {**ARTIFACT, "decision_threshold": 0.5})
    # the overall report is the row without a pair
    return r["pairs"].unionByName(r["overall"], allowMissingColumns=True).withColumns({"status": F.lit(r["status"]), "decision_threshold": F.lit(r["decision_threshold"])})


# --- prediction products ------------------------------------------------------------------


def with_band(df):
    return df.withColumns({"risk_band": S.risk_band("probability"), "predicted_label": F.col("probability") >= 0.5})


@query("m25_prediction_index", "v_predictions", sql=f"""
SELECT COUNT(*) AS total_cells, ROUND(AVG(probability), 6) AS mean_probability, COUNT(*) FILTER (WHERE probability >= 0.5e0) AS predicted_positive_cells,
  COUNT(*) FILTER (WHERE b = 'LOW') AS low_cells, COUNT(*) FILTER (WHERE b = 'VERY_HIGH') AS very_high_cells FROM (SELECT *, {BAND} AS b FROM v_predictions WHERE model_version = 'm2')""")
def m25(v):
    _, s = products.prediction_index(with_band(v.v_predictions), "m2")
    return rounded(s.select("total_cells", "mean_probability", "predicted_positive_cells", "low_cells", "very_high_cells"), mean_probability=6)


@query("m26_event_prediction_index", "v_event_predictions", sql="""
WITH p AS (SELECT *, probability * (1 - 0.4e0 * LEAST(1e0, surface_water)) >= 0.45e0 AS pred, GREATEST(0e0, flooded_fraction - surface_water) >= 0.1e0 AS obs FROM v_event_predictions WHERE event_id = 'E7')
SELECT event_id, COUNT(*) AS total_cells, COUNT(*) FILTER (WHERE flooded_fraction >= 0.1e0) AS observed_positive_cells, COUNT(*) FILTER (WHERE pred AND obs) AS tp, COUNT(*) FILTER (WHERE pred AND NOT obs) AS fp,
  COUNT(*) FILTER (WHERE NOT pred AND obs) AS fn, COUNT(*) FILTER (WHERE pred) AS predicted_positive_cells, ROUND(AVG(probability), 6) AS mean_probability FROM p GROUP BY event_id""")
def m26(v):
    profile = {"threshold": 0.45, "water_temper_beta": 0.4}
    s = products.event_prediction_index(v.v_event_predictions, profile, 0.1, "flood_excess", key="cell_key")["summary"]
    s = s.select("event_id", "total_cells", "observed_positive_cells", "tp", "fp", "fn", "predicted_positive_cells", "mean_probability")
    return rounded(s, mean_probability=6)


@query("m27_model_evaluation", "v_scores", sql="""
SELECT event_id AS model_version, 'balanced' AS active_threshold_mode, ROUND(AVG(probability), 6) AS decision_threshold, 0e0 AS water_temper_beta FROM v_scores GROUP BY event_id""")
def m27(v):
    m = v.v_scores.groupBy(F.col("event_id").alias("model_version")).agg(r6(F.avg("probability")).alias("t"))
    text = F.format_string('{"active_threshold_mode": "balanced", "threshold_profiles": {"balanced": {"threshold": %s}}}', F.col("t").cast("string"))
    e = products.model_evaluation(m.select("model_version", text.alias("metrics"), F.lit(0.5).alias("decision_threshold")))
    return e.select("model_version", "active_threshold_mode", "decision_threshold", "water_temper_beta")


def catalog(v):
    """Cells as a feature catalog with every static feature."""
    c = v.v_cells.select(
        "cell_id", "xmin", "ymin", "xmax", "ymax", "elevation_mean_m", "elevation_min_m", "elevation_max_m", "elevation_stddev_m", "local_relief_m", "distance_to_waterway_m", "hand_mean_m",
        (F.col("elevation_mean_m") / 20.03).alias("elevation_percentile"), ((F.col("xmin") + F.col("xmax")) / 2).alias("centroid_lon"), ((F.col("ymin") + F.col("ymax")) / 2).alias("centroid_lat"),
        F.col("lc_cropland").alias("landcover_cropland_pct"), F.col("lc_built").alias("landcover_built_pct"), F.col("lc_water").alias("landcover_water_pct"), F.col("lc_wetland").alias("landcover_wetland_pct"),
    )
    return spatial.with_box(features.typed_catalog(c))


@query("d9_cell_catalog", "v_cells", sql="""
SELECT cell_id, COALESCE(hand_mean_m, 50e0) AS hand_mean_m, distance_to_waterway_m AS distance_to_river_m, distance_to_waterway_m AS distance_to_canal_m, 0e0 AS landcover_tree_pct, lc_water AS landcover_water_pct, ROUND((xmin + xmax) / 2, 7) AS centroid_lon FROM v_cells""")
def d9(v):
    from hydrolens.functions import geo

    p = F.to_json(F.struct("elevation_mean_m", "hand_mean_m", "distance_to_waterway_m", F.create_map(F.lit("80"), F.col("lc_water")).alias("land_cover_percentages")))
    a = v.v_cells.select("cell_id", F.lit("terrain_cell").alias("asset_type"), geo.box("xmin", "ymin", "xmax", "ymax").alias("geometry"), p.alias("properties"))
    c = features.cell_catalog(a)
    return rounded(c.select("cell_id", "hand_mean_m", "distance_to_river_m", "distance_to_canal_m", "landcover_tree_pct", "landcover_water_pct", "centroid_lon"), centroid_lon=7)


def susceptibility(v):
    o = spatial.box_overlaps(spatial.with_box(v.v_cells), spatial.with_box(v.v_labels), keep=["event_count"])
    return features.susceptibility_dataset(catalog(v), o)


@query("d10_susceptibility_dataset", "v_cells", "v_labels", sql=f"""
WITH o AS (SELECT c.cell_id, SUM(CASE WHEN {INNER} THEN {CLIP} ELSE 0e0 END) / {CELL} AS f, MAX(f.event_count) AS e, SUM(CASE WHEN {INNER} THEN {CLIP} ELSE 0e0 END * f.event_count) / {CELL} AS d
  FROM v_cells c JOIN v_labels f ON {MEET} GROUP BY c.cell_id, c.xmin, c.ymin, c.xmax, c.ymax)
SELECT cell_id, ROUND(LEAST(1e0, COALESCE(f, 0)), 6) AS flooded_fraction, COALESCE(e, 0) AS historical_event_count, ROUND(COALESCE(d, 0), 5) AS historical_event_density, CAST(COALESCE(f, 0) >= 0.1e0 AS INT) AS target_label
FROM v_cells LEFT JOIN o USING (cell_id)""")
def d10(v):
    d = susceptibility(v).select("cell_id", "flooded_fraction", "historical_event_count", "historical_event_density", "target_label")
    return rounded(d, flooded_fraction=6, historical_event_density=5)


def engineered_sql(r3: str, r7: str, r30: str, mx: str) -> str:
    water = f"LEAST(1e0, {frac('lc_water')} + {frac('lc_wetland')} + 0e0)"
    near_water = "(1e0 / (1e0 + distance_to_waterway_m / 250e0))"
    low = "(1e0 - LEAST(1e0, GREATEST(0e0, elevation_mean_m / 20.03e0)))"
    return f"""ROUND({near_water}, 6) AS waterway_proximity_index, ROUND({water}, 6) AS surface_water_influence_pct, ROUND(1e0 / (1e0 + local_relief_m), 6) AS flatness_index,
  ROUND(1e0 / (1e0 + COALESCE(hand_mean_m, 50e0) / 3e0) * {near_water}, 6) AS low_hand_waterway_risk, ROUND({r7} * {near_water}, 4) AS rainfall_7d_x_waterway_proximity,
  ROUND({r30} * {low}, 4) AS rainfall_30d_x_low_elevation, ROUND({r3} * {water}, 4) AS rainfall_3d_x_surface_water, ROUND({mx} / GREATEST(1e0, SQRT({r7} * GREATEST({r30}, 1e0))), 6) AS rainfall_intensity_ratio"""


ENGINEERED = {
    "waterway_proximity_index": 6, "surface_water_influence_pct": 6, "flatness_index": 6, "low_hand_waterway_risk": 6, "rainfall_7d_x_waterway_proximity": 4,
    "rainfall_30d_x_low_elevation": 4, "rainfall_3d_x_surface_water": 4, "rainfall_intensity_ratio": 6,
}


@query("d12_engineered_features", "v_cells", sql=f"SELECT cell_id, {engineered_sql('(cell_id % 90 * 1e0)', '(cell_id % 200 * 1e0)', '(cell_id % 500 * 1e0)', '(cell_id % 60 * 1e0)')} FROM v_cells")
def d12(v):
    i = F.col("cell_id")
    rain = {"rainfall_accumulation_3d_mm": i % 90, "rainfall_accumulation_7d_mm": i % 200, "rainfall_accumulation_30d_mm": i % 500, "rainfall_max_1d_mm": i % 60}
    e = features.with_engineered(catalog(v).withColumns({k: c.cast("double") for k, c in rain.items()}))
    return rounded(e, **ENGINEERED).select("cell_id", *ENGINEERED)


def rain_history(v):
    h = v.v_history.withColumns({"source_key": F.lit("rain"), "p90_precipitation_mm": F.col("max_precipitation_mm")})
    return h, R.rain_anomaly(h)


@query("d13_rain_enrichment", "v_labels", "v_history", sql=f"""
WITH h AS (SELECT observed_date, SUM(mean_precipitation_mm) OVER (ORDER BY observed_date ROWS 13 PRECEDING) AS a14, accumulation_7d_mm / GREATEST(AVG(accumulation_7d_mm) OVER (PARTITION BY weekofyear(observed_date)), 1e0) AS an FROM v_history)
SELECT e.event_id, {near('COALESCE(h.a14, 7e0)', 5)} AS rainfall_accumulation_14d_mm, {near('COALESCE(h.an, 1e0)', 7)} AS rainfall_anomaly_7d FROM {EVENTS} e LEFT JOIN h ON h.observed_date = e.event_start_date""")
def d13(v):
    events = A.event_bounds(v.v_labels).withColumn("rainfall_accumulation_7d_mm", F.lit(7.0))
    e = features.with_rain_enrichment(events, rain_history(v)[1]).select("event_id", "rainfall_accumulation_14d_mm", "rainfall_anomaly_7d")
    return nudged(e, rainfall_accumulation_14d_mm=5, rainfall_anomaly_7d=7)


SPLIT_SQL = f"""(SELECT event_id, CASE WHEN r <= h THEN 'test' WHEN r <= 2 * h THEN 'validation' ELSE 'train' END AS temporal_split FROM
  (SELECT event_id, ROW_NUMBER() OVER (ORDER BY event_start_date DESC, event_id DESC) AS r, GREATEST(1, COUNT(*) OVER () // 5) AS h FROM {EVENTS}))"""


@query("d14_temporal_split", "v_labels", sql=f"SELECT * FROM {SPLIT_SQL}")
def d14(v):
    return features.temporal_split(A.event_bounds(v.v_labels)).select("event_id", "temporal_split")


@query("d15_spatial_split", "v_cells", sql="""
SELECT cell_id, CASE WHEN b <= 1 THEN 'test' WHEN b = 2 THEN 'validation' ELSE 'train' END AS spatial_split FROM (SELECT cell_id,
  CAST('0x' || SUBSTR(sha256(CAST(FLOOR(((xmin + xmax) / 2) / 0.04e0) AS BIGINT) || ':' || CAST(FLOOR(((ymin + ymax) / 2) / 0.04e0) AS BIGINT)), 1, 8) AS BIGINT) % 10 AS b FROM v_cells)""")
def d15(v):
    return features.spatial_split(catalog(v)).select("cell_id", "spatial_split")


def event_rows(v):
    cells = catalog(v)
    history, index = rain_history(v)
    events = features.event_metadata(v.v_extents, history, "all")
    wet = spatial.box_overlaps(cells, spatial.with_box(v.v_extents), keep=["event_id"])
    fractions = spatial.flooded_fraction(cells, wet, keys=["event_id"])
    counts = spatial.historical_count(cells, spatial.with_box(v.v_labels), "demo:gfd:frequency:")
    return features.event_dataset(cells, fractions, events, index, counts, target_threshold=0.1003), events


@query("d11_event_dataset", "v_cells", "v_extents", "v_history", sql=f"""
WITH e AS (SELECT x.event_id, x.xmin AS ex0, x.ymin AS ey0, x.xmax AS ex1, x.ymax AS ey1, h.accumulation_7d_mm AS r7 FROM v_extents x JOIN v_history h ON h.observed_date = x.observed_start_date),
p AS (SELECT e.event_id, c.cell_id, r7, distance_to_waterway_m, lc_water, lc_wetland, CASE WHEN c.xmin < ex1 AND c.xmax > ex0 AND c.ymin < ey1 AND c.ymax > ey0
  THEN {CLIP.replace('f.xmin', 'ex0').replace('f.ymin', 'ey0').replace('f.xmax', 'ex1').replace('f.ymax', 'ey1')} / {CELL} ELSE 0e0 END AS f FROM e, v_cells c)
SELECT event_id, COUNT(*) AS cells, {near('SUM(f)', 5)} AS flooded, {near('SUM(r7 / (1e0 + distance_to_waterway_m / 250e0))', 3)} AS rain_x_water,
  CAST(SUM(CAST(f - LEAST(1e0, {frac('lc_water')} + {frac('lc_wetland')}) >= 0.1003e0 AS INT)) AS BIGINT) AS positives FROM p GROUP BY event_id""")
def d11(v):
    rows, _ = event_rows(v)
    g = rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("flooded_fraction").alias("flooded"), F.sum("rainfall_7d_x_waterway_proximity").alias("rain_x_water"), F.sum("target_label").alias("positives")
    )
    return nudged(g, flooded=5, rain_x_water=3)


@query("d16_event_catalog", "v_cells", "v_labels", "v_history")
def d16(v):
    cells = spatial.with_box(features.typed_catalog(v.v_cells))
    labels = spatial.with_box(v.v_labels).withColumn("geometry", geo.box("xmin", "ymin", "xmax", "ymax"))
    c = features.event_catalog(labels, cells, rain_history(v)[0])
    return rounded(c.select("event_id", "start_date", "flood_area_km2", "mean_hand_m", "historical_flood_frequency", "max_flood_area_km2"), flood_area_km2=6, mean_hand_m=6, max_flood_area_km2=6)


# --- fused products -----------------------------------------------------------------------


def ranked_cells(v):
    return with_percentile(v.v_cells.drop("elevation_stddev_m"), "elevation_mean_m", name="elevation_percentile")


SCREEN = f"""WITH p AS (SELECT cell_id, PERCENT_RANK() OVER (ORDER BY elevation_mean_m) * 100 AS e, PERCENT_RANK() OVER (ORDER BY distance_to_waterway_m) * 100 AS d, PERCENT_RANK() OVER (ORDER BY local_relief_m) * 100 AS r FROM v_cells),
s AS (SELECT cell_id, e, d, r, {rexact(f"{rexact('(100 - e) * 0.55e0', 1)} + {rexact('(100 - d) * 0.3e0', 1)} + {rexact('(100 - r) * 0.15e0', 1)}", 1)} AS score FROM p)"""
SCREEN_BAND = "CASE WHEN score >= 75 THEN 'VERY_HIGH' WHEN score >= 50 THEN 'HIGH' WHEN score >= 25 THEN 'MODERATE' ELSE 'LOWER' END"


@query("i1_terrain_screening", "v_cells", sql=f"""{SCREEN} SELECT cell_id, score AS screening_score, {SCREEN_BAND} AS screening_band,
  {rexact('100 - e', 1)} AS low_elevation_score, {rexact('100 - d', 1)} AS waterway_proximity_score, {rexact('100 - r', 1)} AS flatness_score FROM s""")
def i1(v):
    return products.screening_index(ranked_cells(v))


@query("i1_screening_summary", "v_cells", sql=f"""{SCREEN} SELECT COUNT(*) AS total_cells, ROUND(AVG(score), 5) AS mean_screening_score, COUNT(*) FILTER (WHERE score < 25) AS lower_cells, COUNT(*) FILTER (WHERE score >= 75) AS very_high_cells FROM s""")
def i1_summary(v):
    s = products.screening_summary(products.terrain_screening(ranked_cells(v)))
    return rounded(s.select("total_cells", "mean_screening_score", "lower_cells", "very_high_cells"), mean_screening_score=5)


@query("i3_event_readiness", "v_labels", "v_rain", sql="""
WITH e AS (SELECT event_id, observed_start_date AS d, bool_or(source_key LIKE 'demo:gfd:event:%') AS gfd, bool_or(source_key LIKE 'demo:sar:event:%') AS sar FROM v_labels WHERE observed_start_date IS NOT NULL GROUP BY 1, 2),
a AS (SELECT e.*, d IN (SELECT observed_date FROM v_rain) AS ok FROM e)
SELECT COUNT(*) FILTER (WHERE gfd) AS gfd_event_count, COUNT(*) FILTER (WHERE gfd AND ok) AS rainfall_aligned_event_count, COUNT(*) FILTER (WHERE sar) AS sar_event_count,
  COUNT(*) FILTER (WHERE gfd) >= 4 AND COUNT(*) FILTER (WHERE gfd AND ok) >= 4 AS ready, MIN(d) AS event_observed_from, (SELECT MAX(observed_date) FROM v_rain) AS rainfall_available_to FROM a""")
def i3(v):
    r = products.event_readiness(v.v_labels, v.v_rain)
    return r.select("gfd_event_count", "rainfall_aligned_event_count", "sar_event_count", "ready", "event_observed_from", "rainfall_available_to")


@query("a16_rain_alignment", "v_labels", "v_rain", sql="""
WITH r AS (SELECT observed_date FROM v_rain WHERE EXTRACT(DAY FROM observed_date) % 3 <> 0),
e AS (SELECT event_id, observed_start_date AS d, bool_or(source_key LIKE 'demo:gfd:event:%') AS gfd, bool_or(source_key LIKE 'demo:sar:event:%') AS sar FROM v_labels WHERE observed_start_date IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT e.*, d IN (SELECT observed_date FROM r) AS ok FROM e),
c AS (SELECT COUNT(*) FILTER (WHERE gfd) AS gfd, COUNT(*) FILTER (WHERE gfd AND ok) AS aligned, COUNT(*) FILTER (WHERE sar) AS sar, COUNT(*) FILTER (WHERE sar AND ok) AS sar_aligned, MIN(d) AS d1, MAX(d) AS d2 FROM a)
SELECT gfd >= 4 AND aligned >= 4 AS ready, gfd AS gfd_event_count, aligned AS rainfall_aligned_event_count, gfd - aligned AS missing_rainfall_event_count, sar AS sar_event_count,
  sar > 0 AND sar = sar_aligned AS sar_validation_ready, d1 AS event_observed_from, d2 AS event_observed_to, (SELECT MIN(observed_date) FROM r) AS rainfall_available_from, (SELECT MAX(observed_date) FROM r) AS rainfall_available_to,
  CAST(gfd < 4 AS INT) + CAST(aligned < 4 AS INT) AS n_blockers, CAST(gfd < 4 AS INT) + 1 + CAST(aligned < gfd AS INT) + CAST(gfd >= 4 AND aligned >= 4 AS INT) AS n_steps FROM c""")
def a16(v):
    # rain is missing on every third day of a month, so that some events are not covered
    r = products.event_readiness(v.v_labels, v.v_rain.where(F.day("observed_date") % 3 != 0))
    return r.select("*", F.size("blockers").alias("n_blockers"), F.size("next_steps").alias("n_steps")).drop("blockers", "next_steps")


@query("i4_exposure", "v_cells", "v_predictions", sql="""
SELECT COUNT(*) AS flagged_cells, COUNT(*) * 0.25e0 AS affected_area_km2, COUNT(*) FILTER (WHERE probability >= 0.8e0) AS high_risk_cells, 'experimental_forecast' AS risk_basis FROM v_predictions JOIN v_cells USING (cell_id) WHERE probability >= 0.5e0""")
def i4(v):
    cells = v.v_cells.withColumn("built_fraction", S.as_fraction("lc_built"))
    e = products.exposure_summary(with_band(v.v_predictions), cells, 0.8, forecast=True)
    return e.select("flagged_cells", "affected_area_km2", "high_risk_cells", "risk_basis")


@query("i5_sar_report", "v_scores")
def i5(v):
    s, mapping = sensor_rows(v)
    return products.sar_report(agreement.sar_validation(s, s, mapping, {**ARTIFACT, "decision_threshold": 0.5}))


@query("i6_intelligence", "v_labels", "v_event_predictions", "v_predictions", sql="""
WITH s AS (SELECT event_id FROM v_labels WHERE source_key LIKE 'demo:sar:event:%' ORDER BY observed_start_date DESC NULLS LAST, event_id DESC LIMIT 1), m AS (SELECT AVG(probability) AS p FROM v_predictions),
q AS (SELECT s.event_id, (SELECT AVG(probability) FROM v_event_predictions e WHERE e.event_id = s.event_id) AS ep, m.p FROM s, m)
SELECT event_id, TRUE AS sar_detected, ROUND(COALESCE(ep, p), 6) AS mean_probability, CASE WHEN COALESCE(ep, p) < 0.25e0 THEN 'LOW' WHEN COALESCE(ep, p) < 0.5e0 THEN 'MODERATE' WHEN COALESCE(ep, p) < 0.75e0 THEN 'HIGH' ELSE 'CRITICAL' END AS warning_level,
  TRUE AS susceptibility_available, FALSE AS forecast_available FROM q""")
def i6(v):
    r = products.intelligence_summary(v.v_labels, v.v_event_predictions, v.v_predictions)
    return rounded(r.select("event_id", "sar_detected", "mean_probability", "warning_level", "susceptibility_available", "forecast_available"), mean_probability=6)


@query("i7_risk_reasons", "v_cells", "v_predictions", sql="""
SELECT cell_id, p.probability, CONCAT_WS(',', CASE WHEN elevation_mean_m <= 3 OR elevation_mean_m * 5 <= 35 THEN 'low_elevation' END, CASE WHEN distance_to_waterway_m <= 600 THEN 'near_waterway' END, 'heavy_rainfall',
  CASE WHEN p.historical_event_count > 0 OR p.flooded_fraction >= 0.05e0 THEN 'flood_history' END) AS reasons FROM v_cells JOIN v_predictions p USING (cell_id)""")
def i7(v):
    cells = v.v_cells.withColumn("elevation_percentile", F.col("elevation_mean_m") * 5)
    screening = v.v_cells.select("cell_id", F.col("elevation_mean_m").alias("screening_score"))
    none = v.v_predictions.where("cell_id < 0")
    anomaly = v.v_cells.agg(F.lit(25.0).alias("anomaly_pct"))
    r = products.risk_reasons(cells, screening, v.v_predictions, none, anomaly)
    return r.select("cell_id", "probability", F.array_join("reasons", ",").alias("reasons"))


@query("m28_forecast_run", "v_cells", "v_rain")
def m28(v):
    last = v.v_rain.agg(F.max("observed_date")).first()[0]
    day = F.col("observed_date").alias("date")
    f = v.v_rain.where(F.date_diff(F.lit(last), "observed_date") <= 6).select(day, F.col("max_precipitation_mm").alias("precipitation_mm"))
    h = v.v_rain.select(day, F.col("mean_precipitation_mm").alias("precipitation_mm"))
    n = len(K.EVENT_FEATURES)
    artifact = {"feature_names": K.EVENT_FEATURES, "mean": [0.0] * n, "scale": [100.0] * n, "coefficients": [0.05] * n, "intercept": -3.0, "decision_threshold": 0.5}
    run, _ = products.forecast_run(catalog(v), f, h, artifact, last, "forecast-demo")
    return run.drop("created_at", "limitations")


@query("m29_run_predictions", "v_runs", "v_predictions", sql="""
WITH p AS (SELECT (SELECT run_version FROM v_runs WHERE status = 'completed' ORDER BY created_at DESC, run_version DESC LIMIT 1) AS run_version, probability FROM v_predictions WHERE model_version = 'm1')
SELECT COUNT(*) AS total_cells, ROUND(AVG(probability), 6) AS mean_probability, COUNT(*) FILTER (WHERE probability >= 0.5e0) AS flagged_cells FROM p""")
def m29(v):
    newest = v.v_runs.where("status = 'completed'").agg(F.max_by("run_version", F.struct("created_at", "run_version")).alias("run_version"))
    p = with_band(v.v_predictions.where("model_version = 'm1'")).crossJoin(F.broadcast(newest))
    other = with_band(v.v_predictions.where("model_version = 'm2'")).withColumn("run_version", F.lit("other"))
    _, s = products.run_predictions(v.v_runs, p.unionByName(other))
    return rounded(s.select("total_cells", "mean_probability", "flagged_cells"), mean_probability=6)



