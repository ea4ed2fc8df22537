"""Hand values and brute-force checks of metrics, thresholds and models."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.operators import ranking
from hydrolens.plans import features, training
from hydrolens.plans import metrics as M


def frame(spark, labels, scores, water=None):
    water = water or [0.0] * len(labels)
    return spark.createDataFrame([(i, int(y), float(p), float(w)) for i, (y, p, w) in enumerate(zip(labels, scores, water))],
                                 "row_key int, label int, probability double, surface_water double")


def test_perfect_ranking(spark):
    r = M.evaluate(frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()
    assert (r.roc_auc, r.pr_auc, r.f1) == (1.0, 1.0, 1.0)


def test_metrics_against_brute_force(spark):
    rng = random.Random(5)
    y = [int(rng.random() < 0.3) for _ in range(400)]
    p = [round(rng.random(), 2) for _ in range(400)]
    r = M.evaluate(frame(spark, y, p), threshold=0.4, digits=None).first()
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    order = sorted(range(400), key=lambda i: (-p[i], i))
    tp, ap = 0, 0.0
    for rank, i in enumerate(order, 1):
        tp += y[i]
        ap += y[i] * tp / rank
    assert r.roc_auc == pytest.approx(auc) and r.pr_auc == pytest.approx(ap / len(pos))
    assert r.tp == sum(1 for a, b in zip(p, y) if a >= 0.4 and b)


def test_running_totals_over_many_ranges(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("hot"), (F.col("id") * 7919 % 97).alias("v"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ranking.running_totals(df, [("v", True), ("k", True)], ["hot"], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for hot in (0, 1):
        total = 0
        for i, r in enumerate(sorted((r for r in rows if r.hot == hot), key=lambda r: (r.v, r.k)), 1):
            total += r.v
            assert (r.row_rank, r.v_running) == (i, total)


def test_balanced_threshold(spark):
    r = M.pick_threshold(M.threshold_sweep(frame(spark, [0, 0, 1, 1], [0.1, 0.4, 0.45, 0.9])), "balanced").first()
    assert 0.4 < r.threshold <= 0.45 and r.f1 == 1.0


def test_threshold_floors(spark):
    swept = M.threshold_sweep(frame(spark, [0, 0, 0, 1, 1, 1], [0.05, 0.55, 0.60, 0.58, 0.70, 0.95]))
    b, c = M.pick_threshold(swept, "balanced").first(), M.pick_threshold(swept, "conservative", minimum_recall=0.6).first()
    assert c.threshold >= b.threshold and c.precision >= b.precision and c.recall >= 0.6
    swept = M.threshold_sweep(frame(spark, [0, 0, 0, 0, 1, 1, 1, 1], [0.12, 0.18, 0.24, 0.30, 0.22, 0.40, 0.75, 0.95]))
    b, s = M.pick_threshold(swept, "balanced").first(), M.pick_threshold(swept, "screening", minimum_precision=0.5).first()
    assert s.threshold <= b.threshold and s.recall >= b.recall and s.precision >= 0.5


def test_profile_tempers_water(spark):
    df = frame(spark, [1, 1, 0, 0, 0, 0], [0.9, 0.7, 0.85, 0.65, 0.2, 0.1], [0.0, 0.1, 1.0, 0.9, 0.0, 0.0])
    r = M.select_profile(df, "conservative", minimum_recall=0.4).first()
    assert 0 <= r.water_temper_beta <= 0.8 and r.precision >= 0.4 and r.recall >= 0.4


def test_calibration_and_ranking(spark):
    r = M.calibration(frame(spark, [0, 0, 1, 1], [0.0, 0.0, 1.0, 1.0]), bins=4).first()
    assert (r.expected_calibration_error, r.maximum_calibration_error) == (0.0, 0.0)
    t = M.ranking(frame(spark, [1, 0, 1, 0, 0], [0.95, 0.8, 0.6, 0.3, 0.1]), [0.4]).first()
    assert (t.cells, t.true_positive_cells, t.precision) == (2, 1, 0.5)


def test_logistic_learns_and_matches_descent(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x, z = rng.gauss(0, 1), rng.gauss(0, 2)
        rows.append((x, z, int(rng.random() < 1 / (1 + math.exp(-(1.2 * x - 0.5 * z))))))
    df = spark.createDataFrame(rows, "x double, z double, target_label int")
    a = training.fit_logistic(df, ["x", "z"])
    assert a["coefficients"][0] > 0 > a["coefficients"][1]
    # plain full-batch descent on the same objective
    n, pos = len(rows), sum(r[2] for r in rows)
    weight = [n / (2 * pos) if r[2] else n / (2 * (n - pos)) for r in rows]
    data = [[(r[j] - a["mean"][j]) / a["scale"][j] for j in (0, 1)] for r in rows]
    w, b = [0.0, 0.0], 0.0
    for _ in range(3000):
        err = [(1 / (1 + math.exp(-(w[0] * d[0] + w[1] * d[1] + b))) - r[2]) * k for d, r, k in zip(data, rows, weight)]
        grad = [sum(e * d[j] for e, d in zip(err, data)) / sum(weight) + 0.01 * w[j] for j in (0, 1)]
        w = [w[j] - 0.5 * grad[j] for j in (0, 1)]
        b -= 0.5 * sum(err) / sum(weight)
    assert a["coefficients"] == pytest.approx(w, abs=1e-4) and a["intercept"] == pytest.approx(b, abs=1e-4)
    with pytest.raises(ValueError):
        training.fit_logistic(df.where("target_label = 1"), ["x"])


def test_rolling_origin(spark):
    rows = []
    for e in range(5):
        for c in range(8):
            positive = c < 2 + e % 2
            rows.append((f"{e + 1}", dt.date(2010 + e, 1, 1), e * 8 + c, 20.0 + 15 * e + (8 if positive else 0), 0.2 if positive else 0.8, 0.1 if positive else 0.6, int(positive)))
    df = spark.createDataFrame(rows, "event_id string, event_start_date date, row_key int, rain double, elevation double, water double, target_label int")
    report = training.rolling_origin(df, ["rain", "elevation", "water"], water="water", positive_scale=0.75)
    summary = {r["mode"]: r for r in report["summary"].collect()}
    assert set(summary) == set(K.THRESHOLD_MODES)
    assert all(r.folds == 2 and 0 <= r.mean_precision <= 1 for r in summary.values())


def test_temporal_split(spark):
    def split(n):
        df = spark.createDataFrame([(str(i), dt.date(2000 + i, 1, 1)) for i in range(1, n + 1)], "event_id string, event_start_date date")
        return {r.event_id: r.temporal_split for r in features.temporal_split(df).collect()}

    assert split(4) == {"1": "train", "2": "train", "3": "validation", "4": "test"}
    many = list(split(17).values())
    assert [many.count(s) for s in ("train", "validation", "test")] == [11, 3, 3]
    with pytest.raises(Exception, match="at least 4"):
        split(1)


def test_engineered_row(spark):
    row = {"distance_to_waterway_m": 125.0, "distance_to_river_m": 125.0, "distance_to_canal_m": 250.0, "hand_mean_m": 3.0, "elevation_percentile": 0.2, "local_relief_m": 1.0,
           "rainfall_accumulation_3d_mm": 60.0, "rainfall_accumulation_7d_mm": 120.0, "rainfall_accumulation_30d_mm": 300.0, "rainfall_max_1d_mm": 40.0,
           "landcover_water_pct": 0.10, "landcover_wetland_pct": 0.20, "landcover_mangrove_pct": 0.05}
    r = features.with_engineered(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))).first()
    assert r.waterway_proximity_index == pytest.approx(2 / 3) and r.surface_water_influence_pct == pytest.approx(0.35) and r.flatness_index == 0.5
    assert (r.rainfall_7d_x_waterway_proximity, r.rainfall_30d_x_low_elevation) == pytest.approx((80, 240))
    assert (r.rainfall_3d_x_surface_water, r.rainfall_7d_x_flatness) == pytest.approx((21, 60))
