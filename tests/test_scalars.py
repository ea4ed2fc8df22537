"""Hand values of scalar rules."""

import pytest
from pyspark.sql import functions as F

from hydrolens.functions import scalars as S
from hydrolens.operators import validate as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_screening_score_and_clipping(spark):
    r = one(spark, a=S.screening(F.lit(10.0), F.lit(20.0), F.lit(30.0)), b=S.screening(F.lit(-5.0), F.lit(-5.0), F.lit(-5.0)),
            c=S.screening(F.lit(150.0), F.lit(150.0), F.lit(150.0)))
    assert (r.a.score, r.a.band) == (84.0, "VERY_HIGH")
    assert (r.b.score, r.c.score) == (100.0, 0.0)


def test_band_edges(spark):
    scores = [0.0, 24.9, 25.0, 49.9, 50.0, 74.9, 75.0, 100.0]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    bands = [r.b for r in df.select("i", S.screening_band("s").alias("b")).orderBy("i").collect()]
    assert bands == ["LOWER", "LOWER", "MODERATE", "MODERATE", "HIGH", "HIGH", "VERY_HIGH", "VERY_HIGH"]
    r = one(spark, a=S.risk_band(F.lit(0.1)), b=S.risk_band(F.lit(0.3)), c=S.risk_band(F.lit(0.6)), d=S.risk_band(F.lit(0.9)))
    assert tuple(r) == ("LOW", "MODERATE", "HIGH", "VERY_HIGH")


def test_fractions_labels_and_temper(spark):
    zero = F.lit(0.0)
    r = one(spark, p=S.as_fraction(F.lit(40.0)), q=S.as_fraction(F.lit(0.4)), dry=S.flood_excess(F.lit(0.35), F.lit(40.0), zero, zero),
            wet=S.flood_excess(F.lit(0.55), F.lit(0.2), zero, zero), t0=S.temper(F.lit(0.8), F.lit(0.0), F.lit(0.5)), t1=S.temper(F.lit(0.8), F.lit(1.0), F.lit(0.5)))
    assert (r.p, r.q, r.dry) == (0.4, 0.4, 0.0)
    assert r.wet == pytest.approx(0.35) and (r.t0, r.t1) == pytest.approx((0.8, 0.4))
    with pytest.raises(ValueError):
        S.target_label(0.1, "other")


def test_water_levels(spark):
    df = spark.createDataFrame([(1, 149.9, 150.0), (2, 150.0, 150.0), (3, 200.0, 150.0), (4, 250.0, 150.0), (5, 250.0, None), (6, None, 150.0)], "i int, x double, w double")
    level = S.classify_level("x", "w", F.lit(200.0), F.lit(250.0))["risk_level"]
    assert [r.l for r in df.select("i", level.alias("l")).orderBy("i").collect()] == ["LOW", "MEDIUM", "HIGH", "CRITICAL", "UNAVAILABLE", "UNAVAILABLE"]


def test_exact_rounding_matches_python(spark):
    values = [0.285, 2.5, 0.03125, 12.35, 1234.5678, -0.125]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        got = [r.y for r in df.select(S.round_exact("x", digits).alias("y")).collect()]
        assert got == [round(v, digits) for v in values]


def test_keys_and_topics(spark):
    r = one(spark, s=S.key_suffix(F.lit(" a/b c ")), e=S.key_suffix(F.lit("//")), t=S.topic_station("a/+/c", F.lit("a/x/c")), u=S.topic_station("a/+/c", F.lit("a/x/d")),
            d=S.parse_iso_date(F.lit("2020-02-30")), g=S.parse_iso_date(F.lit("2020-02-29")).cast("string"))
    assert (r.s, r.e, r.t, r.u, r.d, r.g) == ("a-b-c", None, "x", None, None, "2020-02-29")


def test_satellite_aliases(spark):
    p = F.create_map(*[F.lit(x) for x in ("polarization", "VH", "vh_threshold_db", "-3.0", "resolution_m", "30")])
    m = one(spark, m=S.normalize_sar(p)).m
    assert (m["sar_polarization"], m["sar_vh_threshold_db"], m["processing_scale_m"], m["baseline_window_days"]) == ("VH", "-3.0", "30", "21")


def test_reading_messages(spark):
    from hydrolens.streaming.ingest import ingest

    good = '{"stationId":"s1","timestamp":"2026-01-01T06:30:00+06:30","waterLevelCm":120,"rainfallMm":1,"soilMoisture":40,"batteryLevel":80}'
    rows = [(good, "sensors/s1/readings"), ('{"stationId":"s1","timestamp":"2026-01-01T00:00:00Z","batteryLevel":80}', "sensors/s1/readings"),
            (good, "sensors/s2/readings"), (good.replace("+06:30", ""), "sensors/s1/readings"), (good.replace("rainfallMm", "other"), "sensors/s1/readings"), ("not json", "sensors/s1/readings")]
    valid, rejected = ingest(spark.createDataFrame(rows, "value string, topic string"), "sensors/+/readings")
    assert [r.station_id for r in valid.collect()] == ["s1"]
    found = {v for r in rejected.collect() for v in r.violations}
    assert {"waterLevelCm or rainfallMm is required", "payload station differs from the topic", "timestamp must include a timezone offset",
            "unknown key", "message is not a JSON object"} <= found


def test_incomplete_features_and_duplicates(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (3, 4.0)], "id int, x double")
    assert sorted(r.id for r in V.incomplete_rows(df, ["x"]).collect()) == [2, 3]
    assert V.duplicate_keys(df, ["id"]).collect()[0].id == 3
