"""Payloads, keyed tables, stream replay and driver contract."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hydrolens.operators import rain as R
from hydrolens.plans import features
from hydrolens.sources import tables
from hydrolens.sources.rain import read_archive
from hydrolens.streaming.ingest import IngestJob


def test_archive_payload(spark, tmp_path):
    days = ["2020-07-01", "2020-07-02"]
    path = tmp_path / "p.json"
    path.write_text(json.dumps([{"daily": {"time": days, "precipitation_sum": [4, 2]}}, {"daily": {"time": days, "precipitation_sum": [8, 6]}}]))
    samples = spark.createDataFrame([(0, 0.25), (1, 0.75)], "position int, weight double")
    a, b = features.build_rain_history(read_archive(spark, str(path), "2020"), samples).orderBy("observed_date").collect()
    assert (a.mean_precipitation_mm, a.max_precipitation_mm, a.p90_precipitation_mm) == (7, 8, 8)
    assert b.accumulation_3d_mm == b.accumulation_7d_mm == 12


def test_forecast_over_history(spark):
    def rows(*items):
        return spark.createDataFrame([(dt.date(2026, m, d), float(x)) for m, d, x in items], "date date, precipitation_mm double")

    none = rows((1, 1, 0)).limit(0)
    r = R.forecast_rain_features(rows((8, 10, 5), (8, 11, 10), (8, 12, 20), (8, 13, 8)), none, "2026-08-12").first()
    assert (r.rainfall_mean_1d_mm, r.rainfall_accumulation_3d_mm, r.rainfall_accumulation_30d_mm) == (20, 35, 35)
    r = R.forecast_rain_features(rows((8, 12, 15)), rows((8, 11, 8), (8, 10, 3), (8, 5, 12), (7, 20, 25)), "2026-08-12").first()
    assert (r.rainfall_accumulation_3d_mm, r.rainfall_accumulation_7d_mm, r.rainfall_accumulation_30d_mm) == (26, 26, 63)
    r = R.forecast_rain_features(none, none, "2026-08-12").first()
    assert r.rainfall_mean_1d_mm == r.rainfall_accumulation_30d_mm == 0


def test_upsert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, kind string")
    second = spark.createDataFrame([("b", 3, "y"), ("c", 4, "y")], "k string, v int, kind string")
    for batch in (first, second, second):
        tables.upsert(spark, path, batch, ["k"], ["kind"])
    assert {(r.k, r.v) for r in tables.read_table(spark, path).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    with pytest.raises(ValueError, match="duplicate"):
        tables.upsert(spark, path, first.union(first), ["k"])


def test_artifact_round_trip(spark, tmp_path):
    tables.save_artifact(spark, {"model_version": "v1", "weights": [1.0]}, str(tmp_path / "a"))
    assert tables.load_artifact(spark, str(tmp_path / "a"), "v1")["coefficients"] == [1.0]
    with pytest.raises(ValueError):
        tables.load_artifact(spark, str(tmp_path / "a"), "v2")


def test_replayed_and_repeated_batches(spark, tmp_path):
    def message(i, level):
        return (json.dumps({"stationId": "s1", "timestamp": f"2026-01-01T00:{i:02d}:00Z", "waterLevelCm": level}), "sensors/s1/readings")

    stations = spark.createDataFrame([("s1", "Bridge", "offline", 100.0, 150.0, 200.0)], "station_id string, name string, status string, warning_level_cm double, danger_level_cm double, critical_level_cm double")
    job = IngestJob(spark, str(tmp_path / "job"), stations, "sensors/+/readings")
    schema = "value string, topic string"
    one = spark.createDataFrame([message(i, 90 + 40 * i) for i in range(4)] + [("bad", "sensors/s1/readings")], schema)
    two = spark.createDataFrame([message(3, 210), message(4, 120), message(4, 120)], schema)
    for batch, data in ((0, one), (1, two), (1, two)):  # the last call replays a batch
        job.process(data, batch)
    assert job.table("observations").count() == 5
    assert sorted(r.risk_level for r in job.table("alerts").collect()) == ["CRITICAL", "HIGH", "MEDIUM", "MEDIUM"]
    c = {r.batch_id: (r.received, r.invalid, r.created, r.duplicate) for r in job.table("counters").collect()}
    assert c == {0: (5, 1, 4, 0), 1: (3, 0, 1, 2)}
    state = job.station_state().first()
    assert state.status == "active" and state.last_seen_at == dt.datetime(2026, 1, 1, 0, 4)


def test_unknown_stations_are_kept(spark, tmp_path):
    def message(station, i):
        return (json.dumps({"stationId": station, "timestamp": f"2026-01-01T00:{i:02d}:00Z", "waterLevelCm": 90}), f"sensors/{station}/readings")

    stations = spark.createDataFrame([("s1", "Bridge", "active", 100.0, 150.0, 200.0)], "station_id string, name string, status string, warning_level_cm double, danger_level_cm double, critical_level_cm double")
    job = IngestJob(spark, str(tmp_path / "job"), stations, "sensors/+/readings")
    for batch in (0, 1, 1):
        job.process(spark.createDataFrame([message("s1", batch), message("s9", batch)], "value string, topic string"), batch)
    assert sorted((r.batch_id, r.station_id) for r in job.table("quarantine").collect()) == [(0, "s9"), (1, "s9")]
    assert job.table("observations").count() == 2


def test_keys_do_not_follow_the_session_zone(spark):
    from hydrolens.functions import scalars as S

    instants = spark.createDataFrame([(m,) for m in (0, -1, 1_767_225_599_999_999, 1_767_225_600_000_000, 951_782_400_123_456)], "m long").select("m", F.timestamp_micros("m").alias("t"))
    seen = []
    try:
        for zone in ("UTC", "Asia/Yangon", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.append([tuple(r) for r in instants.select("m", S.canonical_timestamp("t"), S.ingestion_key(F.lit("s"), "t", F.lit("x")), S.utc_day("t").cast("string")).orderBy("m").collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen[0] == seen[1] == seen[2]
    want = [(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=r[0])) for r in seen[0]]
    assert [r[1] for r in seen[0]] == [w.strftime("%Y-%m-%dT%H:%M:%S.%f") for w in want] and [r[3] for r in seen[0]] == [w.strftime("%Y-%m-%d") for w in want]


def test_registered_queries_have_matching_contract():
    from __spark_entry__ import oracle_sql, queries

    names = set(queries())
    assert len(names) > 150 and set(oracle_sql()) <= names
