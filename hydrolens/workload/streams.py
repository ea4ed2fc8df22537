"""ST: the reading stream. Every query here runs a real streaming query over the events table, until it is read."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrolens.functions import scalars as S
from hydrolens.session import scratch_path
from hydrolens.streaming import ingest as ST
from hydrolens.sources.readings import to_observation
from hydrolens.workload.registry import query
from hydrolens.workload.scalars import CROSSED, KEY_SQL, LEVEL

SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()),
    ]
)


def messages(v, repeat: int = 1):
    """The events table as a stream of JSON messages; ``repeat`` sends each of them several times."""
    e = v.spark.readStream.schema(SCHEMA).parquet(f"{v.directory}/event[s].parquet")
    if repeat > 1:
        e = e.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).drop("copy")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    # every eleventh message lies about its station
    station = F.col("user_id").cast("string")
    body = F.to_json(
        F.struct(
            station.alias("stationId"), stamp.alias("timestamp"), F.when(F.col("event_type") != "view", F.col("value")).alias("waterLevelCm"),
            F.when(F.col("event_type").isin("view", "purchase"), F.col("value") / 10).alias("rainfallMm"), F.col("event_type").alias("source"),
        )
    )
    named = F.when(F.col("event_id") % 11 == 0, F.lit("other")).otherwise(station)
    return e.select(body.alias("value"), F.concat(F.lit("sensors/"), named, F.lit("/readings")).alias("topic"))


def stations(v):
    return v.v_stations.withColumn("station_id", F.col("station_id").cast("string"))


def job(v, repeat: int = 1) -> ST.IngestJob:
    path = scratch_path(v.spark, "ingest")
    running = ST.IngestJob(v.spark, f"{path}/tables", stations(v), "sensors/+/readings")
    running.start(messages(v, repeat), f"{path}/state").awaitTermination()
    return running


GOOD = "r.message_id % 11 <> 0"
KEYED = f"(SELECT DISTINCT {KEY_SQL} AS k, CAST(r.station_id AS VARCHAR) AS station_id, r.station_id AS sid, r.observed_at, r.water_level_cm, r.rainfall_mm FROM v_readings r WHERE {GOOD})"


@query("st1_ingest", "v_readings", "v_stations", sql=f"""
SELECT 'payload station differs from the topic' AS violation, COUNT(*) AS rows FROM v_readings r WHERE NOT ({GOOD})""")
def st1(v):
    rejects = job(v).table("rejects")
    return rejects.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("rows"))


@query("st2_dedupe", "v_readings", "v_stations", sql=f"""
SELECT r.k AS ingestion_key, r.station_id, r.water_level_cm / 100e0 AS water_level_m, r.rainfall_mm FROM {KEYED} r JOIN v_stations s ON r.sid = s.station_id""")
def st2(v):
    return job(v, repeat=2).table("observations").select("ingestion_key", "station_id", "water_level_m", "rainfall_mm")


@query("st2_dedupe_watermark", "v_readings", sql=f"SELECT DISTINCT {KEY_SQL} AS ingestion_key FROM v_readings r")
def st2_watermark(v):
    path = scratch_path(v.spark, "watermark")
    e = v.spark.readStream.schema(SCHEMA).parquet(f"{v.directory}/event[s].parquet")
    twice = e.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).select(
        F.col("user_id").alias("station_id"), F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("observed_at"), F.col("event_type").alias("source")
    )
    keyed = twice.withColumn("ingestion_key", S.ingestion_key("station_id", "observed_at", "source"))
    sink = ST.dedupe(keyed).select("ingestion_key").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{path}/out")


@query("st3_to_observations", "v_readings", "v_stations", sql=f"""
SELECT {KEY_SQL} AS ingestion_key, s.name, r.water_level_cm / 100e0 AS water_level_m, 'unverified' AS quality_status FROM v_readings r JOIN v_stations s ON r.station_id = s.station_id""")
def st3(v):
    return ST.to_observations(v.v_readings, v.v_stations).select("ingestion_key", "name", "water_level_m", "quality_status")


@query("st4_threshold_alerts", "v_readings", "v_stations", sql=f"""
SELECT observation_key, risk_level, threshold_cm FROM (SELECT r.k AS observation_key, {LEVEL} AS risk_level, {CROSSED} AS threshold_cm FROM {KEYED} r JOIN v_stations s ON r.sid = s.station_id)
WHERE risk_level IN ('MEDIUM', 'HIGH', 'CRITICAL')""")
def st4(v):
    return job(v).table("alerts").select("observation_key", "risk_level", "threshold_cm")


@query("st4_threshold_alerts_batch", "v_readings", "v_stations", sql=f"""
SELECT observation_key, risk_level, threshold_cm FROM (SELECT {KEY_SQL} AS observation_key, {LEVEL} AS risk_level, {CROSSED} AS threshold_cm FROM v_readings r JOIN v_stations s ON r.station_id = s.station_id)
WHERE risk_level IN ('MEDIUM', 'HIGH', 'CRITICAL')""")
def st4_batch(v):
    return ST.threshold_alerts(ST.to_observations(v.v_readings, v.v_stations)).select("observation_key", "risk_level", "threshold_cm")


@query("st5_station_state", "v_readings", "v_stations", sql=f"""
SELECT CAST(s.station_id AS VARCHAR) AS station_id, CASE WHEN s.status = 'offline' AND r.n > 0 THEN 'active' ELSE s.status END AS status, r.n > 0 AS seen
FROM v_stations s LEFT JOIN (SELECT station_id, COUNT(*) AS n FROM v_readings r WHERE {GOOD} GROUP BY station_id) r ON s.station_id = r.station_id""")
def st5(v):
    state = job(v).station_state()
    seen = F.when(F.col("last_seen_at").isNotNull(), F.lit(True))
    return state.select("station_id", "status", seen.alias("seen"))


@query("st6_counters", "v_readings", "v_stations", sql=f"""
SELECT COUNT(*) * 2 AS received, COUNT(*) FILTER (WHERE NOT ({GOOD})) * 2 AS invalid, (SELECT COUNT(*) FROM {KEYED} r JOIN v_stations s ON r.sid = s.station_id) AS created FROM v_readings r""")
def st6(v):
    counters = job(v, repeat=2).table("counters")
    return counters.agg(*[F.sum(c).alias(c) for c in ("received", "invalid", "created")])


@query("st7_live_feed", "v_readings", "v_stations", sql=f"SELECT r.k AS ingestion_key FROM {KEYED} r JOIN v_stations s ON r.sid = s.station_id")
def st7(v):
    return job(v).live_feed().select("ingestion_key")


@query("st8_latest", "v_readings", sql=f"""
SELECT station_id, water_level_cm, rainfall_mm FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.station_id ORDER BY r.observed_at DESC, {KEY_SQL} DESC) AS n FROM v_readings r) WHERE n = 1""")
def st8(v):
    """Update-mode aggregation written by batch; the newest batch of a station is its state."""
    path = scratch_path(v.spark, "latest")
    e = v.spark.readStream.schema(SCHEMA).parquet(f"{v.directory}/event[s].parquet")
    readings = e.select(
        F.col("user_id").alias("station_id"), F.col("ts").alias("observed_at"), F.when(F.col("event_type") != "view", F.col("value")).alias("water_level_cm"),
        F.when(F.col("event_type").isin("view", "purchase"), F.col("value") / 10).alias("rainfall_mm"), F.col("event_type").alias("source"),
    )

    def store(batch, batch_id):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/out")

    stream = ST.latest_stream(to_observation(readings)).writeStream.outputMode("update").foreachBatch(store)
    stream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = v.spark.read.parquet(f"{path}/out")
    newest = out.groupBy("station_id").agg(F.max_by(F.struct("water_level_cm", "rainfall_mm"), "batch_id").alias("s"))
    return newest.select("station_id", "s.water_level_cm", "s.rainfall_mm")


