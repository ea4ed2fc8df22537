"""Sensor readings as a stream: parse, validate, deduplicate, enrich, alert and keep station state.

Every micro-batch is written under its batch id with replace semantics, so a batch that is replayed after a
failure leaves the same tables. Identities are hashes, never random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.functions import scalars as S
from hydrolens.operators import validate
from hydrolens.operators.joins import enrich_stations, unknown_stations
from hydrolens.sources.readings import parse_readings, to_observation
from hydrolens.sources.versions import VersionedTable, part_name
from hydrolens.session import materialize


def ingest(messages: DataFrame, subscription: str | None = None) -> tuple[DataFrame, DataFrame]:
    """ST1: (valid readings, rejected messages with their violations) of a batch or stream."""
    return checked(parse_readings(messages, subscription))


def checked(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ingest`` for messages that are parsed already."""
    return validate.validate(parsed, {**validate.message_rules(), **validate.topic_rules()})


def dedupe(readings: DataFrame, watermark: str = "1 day") -> DataFrame:
    """ST2, recent part: drop repeats of a key that arrive within the watermark, with bounded state."""
    return readings.withWatermark("observed_at", watermark).dropDuplicatesWithinWatermark(["ingestion_key"])


def dedupe_batch(readings: DataFrame) -> DataFrame:
    """One row per ingestion key: the least by the values of its columns, so that a replay keeps the same one."""
    others = [c for c in readings.columns if c != "ingestion_key"]
    ordered = [f.name for f in readings.schema.fields if f.name in others and f.dataType.typeName() != "map"]
    least = readings.groupBy("ingestion_key").agg(F.min_by(F.struct(*others), F.struct(*ordered)).alias("__row"))
    return least.select(*[F.col(f"__row.{c}") if c != "ingestion_key" else F.col(c) for c in readings.columns])


def to_observations(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """ST3: readings of known stations as observations; station attributes are copied, levels become metres."""
    return to_observation(enrich_stations(readings, stations))


def threshold_alerts(observations: DataFrame) -> DataFrame:
    """ST4: one open alert per observation that crossed a threshold of its station."""
    level = S.classify_level("water_level_cm", "warning_level_cm", "danger_level_cm", "critical_level_cm")
    assessed = observations.withColumn("__a", level).where(F.col("__a.risk_level").isin(*K.ALERT_LEVELS))
    return assessed.select(
        F.col("ingestion_key").alias("observation_key"), "station_id", F.col("__a.risk_level").alias("risk_level"), "water_level_cm",
        F.col("__a.threshold_cm").alias("threshold_cm"), S.alert_message("name", "water_level_cm", "__a.explanation").alias("message"),
        F.lit("open").alias("status"), F.col("observed_at").alias("created_at"),
    )


def update_station_state(stations: DataFrame, readings: DataFrame) -> DataFrame:
    """ST5: stations with their newest reading time; late readings never move it back; offline becomes active."""
    seen = readings.groupBy("station_id").agg(F.max("observed_at").alias("__seen"))
    joined = stations.join(seen, "station_id", "left")
    current = F.col("last_seen_at") if "last_seen_at" in stations.columns else F.lit(None)
    return joined.withColumns(
        {
            "last_seen_at": F.greatest(current.cast("timestamp"), F.col("__seen").cast("timestamp")),
            "status": F.when(F.col("__seen").isNotNull() & (F.col("status") == "offline"), "active").otherwise(F.col("status")),
        }
    ).drop("__seen")


def ingest_counters(received: DataFrame, rejected: DataFrame, unknown: DataFrame, created: DataFrame) -> DataFrame:
    """ST6: one row of counters for a batch; what is neither rejected nor created is a duplicate."""

    def n(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    last = rejected.agg(F.max(F.get("violations", F.lit(0))).alias("last_error"))
    joined = n(received, "received")
    for other in (n(rejected, "invalid"), n(unknown, "unknown_station"), n(created, "created"), last):
        joined = joined.crossJoin(F.broadcast(other))  # one row each
    return joined.withColumn("duplicate", F.col("received") - F.col("invalid") - F.col("unknown_station") - F.col("created"))


def latest_stream(observations: DataFrame) -> DataFrame:
    """ST8: newest observation per station, for update-mode output."""
    fields = [c for c in ("water_level_cm", "rainfall_mm", "battery_percent") if c in observations.columns]
    order = F.struct("observed_at", "ingestion_key")
    return observations.groupBy("station_id").agg(
        F.max("observed_at").alias("observed_at"), *[F.max_by(c, order).alias(c) for c in fields]
    )


# --- the running job ----------------------------------------------------------------------


class IngestJob:
    """Writes observations, alerts, rejects, counters and station state from a stream of messages.

    ``path`` holds ``observations/``, ``alerts/``, ``rejects/``, ``quarantine/`` (valid readings of unknown stations),
    ``counters/`` and ``seen/`` by batch, and ``keys/``, a versioned table by day that is compacted as it grows. Deduplication against history has no time bound:
    the keys of a batch are anti-joined with the key table. The day of a reading is part of its identity, so only the days in the batch are read.
    """

    def __init__(self, spark: SparkSession, path: str, stations: DataFrame, subscription: str | None = None) -> None:
        self.spark, self.path, self.stations, self.subscription = spark, path.rstrip("/"), stations, subscription
        self.keys = VersionedTable(spark, f"{self.path}/keys", ["key_day"])

    def _write(self, df: DataFrame, name: str, batch_id: int, *more: str) -> None:
        (
            df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *more).parquet(f"{self.path}/{name}")
        )

    def _known_keys(self, fresh: DataFrame, batch_id: int) -> DataFrame | None:
        if self.keys.current() is None:
            return None
        # the days of one batch are few; only their folders are listed and read
        days = [part_name(key_day=r.key_day) for r in fresh.select("key_day").distinct().collect()]
        # a replayed batch must not see its own keys
        return self.keys.read(days).where(F.col("batch_id") < batch_id)

    def process(self, messages: DataFrame, batch_id: int) -> None:
        # dealt out by content, since a file of few row groups is read by few tasks; every message is parsed once
        dealt = messages.repartition(2 * self.spark.sparkContext.defaultParallelism, *[c for c in ("value", "topic") if c in messages.columns])
        parsed = materialize(parse_readings(dealt, self.subscription))
        valid, rejected = checked(parsed)
        observed = to_observations(valid, self.stations).withColumn("key_day", S.utc_day("observed_at"))
        fresh = materialize(dedupe_batch(observed))
        known = self._known_keys(fresh, batch_id)
        if known is not None:
            fresh = materialize(fresh.join(known.select("key_day", "ingestion_key"), ["key_day", "ingestion_key"], "left_anti"))
        unknown = materialize(unknown_stations(valid, self.stations))
        self._write(fresh.drop("raw", "topic_station", "timestamp_text", "key_day"), "observations", batch_id)
        self._write(threshold_alerts(fresh), "alerts", batch_id)
        self._write(rejected.select("raw", "violations"), "rejects", batch_id)
        self._write(unknown, "quarantine", batch_id)
        self._write(ingest_counters(parsed, rejected, unknown, fresh), "counters", batch_id)
        self._write(fresh.groupBy("station_id").agg(F.max("observed_at").alias("observed_at")), "seen", batch_id)
        # keys last: a batch counts as stored only when everything before it is
        keys = fresh.select("ingestion_key", "key_day", F.lit(batch_id).cast("bigint").alias("batch_id"))
        self.keys.append(keys.repartition("key_day"), str(batch_id))
        self.keys.compact()

    def start(self, messages: DataFrame, checkpoint: str, available_now: bool = True):
        """ST1-ST7 as one streaming query."""
        writer = messages.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def station_state(self) -> DataFrame:
        """ST5 over the whole history of seen times."""
        return update_station_state(self.stations, self.table("seen"))

    def live_feed(self, after_batch: int = -1) -> DataFrame:
        """ST7: newly created observations, batch by batch."""
        return self.table("observations").where(F.col("batch_id") > after_batch)
