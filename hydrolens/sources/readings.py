"""Sensor reading messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens.functions import scalars as S

MESSAGE = (
    "stationId string, timestamp string, waterLevelCm double, rainfallMm double, soilMoisture double, batteryLevel double, source string"
)


def parse_readings(messages: DataFrame, subscription: str | None = None, raw: str = "value", topic: str = "topic") -> DataFrame:
    """IO5: typed readings next to their raw message; works on batches and streams.

    Malformed messages keep null fields and are caught by the rules. The station captured from the topic is
    kept for comparison with the payload.
    """
    text = F.col(raw).cast("string")
    m = F.from_json(text, MESSAGE, {"mode": "PERMISSIVE"})
    captured = S.topic_station(subscription, topic) if subscription else F.lit(None).cast("string")
    others = [c for c in messages.columns if c not in (raw, topic)]
    return messages.select(*others, text.alias("raw"), captured.alias("topic_station"), m.alias("m")).select(
        *others,
        "raw",
        "topic_station",
        F.col("m.stationId").alias("station_id"),
        F.col("m.timestamp").alias("timestamp_text"),
        F.try_to_timestamp("m.timestamp").alias("observed_at"),
        F.col("m.waterLevelCm").alias("water_level_cm"),
        F.col("m.rainfallMm").alias("rainfall_mm"),
        F.col("m.soilMoisture").alias("soil_moisture_percent"),
        F.col("m.batteryLevel").alias("battery_percent"),
        F.trim(F.coalesce("m.source", F.lit("esp32"))).alias("source"),
    )


def to_observation(readings: DataFrame) -> DataFrame:
    """readings joined with their station, as unverified observations with a stable identity."""
    key = S.ingestion_key("station_id", "observed_at", "source")
    return readings.withColumns(
        {
            "ingestion_key": key,
            "water_level_m": F.col("water_level_cm") / 100,
            "discharge_m3s": F.lit(None).cast("double"),
            "quality_status": F.lit("unverified"),
        }
    )
