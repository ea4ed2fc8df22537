"""Weather payloads: archive and forecast documents with parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = "daily struct<time:array<string>,precipitation_sum:array<double>>"
FORECAST = (
    "latitude double, longitude double, timezone string,"
    " hourly struct<time:array<string>,precipitation:array<double>,precipitation_probability:array<double>>,"
    " daily struct<time:array<string>,precipitation_sum:array<double>,precipitation_probability_max:array<double>>"
)


def read_archive(spark: SparkSession, path: str, chunk: str) -> DataFrame:
    """Archive documents of one chunk: a list of locations, or a single location object."""
    raw = spark.read.text(path, wholetext=True)
    item = F.coalesce(
        F.from_json("value", f"array<struct<{ARCHIVE.replace('daily ', 'daily:')}>>"),
        F.array(F.from_json("value", f"struct<{ARCHIVE.replace('daily ', 'daily:')}>")),
    )
    return raw.select(F.lit(chunk).alias("chunk"), item.alias("locations"))


def explode_archive(payloads: DataFrame, samples: DataFrame) -> DataFrame:
    """IO3: (observed_date, precipitation_mm, weight, chunk) per location and day.

    ``payloads`` has ``chunk`` and ``locations`` (array of daily arrays); ``samples`` has (position, weight). Null
    values are dropped, negative ones become zero, and unequal arrays or location counts fail the job.
    """
    expected = samples.agg(F.count(F.lit(1)).alias("__expected"))
    checked = payloads.crossJoin(F.broadcast(expected)).select(  # one row
        "chunk",
        F.posexplode(
            F.when(F.size("locations") != F.col("__expected"), F.raise_error(F.lit("unexpected location count"))).otherwise(F.col("locations"))
        ).alias("position", "location"),
    )
    times, values = F.col("location.daily.time"), F.col("location.daily.precipitation_sum")
    days = F.when(
        F.coalesce(F.size(times), F.lit(0)) != F.coalesce(F.size(values), F.lit(0)), F.raise_error(F.lit("inconsistent daily arrays"))
    ).otherwise(F.arrays_zip(times.alias("time"), values.alias("value")))
    rows = checked.select("chunk", "position", F.explode(days).alias("d")).where(F.col("d.value").isNotNull())
    return rows.join(samples.select("position", "weight"), "position").select(
        F.to_date("d.time").alias("observed_date"),
        F.greatest(F.lit(0.0), F.col("d.value")).alias("precipitation_mm"),
        "weight",
        "chunk",
    )


def explode_forecast(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO4: (hourly rows, daily rows, rejected payloads).

    Missing precipitation counts as zero; probabilities may be short or missing. A payload whose time and
    precipitation arrays differ in length is rejected as a whole.
    """

    def length(c: str):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))

    bad = (length("hourly.time") != length("hourly.precipitation")) | (length("daily.time") != length("daily.precipitation_sum"))
    good = payloads.where(~bad)

    def rows(part: str, value: str, probability: str, time: str, kind: str, value_name: str, probability_name: str) -> DataFrame:
        others = [c for c in payloads.columns if c not in ("hourly", "daily")]
        exploded = good.select(*others, F.posexplode(f"{part}.time").alias("__i", time), part)
        return exploded.select(
            *others,
            F.col(time).cast(kind).alias(time),
            F.coalesce(F.get(f"{part}.{value}", F.col("__i")), F.lit(0.0)).alias(value_name),
            F.get(f"{part}.{probability}", F.col("__i")).cast("int").alias(probability_name),
        )

    hourly = rows("hourly", "precipitation", "precipitation_probability", "time", "timestamp_ntz", "precipitation_mm", "probability_percent")
    daily = rows("daily", "precipitation_sum", "precipitation_probability_max", "date", "date", "precipitation_sum_mm", "probability_max_percent")
    return hourly, daily, payloads.where(bad)
