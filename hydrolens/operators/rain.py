"""Daily rainfall: weighted statistics, row and calendar windows, anomalies and forecast hours.

A rainfall series has one row per source and calendar day, so its windows are partitioned by source and
hold at most the days of one record. The per-location samples, which do grow, are aggregated before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.operators.relational import merge_rain


def weighted_percentile(df: DataFrame, keys: Sequence[str], value: str, weight: str, p: float, name: str = "percentile") -> DataFrame:
    """First value whose cumulative weight reaches ``p`` of the total.

    Weights are first summed per distinct value, which collapses hot values, and the values of a key are
    then walked in order. A value range of a hot key is split by ``running_totals``.
    """
    from hydrolens.operators.ranking import running_totals

    keys = list(keys)
    by_value = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    running = running_totals(by_value, [(value, True)], keys, ["__w"])
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("__total"))
    reached = running.join(totals, keys).where(F.col("__w_running") >= F.col("__total") * F.lit(p))
    fallback = df.groupBy(*keys).agg(F.max(value).alias("__last"))
    found = reached.groupBy(*keys).agg(F.min(value).alias(name))
    return fallback.join(found, keys, "left").select(*keys, F.coalesce(name, "__last").alias(name))


def daily_rain(samples: DataFrame, keys: Sequence[str] = ("observed_date",), p: float = 0.9) -> DataFrame:
    """Per day: weighted mean over the available weight, maximum, weighted p90 and sample count."""
    keys = list(keys)
    value, weight = F.col("precipitation_mm"), F.col("weight")
    stats = samples.groupBy(*keys).agg(
        (F.sum(value * weight) / F.sum(weight)).alias("mean_precipitation_mm"),
        F.max(value).alias("max_precipitation_mm"),
        F.count(F.lit(1)).alias("grid_cell_count"),
        F.sum(weight).alias("__weight"),
    )
    usable = stats.where(F.col("__weight") > 0).drop("__weight")
    p90 = weighted_percentile(samples, keys, "precipitation_mm", "weight", p, "p90_precipitation_mm")
    return usable.join(p90, keys)


def _rows(partition: Sequence[str], days: int):
    return Window.partitionBy(*partition).orderBy("observed_date").rowsBetween(-(days - 1), 0)


def rolling_rows(rain: DataFrame, days: Sequence[int] = (3, 7, 30), source: Sequence[str] = ("source_key",),
                 value: str = "mean_precipitation_mm") -> DataFrame:
    """Sums over the last n rows of a series; gaps in the record are not filled."""
    return rain.withColumns({f"accumulation_{d}d_mm": F.sum(value).over(_rows(source, d)) for d in days})


def rain_anomaly(rain: DataFrame, source: Sequence[str] = ("source_key",)) -> DataFrame:
    """14-row sum and 7-day anomaly against the mean of the same ISO week over the whole record."""
    week = Window.partitionBy(*source, F.weekofyear("observed_date"))
    return rain.withColumns(
        {
            "accumulation_14d_mm": F.sum("mean_precipitation_mm").over(_rows(source, 14)),
            "rainfall_anomaly_7d": F.col("accumulation_7d_mm")
            / F.greatest(F.avg("accumulation_7d_mm").over(week), F.lit(1.0)),
        }
    )


def rolling_days(rain: DataFrame, days: Sequence[int] = (3, 7, 30), source: Sequence[str] = ("source_key",),
                 date: str = "observed_date", value: str = "mean_precipitation_mm") -> DataFrame:
    """Sums over the last n calendar days ending on each row; missing days count as zero."""
    number = F.unix_date(F.col(date))
    order = Window.partitionBy(*source).orderBy(number)
    return rain.withColumns(
        {f"calendar_{d}d_mm": F.sum(value).over(order.rangeBetween(-(d - 1), 0)) for d in days}
    )


def forecast_rain_features(forecast: DataFrame, history: DataFrame, target, days: Sequence[int] = (3, 7, 30),
                           history_days: int = 30) -> DataFrame:
    """One row of rainfall features for ``target`` from forecast over recent history.

    Both frames hold (date, precipitation_mm). History is read for ``history_days`` before the first
    forecast day. Days without data count as zero.
    """
    first = forecast.agg(F.coalesce(F.min("date"), F.current_date()).alias("__first"))
    recent = history.join(
        F.broadcast(first),  # one row
        (F.col("date") < F.col("__first")) & (F.col("date") >= F.date_sub("__first", history_days)),
    ).select("date", "precipitation_mm")
    merged = merge_rain(forecast, recent)
    day = F.lit(target).cast("date")
    age = F.date_diff(day, F.col("date"))

    def total(n: int) -> Column:
        return F.coalesce(F.sum(F.when(age.between(0, n - 1), F.col("precipitation_mm"))), F.lit(0.0))

    one_day = total(1)
    return merged.agg(
        one_day.alias("rainfall_mean_1d_mm"), one_day.alias("rainfall_max_1d_mm"), one_day.alias("rainfall_p90_1d_mm"),
        *[total(d).alias(f"rainfall_accumulation_{d}d_mm") for d in days],
        F.count(F.lit(1)).alias("days_known"),
    )


def forecast_anomaly(forecast: DataFrame, history: DataFrame, target) -> DataFrame:
    """One row, ``rainfall_anomaly_7d``: the 7-day sum up to ``target`` over the usual one of its ISO week, one without a record of that week.

    The usual sum is the mean of the 7-day sums that end on recorded days of the same ISO week before the first forecast day,
    at least 1 mm. Every recorded day adds to the seven days that it counts for, so no window runs over the whole series.
    """
    first = forecast.agg(F.coalesce(F.min("date"), F.current_date()).alias("__first"))
    past = history.join(F.broadcast(first), F.col("date") < F.col("__first")).groupBy("date").agg(F.avg("precipitation_mm").alias("mm"))  # one row
    ends = past.select("mm", F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda n: F.date_add("date", n))).alias("end"), "date")
    week = F.weekofyear(F.lit(target).cast("date"))
    sums = ends.where(F.weekofyear("end") == week).groupBy("end").agg(F.sum("mm").alias("mm"), F.max(F.col("date") == F.col("end")).alias("known"))
    usual = sums.where("known").agg(F.avg("mm").alias("__usual"))
    now = forecast_rain_features(forecast, history, target, (7,)).select(F.col("rainfall_accumulation_7d_mm").alias("__now"))
    return now.crossJoin(F.broadcast(usual)).select(  # one row each
        F.coalesce(F.col("__now") / F.greatest("__usual", F.when(F.col("__usual").isNotNull(), 1.0)), F.lit(1.0)).alias("rainfall_anomaly_7d")
    )


def rain_anomaly_pct(rain: DataFrame, source: Sequence[str] = ("source_key",)) -> DataFrame:
    """Latest 7-day sum against the mean positive sum of the rows 8 to 366 before the end; null below 14 rows."""
    recency = Window.partitionBy(*source).orderBy(F.col("observed_date").desc())
    ranked = rain.withColumn("__r", F.row_number().over(recency))
    base = F.avg(F.when(F.col("__r").between(8, 366) & (F.col("accumulation_7d_mm") > 0), F.col("accumulation_7d_mm")))
    now = F.max(F.when(F.col("__r") == 1, F.col("accumulation_7d_mm")))
    return ranked.groupBy(*source).agg(now.alias("recent_7d_mm"), base.alias("baseline_7d_mm"), F.count(F.lit(1)).alias("days")).select(
        *source,
        "recent_7d_mm",
        "baseline_7d_mm",
        F.when(F.col("days") >= 14, (F.col("recent_7d_mm") - F.col("baseline_7d_mm")) / F.col("baseline_7d_mm") * 100).alias("anomaly_pct"),
    )


def next_hours(hourly: DataFrame, fetched_at: Column, n: int = 24, keys: Sequence[str] = (), offset_minutes: int = 390) -> DataFrame:
    """Rain and peak probability of the first ``n`` forecast hours from the fetch time on.

    Forecast hours are local wall times; ``offset_minutes`` is their distance from UTC.
    """
    instant = F.unix_seconds(F.col("time").cast("timestamp")) - offset_minutes * 60
    ahead = hourly.where(instant >= F.unix_seconds(fetched_at.cast("timestamp")))
    order = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy("time")
    # a forecast holds a few hundred hours; the rank filter plans as a per-key group limit
    first = ahead.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n)
    return first.groupBy(*keys).agg(
        F.coalesce(F.sum("precipitation_mm"), F.lit(0.0)).alias("rain_mm"),
        F.greatest(F.lit(0), F.max(F.coalesce("probability_percent", F.lit(0)))).alias("peak_probability_percent"),
    )
