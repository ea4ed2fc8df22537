"""Rainfall: statistics, windows, forecast features."""

from pyspark.sql import functions as F

from hydrolens.operators import aggregates as A
from hydrolens.operators import rain as R
from hydrolens.workload.registry import near, nudged, query

P90 = """(SELECT observed_date, MIN(precipitation_mm) FILTER (WHERE cum >= total * 0.9e0) AS p90 FROM (
  SELECT observed_date, precipitation_mm, SUM(weight) OVER (PARTITION BY observed_date ORDER BY precipitation_mm, weight, sample_id ROWS UNBOUNDED PRECEDING) AS cum,
    SUM(weight) OVER (PARTITION BY observed_date) AS total FROM v_rain_samples) GROUP BY observed_date)"""


@query("a14_daily_rain", "v_rain_samples", "v_rain", sql=f"""
SELECT r.observed_date, {near('r.mean_precipitation_mm')} AS mean_precipitation_mm, r.max_precipitation_mm, r.grid_cell_count, p.p90 AS p90_precipitation_mm
FROM v_rain r JOIN {P90} p ON r.observed_date = p.observed_date""")
def a14(v):
    return nudged(R.daily_rain(v.v_rain_samples), mean_precipitation_mm=6)


@query("w8_weighted_percentile", "v_rain_samples", sql="""
SELECT CAST(month AS DATE) AS month, MIN(precipitation_mm) FILTER (WHERE cum >= total * 0.9e0) AS p90 FROM (
  SELECT date_trunc('month', observed_date) AS month, precipitation_mm,
    SUM(weight) OVER (PARTITION BY date_trunc('month', observed_date) ORDER BY precipitation_mm, sample_id ROWS UNBOUNDED PRECEDING) AS cum,
    SUM(weight) OVER (PARTITION BY date_trunc('month', observed_date)) AS total FROM v_rain_samples) GROUP BY month""")
def w8(v):
    s = v.v_rain_samples.withColumn("month", F.trunc("observed_date", "month"))
    return R.weighted_percentile(s, ["month"], "precipitation_mm", "weight", 0.9, "p90")


@query("a15_rain_summary", "v_history", sql=f"""
SELECT MIN(observed_date) AS start_date, MAX(observed_date) AS end_date, COUNT(*) AS days, COUNT(*) FILTER (WHERE mean_precipitation_mm >= 1) AS wet_days,
  {near('SUM(mean_precipitation_mm)', 4)} AS total_mean_precipitation_mm, {near('MAX(mean_precipitation_mm)')} AS peak_daily_mean_mm,
  (SELECT observed_date FROM v_history ORDER BY mean_precipitation_mm DESC, observed_date LIMIT 1) AS peak_daily_mean_date,
  {near('MAX(accumulation_7d_mm)')} AS peak_7d_mm, (SELECT observed_date FROM v_history ORDER BY accumulation_7d_mm DESC, observed_date LIMIT 1) AS peak_7d_end_date,
  MAX(grid_cell_count) AS grid_cell_count FROM v_history""")
def a15(v):
    return nudged(A.rain_summary(v.v_history), total_mean_precipitation_mm=4, peak_daily_mean_mm=6, peak_7d_mm=6)


def series(v):
    """One rainfall series per source: the whole record, and each weight class on its own."""
    s = v.v_rain_samples.withColumn("source_key", F.concat(F.lit("w"), F.col("weight").cast("int")))
    g = s.groupBy("source_key", "observed_date").agg(F.avg("precipitation_mm").alias("mean_precipitation_mm"))
    return R.rolling_rows(g)


SERIES = """series AS (SELECT CONCAT('w', CAST(weight AS INT)) AS source_key, observed_date, AVG(precipitation_mm) AS mean_precipitation_mm FROM v_rain_samples GROUP BY 1, 2),
rolled AS (SELECT *, SUM(mean_precipitation_mm) OVER (PARTITION BY source_key ORDER BY observed_date ROWS 2 PRECEDING) AS accumulation_3d_mm,
  SUM(mean_precipitation_mm) OVER (PARTITION BY source_key ORDER BY observed_date ROWS 6 PRECEDING) AS accumulation_7d_mm,
  SUM(mean_precipitation_mm) OVER (PARTITION BY source_key ORDER BY observed_date ROWS 29 PRECEDING) AS accumulation_30d_mm FROM series)"""


@query("w3_rolling_rows", "v_rain_samples", sql=f"""WITH {SERIES}
SELECT source_key, observed_date, {near('accumulation_3d_mm', 5)} AS a3, {near('accumulation_7d_mm', 5)} AS a7, {near('accumulation_30d_mm', 5)} AS a30 FROM rolled""")
def w3(v):
    r = series(v).select("source_key", "observed_date", *[F.col(f"accumulation_{d}d_mm").alias(f"a{d}") for d in (3, 7, 30)])
    return nudged(r, a3=5, a7=5, a30=5)


@query("w4_rain_anomaly", "v_rain_samples", sql=f"""WITH {SERIES}
SELECT source_key, observed_date, {near('SUM(mean_precipitation_mm) OVER (PARTITION BY source_key ORDER BY observed_date ROWS 13 PRECEDING)', 5)} AS a14,
  {near('accumulation_7d_mm / GREATEST(AVG(accumulation_7d_mm) OVER (PARTITION BY source_key, weekofyear(observed_date)), 1e0)', 8)} AS anomaly FROM rolled""")
def w4(v):
    r = R.rain_anomaly(series(v)).select("source_key", "observed_date", F.col("accumulation_14d_mm").alias("a14"), F.col("rainfall_anomaly_7d").alias("anomaly"))
    return nudged(r, a14=5, anomaly=8)


@query("w5_rolling_days", "v_rain_samples", sql=f"""WITH {SERIES}
SELECT source_key, observed_date, {near('SUM(mean_precipitation_mm) OVER (PARTITION BY source_key ORDER BY observed_date RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW)', 5)} AS c3,
  {near('SUM(mean_precipitation_mm) OVER (PARTITION BY source_key ORDER BY observed_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)', 5)} AS c30 FROM rolled""")
def w5(v):
    r = R.rolling_days(series(v)).select("source_key", "observed_date", F.col("calendar_3d_mm").alias("c3"), F.col("calendar_30d_mm").alias("c30"))
    return nudged(r, c3=5, c30=5)


@query("w13_rain_anomaly_pct", "v_rain_samples", sql=f"""WITH {SERIES},
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_key ORDER BY observed_date DESC) AS r FROM rolled),
agg AS (SELECT source_key, MAX(accumulation_7d_mm) FILTER (WHERE r = 1) AS recent, AVG(accumulation_7d_mm) FILTER (WHERE r BETWEEN 8 AND 366 AND accumulation_7d_mm > 0) AS base FROM ranked GROUP BY source_key)
SELECT source_key, {near('(recent - base) / base * 100', 7)} AS anomaly_pct FROM agg""")
def w13(v):
    return nudged(R.rain_anomaly_pct(series(v)).select("source_key", "anomaly_pct"), anomaly_pct=7)


@query("w14_next_hours", "v_readings", sql="""
WITH h AS (SELECT station_id, message_id, observed_at AS time, COALESCE(rainfall_mm, 0e0) AS mm, CASE WHEN message_id % 4 = 0 THEN NULL ELSE CAST(battery_percent AS INT) END AS p,
  ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY observed_at) AS n FROM v_readings WHERE observed_at - INTERVAL 390 MINUTES >= TIMESTAMP '2024-01-10')
SELECT station_id, ROUND(SUM(mm), 6) AS rain_mm, GREATEST(0, MAX(COALESCE(p, 0))) AS peak_probability_percent FROM h WHERE n <= 24 GROUP BY station_id""")
def w14(v):
    h = v.v_readings.select(
        "station_id", F.col("observed_at").alias("time"), F.coalesce("rainfall_mm", F.lit(0.0)).alias("precipitation_mm"),
        F.when(F.col("message_id") % 4 != 0, F.col("battery_percent").cast("int")).alias("probability_percent"),
    )
    # instants are compared in whole seconds, in the zone of the session for both sides
    r = R.next_hours(h, F.lit("2024-01-10 00:00:00"), 24, ["station_id"])
    return r.withColumn("rain_mm", F.round("rain_mm", 6))


@query("d5_rain_history", "v_rain_samples", "v_rain", sql=f"""
WITH p AS {P90}
SELECT r.observed_date, {near('r.mean_precipitation_mm')} AS mean_precipitation_mm, p.p90 AS p90_precipitation_mm,
  {near('SUM(r.mean_precipitation_mm) OVER (ORDER BY r.observed_date ROWS 6 PRECEDING)', 5)} AS accumulation_7d_mm FROM v_rain r JOIN p ON r.observed_date = p.observed_date""")
def d5(v):
    from hydrolens.plans.features import build_rain_history

    s = v.v_rain_samples
    items = F.sort_array(F.collect_list(F.struct(F.col("observed_date").cast("string").alias("t"), F.col("precipitation_mm").alias("p"))))
    per = s.groupBy(F.year("observed_date").cast("string").alias("chunk"), "weight").agg(items.alias("i"))
    location = F.struct(
        F.struct(F.transform("i", lambda x: x["t"]).alias("time"), F.transform("i", lambda x: x["p"]).alias("precipitation_sum")).alias("daily")
    )
    payloads = per.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("weight", location.alias("l")))), lambda x: x["l"]).alias("locations"))
    positions = v.spark.range(4).select(F.col("id").cast("int").alias("position"), (F.col("id") + 1).cast("double").alias("weight"))
    h = build_rain_history(payloads, positions)
    return nudged(h.select("observed_date", "mean_precipitation_mm", "p90_precipitation_mm", "accumulation_7d_mm"), mean_precipitation_mm=6, accumulation_7d_mm=5)


@query("m28_rain_features", "v_rain", sql=f"""
WITH t AS (SELECT observed_date AS target FROM v_rain ORDER BY observed_date DESC LIMIT 1),
f AS (SELECT observed_date AS d, max_precipitation_mm AS mm FROM v_rain, t WHERE observed_date >= target - 6),
h AS (SELECT observed_date AS d, mean_precipitation_mm AS mm FROM v_rain WHERE observed_date < (SELECT MIN(d) FROM f) AND observed_date >= (SELECT MIN(d) FROM f) - 30),
m AS (SELECT * FROM f UNION ALL SELECT * FROM h)
SELECT {near('COALESCE(SUM(mm) FILTER (WHERE d = target), 0)')} AS rainfall_mean_1d_mm, {near('COALESCE(SUM(mm) FILTER (WHERE target - d < 3), 0)')} AS rainfall_accumulation_3d_mm,
  {near('COALESCE(SUM(mm) FILTER (WHERE target - d < 7), 0)')} AS rainfall_accumulation_7d_mm, {near('COALESCE(SUM(mm) FILTER (WHERE target - d < 30), 0)')} AS rainfall_accumulation_30d_mm FROM m, t""")
def m28_rain(v):
    last = v.v_rain.agg(F.max("observed_date")).first()[0]
    day = F.col("observed_date").alias("date")
    f = v.v_rain.where(F.date_diff(F.lit(last), "observed_date") <= 6).select(day, F.col("max_precipitation_mm").alias("precipitation_mm"))
    h = v.v_rain.select(day, F.col("mean_precipitation_mm").alias("precipitation_mm"))
    names = ["rainfall_mean_1d_mm", "rainfall_accumulation_3d_mm", "rainfall_accumulation_7d_mm", "rainfall_accumulation_30d_mm"]
    return nudged(R.forecast_rain_features(f, h, last).select(*names), **{n: 6 for n in names})


@query("m28_rain_anomaly", "v_rain", sql=f"""
WITH t AS (SELECT MAX(observed_date) AS target FROM v_rain),
now AS (SELECT SUM(mm) AS mm FROM (SELECT max_precipitation_mm AS mm FROM v_rain, t WHERE observed_date >= target - 2
  UNION ALL SELECT mean_precipitation_mm FROM v_rain, t WHERE observed_date < target - 2 AND observed_date >= target - 6)),
ends AS (SELECT a.observed_date, SUM(b.mean_precipitation_mm) AS mm FROM v_rain a JOIN v_rain b ON b.observed_date BETWEEN a.observed_date - 6 AND a.observed_date, t
  WHERE a.observed_date < target - 2 AND weekofyear(a.observed_date) = weekofyear(target) GROUP BY a.observed_date)
SELECT (SELECT target FROM t) AS target_date, (SELECT COUNT(*) FROM ends) AS week_days, {near('COALESCE((SELECT mm FROM now) / GREATEST((SELECT AVG(mm) FROM ends), CASE WHEN (SELECT COUNT(*) FROM ends) > 0 THEN 1e0 END), 1e0)')} AS rainfall_anomaly_7d""")
def m28_anomaly(v):
    last = v.v_rain.agg(F.max("observed_date")).first()[0]
    day = F.col("observed_date").alias("date")
    f = v.v_rain.where(F.date_diff(F.lit(last), "observed_date") <= 2).select(day, F.col("max_precipitation_mm").alias("precipitation_mm"))
    h = v.v_rain.select(day, F.col("mean_precipitation_mm").alias("precipitation_mm"))
    days = v.v_rain.where((F.date_diff(F.lit(last), "observed_date") > 2) & (F.weekofyear("observed_date") == F.weekofyear(F.lit(last)))).agg(F.count(F.lit(1)).alias("week_days"))
    a = R.forecast_anomaly(f, h, last).crossJoin(F.broadcast(days))  # one row each
    return nudged(a.select(F.lit(last).alias("target_date"), "week_days", "rainfall_anomaly_7d"), rainfall_anomaly_7d=6)
