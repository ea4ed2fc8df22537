"""Products: screening, prediction indexes, forecast runs, readiness, exposure, intelligence, cell reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.functions import scalars as S
from hydrolens.operators import aggregates as A
from hydrolens.operators import joins, rain as R
from hydrolens.operators.ranking import with_percentile
from hydrolens.operators.relational import latest, order_probability, order_screening, select_event
from hydrolens.plans.features import with_engineered
from hydrolens.plans.training import score

# --- terrain screening --------------------------------------------------------------------


def terrain_screening(cells: DataFrame, key: str = "cell_id") -> DataFrame:
    """Scored cells with factor scores, band and explainable factors.

    Cells need an elevation percentile, a waterway distance and a relief. Distance and relief are ranked over
    the cells that have all three.
    """
    usable = cells.where(
        F.col("elevation_percentile").isNotNull() & F.col("distance_to_waterway_m").isNotNull() & F.col("local_relief_m").isNotNull()
    )
    ranked = with_percentile(with_percentile(usable, "distance_to_waterway_m"), "local_relief_m")
    scored = ranked.withColumn(
        "__s", S.screening("elevation_percentile", "distance_to_waterway_m_percentile", "local_relief_m_percentile")
    )
    return scored.select(
        *cells.columns, F.col("__s.score").alias("screening_score"), F.col("__s.band").alias("screening_band"),
        *[F.col(f"__s.{f}_score").alias(f"{f}_score") for f in K.SCREENING_FACTORS],
        S.screening_factors("__s", "elevation_mean_m", "distance_to_waterway_m", "local_relief_m").alias("factors"),
    )


def screening_index(cells: DataFrame, key: str = "cell_id", band: str | None = None) -> DataFrame:
    """I1, compact: no geometry and no prose, best score first."""
    scored = terrain_screening(cells, key)
    if band is not None:
        scored = scored.where(F.col("screening_band") == band)
    columns = [key, "screening_score", "screening_band", *[f"{f}_score" for f in K.SCREENING_FACTORS]]
    return order_screening(scored.select(*columns), key)


def screening_summary(scored: DataFrame) -> DataFrame:
    summary = A.band_summary(scored, "screening_band", "screening_score", K.SCREENING_BANDS)
    return summary.withColumn("limitations", F.array(*map(F.lit, K.SCREENING_LIMITATIONS)))


# --- susceptibility and hindcast ----------------------------------------------------------


def prediction_index(predictions: DataFrame, model_version: str | None = None, key: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """(items by probability, one summary row)."""
    mine = predictions if model_version is None else predictions.where(F.col("model_version") == model_version)
    items = mine.withColumns({"probability": F.round("probability", 6), "flooded_fraction": F.round("flooded_fraction", 6)})
    return order_probability(items, key), A.band_summary(mine)


def hindcast_items(predictions: DataFrame, threshold: float, beta: float, target_threshold: float, label_mode: str = "flood_extent") -> DataFrame:
    """Decision, observation and outcome of each prediction; observations may discount permanent water."""
    decision = S.temper("probability", "surface_water", F.lit(float(beta)))
    observed = F.col("flooded_fraction")
    if label_mode == "flood_excess":
        observed = F.greatest(F.lit(0.0), observed - F.col("surface_water"))
    marked = predictions.withColumns(
        {"decision_probability": decision, "observed": observed >= F.lit(target_threshold)}
    ).withColumn("predicted", F.col("decision_probability") >= F.lit(threshold))
    return marked.withColumn("outcome", S.outcome("predicted", "observed"))


def event_prediction_index(predictions: DataFrame, profile: dict, target_threshold: float, label_mode: str = "flood_extent",
                           event_id: str | None = None, key: str = "cell_id") -> dict[str, DataFrame]:
    """Available events, the selected event, its items and its summary.

    ``observed_positive_cells`` of an event counts the raw extent in either label mode, outcomes follow the mode.
    """
    events = A.event_summary(predictions, target_threshold)
    chosen = select_event(events, event_id)
    mine = predictions.join(F.broadcast(chosen.select("event_id")), "event_id", "left_semi")  # one row
    items = hindcast_items(mine, profile["threshold"], profile.get("water_temper_beta", 0.0), target_threshold, label_mode)
    counts = A.confusion(items, ["event_id"]).join(A.mean_probability(mine, ["event_id"]), "event_id")
    summary = chosen.join(counts, "event_id").withColumn("predicted_positive_cells", F.col("tp") + F.col("fp"))
    return {
        "events": events.orderBy(F.col("event_start_date").desc(), "event_id"),
        "event": chosen,
        "items": items.orderBy(F.col("probability").desc(), F.col(key)),
        "summary": summary,
    }


def model_evaluation(models: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Report columns from the metrics JSON of model rows."""
    m = F.try_parse_json(metrics)
    mode = F.coalesce(F.try_variant_get("__m", "$.active_threshold_mode", "string"), F.lit("conservative"))

    def number(path: str) -> Column:
        return F.try_variant_get("__m", path, "double")

    def profile(field: str) -> Column:
        options = [F.when(F.col("active_threshold_mode") == name, number(f"$.threshold_profiles.{name}.{field}")) for name in K.THRESHOLD_MODES]
        return F.coalesce(*options)

    parsed = models.withColumn("__m", m).withColumn("active_threshold_mode", mode)
    return parsed.select(
        "model_version", "active_threshold_mode",
        F.coalesce(profile("threshold"), F.col("decision_threshold")).alias("decision_threshold"),
        F.coalesce(profile("water_temper_beta"), F.lit(0.0)).alias("water_temper_beta"),
        number("$.test.precision").alias("test_precision"), number("$.test.recall").alias("test_recall"), number("$.test.f1").alias("test_f1"),
        number("$.rolling_origin_cross_validation.summary.conservative.mean_precision").alias("rolling_precision"),
    ).withColumn("recommendation", S.recommendation("test_precision", "test_recall", "rolling_precision"))


# --- forecast -----------------------------------------------------------------------------


def forecast_run(cells: DataFrame, forecast: DataFrame, history: DataFrame, artifact: dict, target, run_version: str,
                 mode: str = "conservative", percentile_scale: str = "unit", key: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """(run row, per-cell predictions) of one target date.

    ``cells`` is a cell catalog; ``forecast`` and ``history`` hold (date, precipitation_mm). Every feature the
    artifact names is derived here, so an artifact of the full training list can be scored.
    """
    profile = artifact.get("threshold_profiles", {}).get(mode, {})
    threshold = float(profile.get("threshold", artifact.get("decision_threshold", 0.5)))
    beta = float(profile.get("water_temper_beta") or 0.0)
    rainfall = R.forecast_rain_features(forecast, history, target).drop("days_known")
    seven = R.forecast_rain_features(forecast, history, target, (14,)).select("rainfall_accumulation_14d_mm")
    rainfall = rainfall.crossJoin(F.broadcast(seven)).crossJoin(F.broadcast(R.forecast_anomaly(forecast, history, target)))  # one row each
    shares = cells.withColumns(
        {n: F.when(F.coalesce(F.col(n), F.lit(0.0)) > 1.0, F.col(n) / 100.0).otherwise(F.coalesce(F.col(n), F.lit(0.0))) for n in K.LANDCOVER_FEATURES}
    )
    if "historical_event_count" not in shares.columns:
        shares = shares.withColumn("historical_event_count", F.lit(0))
    scored = score(with_engineered(shares.crossJoin(F.broadcast(rainfall)), percentile_scale), artifact)  # one row
    decision = S.temper("probability", "surface_water_influence_pct", F.lit(beta))
    features = F.map_from_arrays(
        F.array(*map(F.lit, artifact["feature_names"])), F.array(*[F.round(F.col(f).cast("double"), 6) for f in artifact["feature_names"]])
    )
    predictions = scored.select(
        F.lit(run_version).alias("run_version"), key, "probability", (decision >= F.lit(threshold)).alias("predicted_label"),
        S.risk_band("probability").alias("risk_band"), features.alias("features"),
    )
    summary = A.band_summary(predictions).withColumnRenamed("predicted_positive_cells", "flagged_cells")
    run = summary.crossJoin(F.broadcast(rainfall)).select(  # one row each
        F.lit(run_version).alias("run_version"), F.lit("completed").alias("status"), F.lit(mode).alias("threshold_mode"),
        F.lit(target).cast("date").alias("target_date"), F.lit(threshold).alias("decision_threshold"), F.lit(beta).alias("water_temper_beta"),
        F.col("total_cells").alias("cell_count"), F.col("flagged_cells").alias("flagged_cell_count"),
        A.ratio(F.col("flagged_cells") * 100.0, F.col("total_cells")).alias("flagged_cell_percentage"), "mean_probability",
        *[f"{b.lower()}_cells" for b in K.RISK_BANDS], F.struct(*rainfall.columns).alias("rainfall_features"),
        F.array(*map(F.lit, K.FORECAST_LIMITATIONS)).alias("limitations"), F.current_timestamp().alias("created_at"),
    )
    return run, predictions


def run_predictions(runs: DataFrame, predictions: DataFrame, run_version: str | None = None, key: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """(items, summary) of the given run, or of the newest completed run."""
    if run_version is None:
        run = latest(runs, "created_at", "run_version", status="completed").select("run_version")
        mine = predictions.join(F.broadcast(run), "run_version", "left_semi")  # one row
    else:
        mine = predictions.where(F.col("run_version") == run_version)
    return order_probability(mine, key), A.band_summary(mine).withColumnRenamed("predicted_positive_cells", "flagged_cells")


# --- readiness ----------------------------------------------------------------------------


def event_readiness(extents: DataFrame, rain: DataFrame, prefix: str = "demo") -> DataFrame:
    """One row with event counts, rainfall alignment, blockers and next steps."""
    def source(name: str) -> Column:
        return F.col("source_key").startswith(f"{prefix}:{name}:event:")

    named = extents.where(F.col("event_id").isNotNull() & F.col("observed_start_date").isNotNull())
    days = rain.select(F.col("observed_date").alias("observed_start_date"), F.lit(True).alias("__rain")).distinct()
    pairs = named.groupBy("event_id", "observed_start_date").agg(F.bool_or(source("gfd")).alias("gfd"), F.bool_or(source("sar")).alias("sar"))
    joined = pairs.join(days, "observed_start_date", "left").withColumn("aligned", F.coalesce("__rain", F.lit(False)))
    counts = joined.agg(
        F.count_if("gfd").alias("gfd_event_count"), F.count_if(F.col("gfd") & F.col("aligned")).alias("rainfall_aligned_event_count"),
        F.count_if("sar").alias("sar_event_count"), F.count_if(F.col("sar") & F.col("aligned")).alias("sar_aligned_event_count"),
        F.min("observed_start_date").alias("event_observed_from"), F.max("observed_start_date").alias("event_observed_to"),
    )
    span = rain.agg(F.min("observed_date").alias("rainfall_available_from"), F.max("observed_date").alias("rainfall_available_to"))
    gfd, aligned, sar, sar_aligned = (
        F.col(c) for c in ("gfd_event_count", "rainfall_aligned_event_count", "sar_event_count", "sar_aligned_event_count")
    )
    least = K.MINIMUM_EVENTS

    def listed(*options: Column) -> Column:
        return F.filter(F.array(*options), lambda m: m.isNotNull())

    blockers = listed(
        F.when(gfd < least, f"At least {least} individual flood events are required for train/validation/test temporal splits."),
        F.when(
            aligned < least,
            F.concat(
                F.lit(f"Rainfall must be available on the start date of at least {least} flood events; currently "),
                aligned.cast("string"), F.lit(" are aligned."),
            ),
        ),
    )
    ready = (gfd >= least) & (aligned >= least)
    steps = listed(
        F.when(gfd < least, "Export and import individual events with event ids and dates."),
        F.when(sar == 0, "Export satellite labels and import them for independent validation.")
        .when(sar_aligned < sar, "Backfill rainfall for satellite event dates that are not covered.")
        .otherwise("Compare satellite labels against the training labels and score the existing model."),
        F.when(aligned < gfd, "Backfill rainfall for event dates that are not covered."),
        F.when(ready, "Build the event-cell dataset and train the temporal baseline."),
    )
    return counts.crossJoin(F.broadcast(span)).select(  # one row each
        ready.alias("ready"), "gfd_event_count", "rainfall_aligned_event_count", (gfd - aligned).alias("missing_rainfall_event_count"),
        "sar_event_count", ((sar > 0) & (sar_aligned == sar)).alias("sar_validation_ready"),
        "event_observed_from", "event_observed_to", "rainfall_available_from", "rainfall_available_to",
        blockers.alias("blockers"), steps.alias("next_steps"),
    )


# --- intelligence -------------------------------------------------------------------------


def exposure_summary(predictions: DataFrame, cells: DataFrame, threshold: float = 0.5, forecast: bool = False, key: str = "cell_id") -> DataFrame:
    """I4."""
    basis = "experimental_forecast" if forecast else "historical_ml_susceptibility"
    return A.exposure(predictions, cells, threshold, key=key, basis=basis)


def sar_report(validation: dict) -> DataFrame:
    """Status and overall agreement row of a satellite validation."""
    pairs = validation["pairs"]
    counts = pairs.agg(F.count(F.lit(1)).alias("paired_event_count"), F.avg("binary_iou").alias("mean_binary_iou"))
    return counts.withColumn("status", F.lit(validation["status"])).join(
        F.broadcast(validation["overall"].limit(1)), F.lit(True), "left"  # at most one row
    )


def intelligence_summary(extents: DataFrame, event_predictions: DataFrame, susceptibility: DataFrame | None = None, forecast: DataFrame | None = None,
                         prefix: str = "demo", event_id: str | None = None) -> DataFrame:
    """One row that fuses event hindcast, satellite evidence and availability.

    The event is the requested one, else the newest satellite event, else the newest test event. Without event
    predictions the susceptibility mean drives the warning and there is no scenario.
    """
    def one(df: DataFrame) -> DataFrame:
        return F.broadcast(df)

    prefix_key = f"{prefix}:sar:event:"
    sar = extents.where(F.col("source_key").startswith(prefix_key))
    newest_sar = sar.agg(F.max_by("event_id", F.struct("observed_start_date", "event_id")).alias("sar_id"))
    summary = event_predictions.groupBy("event_id").agg(
        F.avg("probability").alias("p"), F.max("event_start_date").alias("d"), F.max("split").alias("split")
    )
    default = summary.agg(F.max_by("event_id", F.struct((F.col("split") == "test").alias("t"), F.col("d"), F.col("event_id"))).alias("default_id"))
    requested = newest_sar.crossJoin(one(default)).select(
        F.coalesce(F.lit(event_id).cast("string"), F.col("sar_id"), F.col("default_id")).alias("event_id"),
        F.lit(event_id is not None).alias("asked"), "sar_id",
    )
    mean = requested.join(summary, "event_id", "left")
    bare = sar.select(F.explode(F.array("event_id", S.strip_prefix("event_id", "sar-"))).alias("event_id")).distinct().withColumn("seen", F.lit(True))
    detected = F.coalesce("seen", F.lit(False)) | (~F.col("asked") & F.col("sar_id").isNotNull())
    row = mean.join(bare, "event_id", "left").withColumn("sar_detected", detected)

    def product(df: DataFrame | None, tag: str) -> DataFrame:
        if df is None:
            return requested.select(F.lit(None).cast("double").alias(f"{tag}_mean"), F.lit(False).alias(f"{tag}_available"))
        return df.agg(F.avg("probability").alias(f"{tag}_mean"), (F.count(F.lit(1)) > 0).alias(f"{tag}_available"))

    full = row.crossJoin(one(product(susceptibility, "susceptibility"))).crossJoin(one(product(forecast, "forecast")))
    p = F.coalesce("p", "susceptibility_mean")
    return full.select(
        "event_id", "sar_detected", p.alias("mean_probability"),
        F.when(F.col("p").isNotNull(), S.scenario("p", "sar_detected")["scenario"]).alias("scenario"),
        F.when(p.isNotNull(), S.early_warning(p)["level"]).alias("warning_level"),
        "susceptibility_available", "forecast_available", F.array(*map(F.lit, K.INTELLIGENCE_LIMITATIONS)).alias("limitations"),
    )


def risk_reasons(cells: DataFrame, screening: DataFrame, susceptibility: DataFrame, forecast: DataFrame, anomaly_pct: DataFrame,
                 key: str = "cell_id", screening_layer: bool = True) -> DataFrame:
    """Active reason keys and the chosen probability per cell.

    ``anomaly_pct`` is one row. Products are joined by id; the probability is the forecast's, else the
    susceptibility's, else the screening score as a share.
    """
    joined = joins.attach_by_id(
        cells, {
            "s": screening.select(key, "screening_score"),
            "m": susceptibility.select(key, "probability", "flooded_fraction", "historical_event_count"),
            "f": forecast.select(key, "probability"),
        }, key,
    ).crossJoin(F.broadcast(anomaly_pct.select("anomaly_pct").limit(1)))  # one row
    zero = F.lit(0.0)
    fraction = F.coalesce("m.flooded_fraction", zero)
    events = F.coalesce("m.historical_event_count", F.lit(0))
    reasons = [
        ("susceptibility_score", (F.coalesce("s.screening_score", zero) >= 50) & F.lit(screening_layer)),
        ("low_elevation", (F.coalesce("elevation_mean_m", zero) <= 3) | (F.coalesce("elevation_percentile", zero) <= 35)),
        ("near_waterway", F.coalesce("distance_to_waterway_m", zero) <= 600),
        ("heavy_rainfall", F.coalesce(F.col("anomaly_pct") >= 20, F.lit(False))),
        ("flood_history", (events > 0) | (fraction >= 0.05)),
    ]
    active = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in reasons]), lambda r: r.isNotNull())
    probability = F.coalesce("f.probability", "m.probability", F.col("s.screening_score") / 100)
    return joined.select(key, probability.alias("probability"), active.alias("reasons"))

