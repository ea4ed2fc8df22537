"""Summaries of the product tables. Every one combines on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.functions import scalars as S


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division where 0/0 is 0."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def extent_summary(extents: DataFrame) -> DataFrame:
    return extents.agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_distinct(F.coalesce("event_id", "event_name")).alias("event_count"),
        F.coalesce(F.sum("area_km2"), F.lit(0.0)).alias("total_area_km2"),
        F.min("observed_date").alias("observed_from"),
        F.max("observed_date").alias("observed_to"),
        F.count_if("field_validated").alias("field_validated_features"),
    )


def fixed_counts(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """One row per fixed category with its count, zero when absent; a single pass without a join."""
    counted = df.agg(*[F.count_if(F.col(column) == c).alias(c) for c in categories])
    stacked = F.array(*[F.struct(F.lit(c).alias(column), F.col(c).alias("count")) for c in categories])
    return counted.select(F.explode(stacked).alias("r")).select("r.*")


def quality_counts(layers: DataFrame) -> DataFrame:
    return fixed_counts(layers, "quality_status", K.LAYER_QUALITIES)


def band_summary(predictions: DataFrame, band: str = "risk_band", value: str = "probability",
                 bands: Sequence[str] = K.RISK_BANDS, keys: Sequence[str] = ()) -> DataFrame:
    """Cells, mean value, positives and zero-filled band counts."""
    extra = [F.count_if("predicted_label").alias("predicted_positive_cells")] if "predicted_label" in predictions.columns else []
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_cells"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias(f"mean_{value}"),
        *extra,
        *[F.count_if(F.col(band) == b).alias(f"{b.lower()}_cells") for b in bands],
    )


def event_summary(predictions: DataFrame, threshold: float) -> DataFrame:
    """Per event, date and split: cells and cells at or above the raw extent threshold."""
    return predictions.groupBy("event_id", "event_start_date", "split").agg(
        F.count(F.lit(1)).alias("total_cells"),
        F.count_if(F.col("flooded_fraction") >= F.lit(threshold)).alias("observed_positive_cells"),
    )


def mean_probability(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.avg("probability").alias("mean_probability"))


def confusion(df: DataFrame, keys: Sequence[str] = (), predicted: str = "predicted", observed: str = "observed") -> DataFrame:
    p, o = F.col(predicted), F.col(observed)
    counts = df.groupBy(*keys).agg(
        F.count_if(p & o).alias("tp"), F.count_if(p & ~o).alias("fp"),
        F.count_if(~p & o).alias("fn"), F.count_if(~p & ~o).alias("tn"),
    )
    tp = F.col("tp")
    return counts.withColumns(
        {"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn"))}
    )


def land_cover_summary(cells: DataFrame, shares: str = "land_cover_percentages", pixels: str = "land_cover_pixel_count") -> DataFrame:
    """Per class: pixels rebuilt from rounded shares and the share of all counted pixels."""
    rebuilt = F.bround(F.col(pixels) * F.col("share") / 100).cast("bigint")
    counts = (
        cells.select(pixels, F.explode(shares).alias("class_code", "share"))
        .groupBy(F.col("class_code").cast("int").alias("class_code"))
        .agg(F.sum(rebuilt).alias("pixel_count"))
    )
    total = counts.agg(F.sum("pixel_count").alias("__total"))  # one row over a handful of classes
    return counts.crossJoin(F.broadcast(total)).select(
        "class_code",
        S.class_name("class_code").alias("class_name"),
        S.class_color("class_code").alias("color"),
        "pixel_count",
        ratio(F.col("pixel_count") * 100, F.col("__total")).alias("percentage"),
    )


def with_share(df: DataFrame, column: str, name: str = "share", factor: float = 1.0) -> DataFrame:
    """Share of the grand total, as a pre-aggregated one-row join instead of an unpartitioned window."""
    total = df.agg(F.sum(column).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.col(column) * factor / F.col("__total")).drop("__total")


def with_global_max(df: DataFrame, column: str, name: str) -> DataFrame:
    top = df.agg(F.max(column).alias(name))
    return df.crossJoin(F.broadcast(top))  # one row


def class_shares(counts: DataFrame) -> DataFrame:
    summed = counts.groupBy("class_code").agg(F.sum("pixel_count").alias("pixel_count"))
    return with_share(summed, "pixel_count", "percentage", 100.0)


def event_bounds(extents: DataFrame) -> DataFrame:
    named = extents.where(F.col("event_id").isNotNull() & F.col("observed_start_date").isNotNull())
    return named.groupBy("event_id").agg(
        F.min("observed_start_date").alias("event_start_date"), F.max("observed_end_date").alias("event_end_date")
    )


def cell_overlap(pairs: DataFrame, key: str = "cell_id") -> DataFrame:
    """Per cell: summed overlap, largest event count and overlap weighted by event count."""
    return pairs.groupBy(key).agg(
        F.sum("overlap_m2").alias("flooded_area_m2"),
        F.max("event_count").alias("event_count_max"),
        F.sum(F.col("overlap_m2") * F.col("event_count")).alias("weighted_area_events"),
    )


def grid_summary(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    return cells.agg(
        F.count(F.lit(1)).alias("cell_count"),
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
    )


def hand_summary(cells: DataFrame) -> DataFrame:
    valid = cells.where(F.col("hand_mean_m").between(0.0, K.HAND_MAX_VALID_M))
    return valid.agg(
        F.count(F.lit(1)).alias("cell_count"), F.min("hand_min_m").alias("min_hand_m"),
        F.max("hand_max_m").alias("max_hand_m"), F.avg("hand_mean_m").alias("mean_hand_m"),
    )


def rain_summary(rain: DataFrame) -> DataFrame:
    """Days, wet days, total and peaks with their dates (the earliest on ties)."""
    early = F.date_diff(F.lit("1970-01-01").cast("date"), F.col("observed_date"))

    def peak_date(column: str) -> Column:
        return F.max_by("observed_date", F.struct(F.col(column), early))

    return rain.agg(
        F.min("observed_date").alias("start_date"),
        F.max("observed_date").alias("end_date"),
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("mean_precipitation_mm") >= 1.0).alias("wet_days"),
        F.coalesce(F.sum("mean_precipitation_mm"), F.lit(0.0)).alias("total_mean_precipitation_mm"),
        F.coalesce(F.max("mean_precipitation_mm"), F.lit(0.0)).alias("peak_daily_mean_mm"),
        peak_date("mean_precipitation_mm").alias("peak_daily_mean_date"),
        F.coalesce(F.max("accumulation_7d_mm"), F.lit(0.0)).alias("peak_7d_mm"),
        peak_date("accumulation_7d_mm").alias("peak_7d_end_date"),
        F.coalesce(F.max("grid_cell_count"), F.lit(0)).alias("grid_cell_count"),
    )


def count_label_events(extents: DataFrame, source: str, prefix: str) -> DataFrame:
    from hydrolens.operators.relational import by_label_source

    named = by_label_source(extents, source, prefix).where(F.col("observed_start_date").isNotNull())
    return named.agg(F.count_distinct("event_id").alias("event_count"))


def network_totals(assets: DataFrame) -> DataFrame:
    kind = F.col("asset_type")
    return assets.agg(
        (F.coalesce(F.sum("segment_length_m"), F.lit(0.0)) / 1000).alias("total_length_km"),
        F.count_if(kind == "river_segment").alias("river_segments"),
        F.count_if(kind == "canal_segment").alias("canal_segments"),
        F.coalesce(F.min("elevation_min_m"), F.lit(0.0)).alias("terrain_min_m"),
        F.coalesce(F.max("elevation_max_m"), F.lit(0.0)).alias("terrain_max_m"),
    )


def exposure(predictions: DataFrame, cells: DataFrame, threshold: float = 0.5, built: str = "built_fraction",
             key: str = "cell_id", basis: str = "historical_ml_susceptibility") -> DataFrame:
    """Flagged cells, their area, built-up area and an estimate of buildings."""
    flagged = predictions.where(F.col("predicted_label") | F.col("risk_band").isin("HIGH", "VERY_HIGH"))
    high = predictions.where(F.col("probability") >= F.lit(threshold)).agg(F.count(F.lit(1)).alias("high_risk_cells"))
    built_km2 = F.col(built) * K.CELL_AREA_KM2
    buildings = F.when(F.col(built) > 0, F.greatest(F.lit(1), F.bround(built_km2 * K.BUILDINGS_PER_KM2).cast("bigint"))).otherwise(0)
    hit = cells.join(flagged.select(key), key, "left_semi").agg(
        F.coalesce(F.sum(buildings), F.lit(0)).alias("buildings_at_risk"),
        F.coalesce(F.sum(F.when(F.col(built) > 0, built_km2)), F.lit(0.0)).alias("built_up_area_km2"),
    )
    count = flagged.agg(F.count(F.lit(1)).alias("flagged_cells"))
    one_row = count.crossJoin(F.broadcast(high)).crossJoin(F.broadcast(hit))
    nothing = F.col("flagged_cells") == 0
    return one_row.select(
        "flagged_cells",
        (F.col("flagged_cells") * K.CELL_AREA_KM2).alias("affected_area_km2"),
        "buildings_at_risk",
        "built_up_area_km2",
        F.when(nothing, F.lit(0)).otherwise(F.col("high_risk_cells")).cast("bigint").alias("high_risk_cells"),
        F.lit(basis).alias("risk_basis"),
    )


def people_at_risk(cells: DataFrame, predictions: DataFrame, use_label: bool, built_pct: str = "lc_built", key: str = "cell_id") -> DataFrame:
    """People estimate from the built-up percent of high-risk cells.

    ``use_label`` is set for forecast rows; susceptibility rows count by band only.
    """
    risky = F.col("risk_band").isin("HIGH", "VERY_HIGH")
    if use_label:
        risky = risky | F.col("predicted_label")
    built = cells.join(predictions.where(risky).select(key), key, "left_semi").agg(
        F.coalesce(F.sum(F.col(built_pct) / 100 * K.CELL_AREA_KM2), F.lit(0.0)).alias("km2")
    )
    return built.select(F.floor(F.col("km2") * K.BUILDINGS_PER_KM2 + 0.5).alias("people_at_risk"))


def split_counts(df: DataFrame, split: str = "split", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, split).agg(F.count(F.lit(1)).alias("rows"))


def station_roster(stations: DataFrame, readings: DataFrame) -> DataFrame:
    """Registered stations and stations only seen in readings; the registered name wins."""
    known = stations.select("station_id", "name", F.lit(1).alias("__known"))
    seen = readings.groupBy("station_id").agg(F.max("station_name").alias("name")).withColumn("__known", F.lit(0))
    return known.unionByName(seen).groupBy("station_id").agg(F.max_by("name", "__known").alias("name"))


def sar_reference(extents: DataFrame, prefix: str, order: str = "source_key") -> DataFrame:
    """Reference event id to satellite event id; the last extent in ``order`` wins."""
    sar = extents.where(
        F.col("source_key").startswith(f"{prefix}:sar:event:")
        & F.col("reference_event_id").isNotNull()
        & F.col("event_id").isNotNull()
    )
    return sar.groupBy("reference_event_id").agg(F.max_by("event_id", order).alias("sar_event_id"))


def area_totals(predictions: DataFrame, keys: Sequence[str] = (), cell_km2: float = K.CELL_AREA_KM2) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        (F.count_if("predicted") * cell_km2).alias("predicted_area_km2"),
        (F.count_if("observed") * cell_km2).alias("observed_area_km2"),
    )
