"""Data-quality rules: one operator, many rule sets.

A rule set maps a violation message to the condition under which it holds. ``validate`` splits a table or
stream into valid rows and rejected rows with the list of their violations, in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.functions import constants as K

Rules = dict[str, Column]


def violations(rules: Rules) -> Column:
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for message, bad in rules.items()])
    return F.filter(found, lambda m: m.isNotNull())


def flagged(df: DataFrame, rules: Rules) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def validate(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``violations``)."""
    marked = flagged(df, rules)
    return (
        marked.where(F.size("violations") == 0).drop("violations"),
        marked.where(F.size("violations") > 0),
    )


# --- building blocks ----------------------------------------------------------------------


def outside(column: str, low: float, high: float) -> Column:
    c = F.col(column)
    return c.isNotNull() & ~c.between(low, high)


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def longer(column: str, limit: int) -> Column:
    return F.length(column) > limit


def required_text(**limits: int) -> Rules:
    """Text that must be present after trimming, with its largest length."""
    rules: Rules = {}
    for name, limit in limits.items():
        rules[f"{name} must not be blank"] = blank(name)
        rules[f"{name} is too long"] = longer(name, limit)
    return rules


def no_offset(text: str) -> Column:
    """Timestamp text without a zone offset."""
    return ~F.col(text).rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def not_https(column: str) -> Column:
    return ~F.col(column).startswith("https://")


def not_in(column: str, allowed: Sequence[str]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)


def unknown_keys(raw: str, allowed: Sequence[str]) -> Column:
    keys = F.json_object_keys(F.col(raw))
    return F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0


# --- rule sets ----------------------------------------------------------------------------


def geometry_rules(geom: str = "geometry", simple: bool = True) -> Rules:
    """V1. ``simple`` adds the self-intersection test, which runs in an Arrow UDF."""
    g = F.col(geom)
    vertices = F.flatten(g["rings"])
    b = g["bbox"]
    rules: Rules = {
        "unsupported geometry type": g.isNull() | ~g["type"].isin(*K.GEOMETRY_TYPES),
        "geometry must not be empty": F.size(vertices) <= 0,
        "coordinates must be finite numbers": F.exists(
            vertices,
            lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"])
            | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")),
        ),
        "coordinates must be longitude [-180, 180] and latitude [-90, 90]": (b["xmin"] < -180)
        | (b["xmax"] > 180) | (b["ymin"] < -90) | (b["ymax"] > 90),
        "polygon ring needs four positions": g["type"].isin("Polygon", "MultiPolygon")
        & F.exists(g["rings"], lambda r: F.size(r) < 4),
    }
    if simple:
        from hydrolens.operators.polygons import self_intersects

        rules["geometry intersects itself"] = g["type"].isin("Polygon", "MultiPolygon") & self_intersects(g)
    return rules


def reading_rules() -> Rules:
    """V3."""
    return {
        "station_id must not be blank": blank("station_id"),
        "station_id is too long": longer("station_id", 100),
        "timestamp must be present": F.col("observed_at").isNull(),
        "water_level_cm out of range": outside("water_level_cm", -2000, 10000),
        "rainfall_mm out of range": outside("rainfall_mm", 0, 5000),
        "soil_moisture_percent out of range": outside("soil_moisture_percent", 0, 100),
        "battery_percent out of range": outside("battery_percent", 0, 100),
        "source must not be blank": F.coalesce(F.length("source"), F.lit(0)) == 0,
        "source is too long": longer("source", 255),
        "waterLevelCm or rainfallMm is required": F.col("water_level_cm").isNull() & F.col("rainfall_mm").isNull(),
    }


READING_KEYS = ["stationId", "timestamp", "waterLevelCm", "rainfallMm", "soilMoisture", "batteryLevel", "source"]


def message_rules(timestamp_text: str = "timestamp_text", raw: str = "raw") -> Rules:
    """V3 for raw messages: zone offset and unknown keys as well."""
    return {
        "message is not a JSON object": F.json_object_keys(F.col(raw)).isNull(),
        **reading_rules(),
        "timestamp must include a timezone offset": no_offset(timestamp_text),
        "unknown key": unknown_keys(raw, READING_KEYS),
    }


def topic_rules(captured: str = "topic_station") -> Rules:
    """V4."""
    t = F.col(captured)
    return {"payload station differs from the topic": t.isNotNull() & (t != "") & (t != F.col("station_id"))}


def observation_rules() -> Rules:
    """V5."""
    return {
        "a measurement is required": F.coalesce("rainfall_mm", "water_level_m", "discharge_m3s").isNull(),
        "rainfall_mm out of range": outside("rainfall_mm", 0, 5000),
        "water_level_m out of range": outside("water_level_m", -20, 100),
        "discharge_m3s out of range": outside("discharge_m3s", 0, 1_000_000),
        "soil_moisture_percent out of range": outside("soil_moisture_percent", 0, 100),
        "battery_percent out of range": outside("battery_percent", 0, 100),
        "unknown quality_status": not_in("quality_status", ["unverified", "provisional", "verified", "rejected"]),
    }


def station_rules() -> Rules:
    """V6."""
    names = ("warning_level_cm", "danger_level_cm", "critical_level_cm")
    given = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return {
        "thresholds must be set together": ~given.isin(0, 3),
        "warning_level_cm must be below danger_level_cm": F.col(names[0]) >= F.col(names[1]),
        "danger_level_cm must be below critical_level_cm": F.col(names[1]) >= F.col(names[2]),
        **{f"{n} out of range": outside(n, 0, 100_000) for n in names},
        "unknown status": not_in("status", ["active", "offline", "maintenance"]),
    }


def extent_rules(geometry: bool = True) -> Rules:
    """V7."""
    rules: Rules = {
        "source_url must use https": F.col("source_url").isNull() | not_https("source_url"),
        "observed_end_date must not precede the start": F.col("observed_end_date")
        < F.coalesce("observed_start_date", "observed_date"),
        "unknown classification": not_in("classification", ["flood", "possible_flood"]),
        "unknown confidence": not_in("confidence", ["high", "moderate", "low", "unknown"]),
        "area_km2 must be positive": F.col("area_km2") <= 0,
    }
    if geometry:
        rules["geometry must be Polygon or MultiPolygon"] = F.col("geometry.type").isNull() | ~F.col(
            "geometry.type"
        ).isin("Polygon", "MultiPolygon")
    return rules


def layer_rules() -> Rules:
    """V8."""
    return {
        "layer_key has an unsupported form": ~F.col("layer_key").rlike("^[a-z0-9][a-z0-9._:-]*$"),
        "layer_key is too long": longer("layer_key", 150),
        "source_url must use https": F.col("source_url").isNull() | not_https("source_url"),
        "license_url must use https": F.col("license_url").isNotNull() & not_https("license_url"),
        "spatial_resolution_m must be positive": F.col("spatial_resolution_m") <= 0,
        "temporal coverage is reversed": F.col("temporal_coverage_start") > F.col("temporal_coverage_end"),
        "unknown data_kind": not_in("data_kind", ["raster", "vector", "timeseries", "service"]),
        "unknown quality_status": not_in("quality_status", K.LAYER_QUALITIES),
    }


def rain_rules(days: Sequence[int] = (3, 7, 30)) -> Rules:
    """V9."""
    return {
        "mean must not be negative": F.col("mean_precipitation_mm") < 0,
        "max must not be below mean": F.col("max_precipitation_mm") < F.col("mean_precipitation_mm"),
        "grid_cell_count must be positive": F.col("grid_cell_count") <= 0,
        **{f"accumulation_{d}d_mm must not be negative": F.col(f"accumulation_{d}d_mm") < 0 for d in days},
    }


def prediction_rules() -> Rules:
    """V10 (row part)."""
    return {
        "probability out of range": F.col("probability").isNull() | ~F.col("probability").between(0, 1),
        "flooded_fraction out of range": outside("flooded_fraction", 0, 1),
        "unknown risk band": not_in("risk_band", K.RISK_BANDS),
    }


def model_rules() -> Rules:
    """V10 (model part)."""
    return {
        "positive and negative rows must add up": F.col("positive_rows") + F.col("negative_rows") != F.col("training_rows"),
        "target_threshold out of range": outside("target_threshold", 0, 1),
    }


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """V10 (uniqueness) and the duplicate check of an upsert: keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def feature_gaps(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with the number of missing or non-finite values per feature."""
    def bad(c: str) -> Column:
        x = F.col(c).cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return df.agg(*[F.count_if(bad(c)).alias(c) for c in features])


def incomplete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows that a training job must refuse, with the names of their bad features."""
    def bad(c: str) -> Column:
        x = F.col(c).cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return validate(df, {c: bad(c) for c in features})[1]


def event_properties(df: DataFrame, event: str = "event_id", required: Sequence[str] = ("event_start_date", "event_end_date"),
                     optional: Sequence[str] = ()) -> DataFrame:
    """Properties per event; ``consistent`` tells whether each required one has exactly one value.

    Optional properties survive only when single-valued. Counting is done by min = max, which needs no
    distinct shuffle.
    """
    aggregates = []
    for c in required:
        aggregates += [F.min(c).alias(f"__min_{c}"), F.max(c).alias(f"__max_{c}"), F.count_if(F.col(c).isNull()).alias(f"__null_{c}")]
    for c in optional:
        aggregates += [F.min(c).alias(f"__min_{c}"), F.max(c).alias(f"__max_{c}")]
    grouped = df.groupBy(event).agg(F.count(F.lit(1)).alias("features"), *aggregates)
    single = {c: F.col(f"__min_{c}") == F.col(f"__max_{c}") for c in (*required, *optional)}
    consistent = F.lit(True)
    for c in required:
        consistent = consistent & F.coalesce(single[c], F.lit(False)) & (F.col(f"__null_{c}") == 0)
    return grouped.select(
        event,
        "features",
        consistent.alias("consistent"),
        *[F.when(F.coalesce(single[c], F.lit(False)), F.col(f"__min_{c}")).alias(c) for c in (*required, *optional)],
    )


def group_rules(properties: str, name: str) -> Rules:
    """The group property is present and a non-empty scalar (JSON objects and arrays are not)."""
    value = F.try_element_at(F.col(properties), F.lit(name))
    return {
        f"missing group property {name}": ~F.coalesce(F.map_contains_key(F.col(properties), F.lit(name)), F.lit(False)),
        f"group property {name} must be a scalar": value.isNull() | (value == "") | value.rlike(r"^\s*[\[{]"),
    }


def source_counts(assets: DataFrame, kinds: Sequence[str] = ("terrain_cell", "river_segment", "canal_segment")) -> DataFrame:
    """Rows per source kind; zero blocks an enrichment."""
    from hydrolens.operators.aggregates import fixed_counts

    return fixed_counts(assets, "asset_type", kinds).withColumn("available", F.col("count") > 0)


def scrub_hand(cells: DataFrame) -> DataFrame:
    """Clear height-above-drainage values outside the valid range."""
    bad = (F.col("hand_mean_m") < 0) | (F.col("hand_mean_m") > K.HAND_MAX_VALID_M)
    if "hand_min_m" in cells.columns:
        bad = bad | (F.col("hand_min_m") < 0)
    bad = F.coalesce(bad, F.lit(False))
    hand = [c for c in cells.columns if c.startswith("hand_")]
    return cells.withColumns({c: F.when(~bad, F.col(c)) for c in hand})
