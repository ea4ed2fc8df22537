"""Datasets: cell catalogs, engineered features, susceptibility and event-by-cell tables, event catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.functions import geo
from hydrolens.functions import scalars as S
from hydrolens.operators import aggregates, joins, outlines, polygons, rain as R, raster, spatial, validate
from hydrolens.operators.ranking import running_totals, with_percentile
from hydrolens.operators.relational import by_label_source
from hydrolens.session import materialize

_CELL_NUMBERS = [
    "elevation_mean_m", "elevation_min_m", "elevation_max_m", "elevation_percentile", "distance_to_waterway_m", "local_relief_m",
]


def cell_catalog(assets: DataFrame, key: str = "cell_id") -> DataFrame:
    """Typed static features from JSON properties, with the default chains.

    ``assets`` holds the key, ``asset_type``, geometry and ``properties`` as JSON text.
    """
    p = F.try_parse_json("properties")

    def number(path: str) -> Column:
        return F.try_variant_get("__p", f"$.{path}", "double")

    cells = assets.where(F.col("asset_type") == "terrain_cell").withColumn("__p", p).withColumn("__c", geo.centroid("geometry"))
    waterway = number("distance_to_waterway_m")
    return cells.select(
        key,
        F.col("__c.x").alias("centroid_lon"),
        F.col("__c.y").alias("centroid_lat"),
        F.col("geometry.bbox").alias("bbox"),
        *[number(c).alias(c) for c in _CELL_NUMBERS],
        F.coalesce(number("elevation_stddev_m"), F.lit(0.0)).alias("elevation_stddev_m"),
        *[F.coalesce(number(f"land_cover_percentages['{code}']"), F.lit(0.0)).alias(name) for name, code in K.LANDCOVER_FEATURES.items()],
        *_defaulted(number("hand_mean_m"), number("distance_to_river_m"), number("distance_to_canal_m"), waterway),
    )


def _defaulted(hand: Column, river: Column, canal: Column, waterway: Column) -> list[Column]:
    return [
        F.coalesce(hand, F.lit(K.DEFAULT_HAND_M)).alias("hand_mean_m"),
        F.coalesce(river, waterway, F.lit(K.DEFAULT_RIVER_DISTANCE_M)).alias("distance_to_river_m"),
        F.coalesce(canal, waterway, F.lit(K.DEFAULT_CANAL_DISTANCE_M)).alias("distance_to_canal_m"),
    ]


def typed_catalog(cells: DataFrame) -> DataFrame:
    """D9 for cells that already have one column per property; missing columns take their defaults."""

    def of(name: str) -> Column:
        return F.col(name).cast("double") if name in cells.columns else F.lit(None).cast("double")

    hand, river, canal = _defaulted(of("hand_mean_m"), of("distance_to_river_m"), of("distance_to_canal_m"), of("distance_to_waterway_m"))
    return cells.withColumns(
        {
            "hand_mean_m": hand, "distance_to_river_m": river, "distance_to_canal_m": canal,
            "elevation_stddev_m": F.coalesce(of("elevation_stddev_m"), F.lit(0.0)),
            **{name: F.coalesce(of(name), F.lit(0.0)) for name in K.LANDCOVER_FEATURES},
        }
    )


# --- engineered features ------------------------------------------------------------------


def with_engineered(df: DataFrame, percentile_scale: str = "unit") -> DataFrame:
    """The eleven derived features.

    ``percentile_scale="unit"`` clamps the stored percentile to [0, 1] as is; ``"percent"`` divides it by 100.
    """

    def positive(c: str) -> Column:
        return F.greatest(F.col(c), F.lit(0.0))

    percentile = F.col("elevation_percentile") / (100.0 if percentile_scale == "percent" else 1.0)
    low = F.lit(1.0) - S.clip(percentile, 0.0, 1.0)
    water = S.surface_water_share("landcover_water_pct", "landcover_wetland_pct", "landcover_mangrove_pct")

    def near(c: str) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + positive(c) / 250.0)

    near_water = near("distance_to_waterway_m")
    flat = F.lit(1.0) / (F.lit(1.0) + positive("local_relief_m"))
    r3, r7, r30 = (positive(f"rainfall_accumulation_{d}d_mm") for d in (3, 7, 30))
    return df.withColumns(
        {
            "waterway_proximity_index": near_water,
            "river_proximity_index": near("distance_to_river_m"),
            "canal_proximity_index": near("distance_to_canal_m"),
            "surface_water_influence_pct": water,
            "flatness_index": flat,
            "low_hand_waterway_risk": F.lit(1.0) / (F.lit(1.0) + positive("hand_mean_m") / 3.0) * near_water,
            "rainfall_7d_x_waterway_proximity": r7 * near_water,
            "rainfall_30d_x_low_elevation": r30 * low,
            "rainfall_3d_x_surface_water": r3 * water,
            "rainfall_7d_x_flatness": r7 * flat,
            "rainfall_intensity_ratio": positive("rainfall_max_1d_mm")
            / F.greatest(F.lit(1.0), F.sqrt(r7 * F.greatest(r30, F.lit(1.0)))),
        }
    )


def with_rain_enrichment(df: DataFrame, index: DataFrame, start: str = "event_start_date") -> DataFrame:
    """14-day sum and anomaly of the event date; without rain on that date, the 7-day sum and 1."""
    added = index.select(
        F.col("observed_date").alias("__day"), F.col("accumulation_14d_mm").alias("__a14"), F.col("rainfall_anomaly_7d").alias("__an")
    )
    return df.join(added, df[start] == F.col("__day"), "left").withColumns(
        {
            "rainfall_accumulation_14d_mm": F.coalesce("__a14", "rainfall_accumulation_7d_mm"),
            "rainfall_anomaly_7d": F.coalesce("__an", F.lit(1.0)),
        }
    ).drop("__day", "__a14", "__an")


# --- splits -------------------------------------------------------------------------------


def temporal_split(events: DataFrame) -> DataFrame:
    """Newest fifth is test, the fifth before is validation. Fewer than four distinct events fail the job."""
    ordered = events.select("event_id", "event_start_date").distinct()
    ranked = running_totals(ordered, [("event_start_date", False), ("event_id", False)], rank="__r")
    total = ranked.agg(F.count(F.lit(1)).cast("int").alias("__n"))
    n = F.col("__n")
    fifth = F.greatest(F.lit(1), F.floor(n / 5).cast("int"))
    holdout = F.when(n - 2 * fifth < 2, 1).otherwise(fifth)
    checked = F.when(n < K.MINIMUM_EVENTS, F.raise_error(F.lit("at least 4 rainfall-aligned events are required"))).otherwise(holdout)
    split = (
        F.when(F.col("__r") <= F.col("__h"), "test").when(F.col("__r") <= 2 * F.col("__h"), "validation").otherwise("train")
    )
    return (
        ranked.crossJoin(F.broadcast(total.withColumn("__h", checked.cast("int"))))  # one row
        .select("event_id", "event_start_date", split.alias("temporal_split"))
    )


def spatial_split(df: DataFrame, lon: str = "centroid_lon", lat: str = "centroid_lat") -> DataFrame:
    """D15."""
    return df.withColumn("spatial_split", S.spatial_split(lon, lat))


# --- datasets -----------------------------------------------------------------------------


def susceptibility_dataset(cells: DataFrame, overlaps: DataFrame, target_threshold: float = 0.10, key: str = "cell_id") -> DataFrame:
    """Static features with flooded fraction, event count and density, label and spatial split.

    ``overlaps`` is (key, overlap_m2, event_count) from ``operators.spatial``. Areas are summed, then capped.
    """
    overlap = aggregates.cell_overlap(overlaps, key)
    b = F.col("bbox")
    area = F.nullif(geo.box_area_m2(b["xmin"], b["ymin"], b["xmax"], b["ymax"]), F.lit(0.0))
    joined = cells.join(overlap, key, "left")
    fraction = S.clip(F.coalesce(F.try_divide(F.col("flooded_area_m2"), area), F.lit(0.0)), 0.0, 1.0)
    return spatial_split(
        joined.withColumns(
            {
                "flooded_fraction": fraction,
                "historical_event_count": F.coalesce("event_count_max", F.lit(0)),
                "historical_event_density": F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("weighted_area_events"), area), F.lit(0.0))),
                "target_label": (fraction >= F.lit(target_threshold)).cast("int"),
            }
        ).drop("flooded_area_m2", "event_count_max", "weighted_area_events")
    )


def event_metadata(extents: DataFrame, rain: DataFrame, source: str = "gfd", prefix: str = "demo") -> DataFrame:
    """Events of one label source with the rainfall of their start date (events without rain are left out)."""
    bounds = aggregates.event_bounds(by_label_source(extents, source, prefix))
    renamed = rain.select(
        "observed_date",
        F.col("mean_precipitation_mm").alias("rainfall_mean_1d_mm"), F.col("max_precipitation_mm").alias("rainfall_max_1d_mm"),
        F.col("p90_precipitation_mm").alias("rainfall_p90_1d_mm"),
        *[F.col(f"accumulation_{d}d_mm").alias(f"rainfall_accumulation_{d}d_mm") for d in (3, 7, 30)],
    )
    return joins.join_event_rain(bounds, renamed)


def event_dataset(cells: DataFrame, fractions: DataFrame, events: DataFrame, rain_index: DataFrame, counts: DataFrame,
                  key: str = "cell_id", percentile_scale: str = "unit", target_threshold: float = 0.10,
                  label_mode: str = "flood_excess") -> DataFrame:
    """Every event with every cell, flooded fraction, history, rainfall and engineered features.

    ``cells`` is a cell catalog, ``fractions`` (event_id, key, flooded_fraction) holds only wet pairs, ``events``
    comes from ``event_metadata``, ``rain_index`` from ``rain.rain_anomaly`` and ``counts`` from
    ``spatial.historical_count``. Per-event values are attached before the product, per-cell values as well.
    """
    enriched_events = with_rain_enrichment(events, rain_index)
    enriched_cells = joins.with_default_zero(cells, counts, ["historical_event_count"], key)
    product = joins.event_cell_product(enriched_events, enriched_cells)
    labelled = joins.with_default_zero(product, fractions, ["flooded_fraction"], ["event_id", key])
    shares = labelled.withColumns({name: S.as_fraction(name) for name in K.LANDCOVER_FEATURES})
    engineered = with_engineered(shares, percentile_scale)
    excess = S.flood_excess("flooded_fraction", "landcover_water_pct", "landcover_wetland_pct", "landcover_mangrove_pct")
    return engineered.withColumns(
        {"flood_excess_fraction": excess, "target_label": S.target_label(target_threshold, label_mode)}
    )


def with_temporal_split(dataset: DataFrame, events: DataFrame) -> DataFrame:
    split = temporal_split(events).select("event_id", "temporal_split")
    return dataset.join(split, "event_id")


EVENT_EXPORT = ["event_id", "event_start_date", "event_end_date", "cell_id", "centroid_lon", "centroid_lat", *K.EVENT_FEATURES,
                "flooded_fraction", "flood_excess_fraction", "target_label", "temporal_split"]


# --- event catalog ------------------------------------------------------------------------


def event_catalog(extents: DataFrame, cells: DataFrame, rain: DataFrame, source: str = "gfd", prefix: str = "demo",
                  union: bool = True, distinct_cells: bool = False, key: str = "cell_id") -> DataFrame:
    """One row per event with area, rainfall, terrain means and flood frequency.

    Overlap means weight a cell once per (extent, frequency extent) it meets; ``distinct_cells`` counts it once.
    ``union=False`` skips the dissolve when each source key is a single polygon or box. Extents with a geometry are met exactly.
    """
    named = by_label_source(extents, source, prefix).where(F.col("event_id").isNotNull() & F.col("observed_start_date").isNotNull())
    b = F.col("bbox")
    if union:
        measured = polygons.union_area(named, ["event_id", "source_key"])
    else:
        measured = named.groupBy("event_id", "source_key").agg(
            F.sum(geo.box_area_m2(b["xmin"], b["ymin"], b["xmax"], b["ymax"])).alias("union_area_m2")
        )
    area = measured.groupBy("event_id").agg(
        (F.sum("union_area_m2") / 1e6).alias("flood_area_km2"), F.max("source_key").alias("source_key")
    )
    dates = aggregates.event_bounds(named).select("event_id", F.col("event_start_date").alias("start_date"), F.col("event_end_date").alias("end_date"))
    # the overlap reads every extent of the event, whatever its source
    all_extents = extents.join(area.select("event_id"), "event_id", "left_semi")
    frequent = extents.where(F.col("source_key").startswith(f"{prefix}:gfd:frequency:"))
    if "geometry" in extents.columns:
        met = outlines.meeting(cells, outlines.outline(all_extents, ["event_id", "source_key"]), ["event_id", "source_key"], key).select("event_id", key)
        frequency = outlines.meeting(cells, outlines.outline(frequent, ["source_key"]), ["source_key"], key).join(
            frequent.groupBy("source_key").agg(F.max("event_count").alias("event_count")), "source_key")
    else:
        met = spatial.bbox_join(cells.select(key, "bbox"), all_extents.select("event_id", F.col("bbox").alias("right_bbox")), "bbox", "right_bbox").select("event_id", key)
        frequency = spatial.bbox_join(cells.select(key, "bbox"), frequent.select(F.col("bbox").alias("right_bbox"), "event_count"), "bbox", "right_bbox")
    # cells carry how many frequency extents they meet, so the fan-out is a weight and not a row explosion
    weights = frequency.groupBy(key).agg(
        F.count(F.lit(1)).alias("__w"), F.max("event_count").alias("__f")
    )
    if distinct_cells:
        met = met.distinct()
    facts = cells.select(key, "hand_mean_m", "local_relief_m", "distance_to_river_m", "distance_to_canal_m").join(weights, key, "left")
    rows = met.join(facts, key)
    weight = F.lit(1) if distinct_cells else F.coalesce(F.col("__w"), F.lit(1))

    def mean(value: Column, name: str) -> Column:
        return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight))).alias(name)

    hand = F.when(F.col("hand_mean_m").between(0, K.HAND_MAX_VALID_M), F.col("hand_mean_m"))
    overlap = rows.groupBy("event_id").agg(
        mean(hand, "mean_hand_m"), mean(F.col("local_relief_m"), "mean_local_relief_m"),
        mean(F.col("distance_to_river_m"), "mean_river_distance_m"), mean(F.col("distance_to_canal_m"), "mean_canal_distance_m"),
        F.max(F.coalesce("__f", F.lit(0))).alias("__freq"),
    )
    rain_columns = rain.select(
        F.col("observed_date"), F.col("mean_precipitation_mm").alias("rainfall_24h_mm"),
        *[F.col(f"accumulation_{d}d_mm").alias(n) for d, n in ((3, "rainfall_72h_mm"), (7, "rainfall_7d_mm"), (30, "rainfall_30d_mm"))],
    )
    joined = joins.join_event_rain(dates.join(area, "event_id"), rain_columns, "left", "start_date").join(overlap, "event_id", "left")
    full = joined.withColumn("historical_flood_frequency", F.coalesce("__freq", F.lit(0))).drop("__freq").withColumn(
        "label_source", F.when(F.col("source_key").startswith(f"{prefix}:sar:"), "sar").otherwise("gfd")
    )
    return aggregates.with_global_max(full, "flood_area_km2", "max_flood_area_km2")


# --- enrichment pipelines -----------------------------------------------------------------


def build_terrain_grid(boundary: DataFrame, pixels: DataFrame, segments: DataFrame, size_m: int = 500, zone: int = 46, dataset: str = "terrain") -> DataFrame:
    """Grid, zonal elevation, network distance, percentile and relief."""
    grid = spatial.square_grid(boundary, size_m, zone).withColumn("cell_id", F.concat_ws(":", F.lit(dataset), "grid_i", "grid_j"))
    inside = raster.clip_pixels(pixels, boundary)
    # stored, since a join on the indices would have their projection filtered for nulls at every pixel where pixels are read
    stats = materialize(raster.zonal_stats(raster.assign_cells(inside, size_m, zone), ["grid_i", "grid_j"]))
    # stored, so that the search projects plain columns instead of the expressions that the centres are made by
    cells = materialize(polygons.spread(grid.join(stats.where(F.col("elevation_sample_count") > 0), ["grid_i", "grid_j"])))
    near = spatial.distance_to_network(cells, segments, "cell_id", zone)
    relief = S.relief("elevation_min_m", "elevation_max_m")
    full = cells.join(near, "cell_id", "left").withColumns(
        {"local_relief_m": relief, "relief_angle_degrees": S.relief_angle("elevation_min_m", "elevation_max_m", F.lit(float(size_m)))}
    )
    return with_percentile(full, "elevation_mean_m", name="elevation_percentile")


def enrich_land_cover(cells: DataFrame, pixels: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells with pixel count, dominant class and class shares."""
    return cells.join(raster.zonal_classes(pixels, [key]), key, "left")


def enrich_hand(cells: DataFrame, pixels: DataFrame, key: str = "cell_id", nodata: float = -3.4028234663852886e38) -> DataFrame:
    """D3: cells with height above drainage. Cells whose statistics fall outside the valid range get none."""
    stats = raster.zonal_stats(raster.drop_nodata(pixels, nodata), [key], name="hand")
    valid = stats.where(
        (F.col("hand_sample_count") > 0) & F.col("hand_mean_m").between(0, K.HAND_MAX_VALID_M) & (F.col("hand_min_m") >= 0)
    )
    bare = cells.drop(*[c for c in valid.columns if c != key])
    return validate.scrub_hand(bare.join(valid, key, "left"))


def enrich_waterways(cells: DataFrame, segments: DataFrame, key: str = "cell_id") -> DataFrame:
    """Cells with river, canal and least distance. Empty sources fail when the plan runs."""
    near = spatial.nearest_waterway(cells, segments, key)
    return cells.drop("distance_to_river_m", "distance_to_canal_m", "distance_to_waterway_m").join(near, key, "left")


def build_rain_history(payloads: DataFrame, samples: DataFrame, source_key: str = "rain") -> DataFrame:
    """From archive payloads to daily rows with weighted statistics and 3, 7 and 30-row sums.

    When a day occurs in several yearly chunks, the later chunk wins.
    """
    from hydrolens.sources.rain import explode_archive

    values = explode_archive(payloads, samples)
    newest = values.groupBy("observed_date").agg(F.max("chunk").alias("chunk"))
    daily = R.daily_rain(values.join(newest, ["observed_date", "chunk"]))
    return R.rolling_rows(daily.withColumn("source_key", F.lit(source_key)))


# --- label import -------------------------------------------------------------------------


def import_extents(features: DataFrame, boundary: DataFrame | None, group_by: str, source_key: str, bucket_deg: float = 0.01):
    """Features grouped by a property, dissolved and clipped.

    Returns (extents, pieces, skipped, rejected): one row per group with its area, box and counts; the disjoint
    pieces that make up each extent; groups that do not meet the boundary; features without a usable group value.
    A dissolved extent is kept as its outline (see ``operators.outlines``), which the overlays take; so no task has to hold a whole extent.
    """
    usable, rejected = validate.validate(features, validate.group_rules("properties", group_by))
    grouped = usable.withColumn("group_value", F.try_element_at("properties", F.lit(group_by)))
    parts = materialize(polygons.polygonal_parts(grouped.select("group_value", "geometry")))
    if boundary is None:
        pieces = polygons.dissolve(parts, ["group_value"], bucket_deg)
    else:
        pieces = polygons.clip_to_boundary(parts, boundary, ["group_value"], bucket_deg)
    pieces = materialize(outlines.boxed(pieces))
    measured = pieces.groupBy("group_value").agg(
        (F.sum("area_m2") / 1e6).alias("area_km2"),
        F.struct(*[f(f"box.{c}").alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]).alias("bbox"),
        F.count(F.lit(1)).alias("pieces"),
    )
    sources = parts.groupBy("group_value").agg(F.count(F.lit(1)).alias("source_feature_count"))
    key = F.concat(F.lit(f"{source_key}:{group_by}="), S.key_suffix("group_value"))
    extents = sources.join(measured, "group_value").withColumn("source_key", key)
    skipped = sources.join(measured.select("group_value"), "group_value", "left_anti").select(
        "group_value", F.lit("flood polygons do not overlap the boundary").alias("reason")
    )
    return extents, pieces, skipped, rejected


GFD_PROPERTIES = ["event_year", "dfo_country", "dfo_main_cause", "dfo_severity", "dfo_dead", "dfo_displaced", "source_dataset",
                  "processing_scale_m", "permanent_water_excluded"]
SAR_PROPERTIES = ["reference_gfd_event_id", "event_year", "source_dataset", "label_method", "sar_polarization", "sar_vh_threshold_db",
                  "baseline_window_days", "processing_scale_m", "permanent_water_excluded", "dfo_country", "dfo_main_cause"]


def _import_events(features, boundary, source: str, prefix: str, optional: list[str], sensor: str, bucket_deg: float):
    """Event extents with consistent properties. Returns (extents, pieces, skipped, rejected)."""
    def prop(name: str) -> Column:
        return F.try_element_at("properties", F.lit(name)).alias(name)

    extents, pieces, skipped, rejected = import_extents(features, boundary, "event_id", f"{prefix}:{source}:event", bucket_deg)
    flat = features.select(*[prop(n) for n in ("event_id", "event_start_date", "event_end_date", *optional)])
    consistent = validate.event_properties(flat, optional=optional)
    event = S.key_suffix("group_value")
    joined = extents.drop("source_key").join(consistent.withColumnRenamed("event_id", "group_value"), "group_value")
    start, end = S.parse_iso_date("event_start_date"), S.parse_iso_date("event_end_date")
    bad = ~F.col("consistent") | start.isNull() | end.isNull()
    described = joined.select(
        event.alias("event_id"), F.concat(F.lit(f"{prefix}:{source}:event:"), event).alias("source_key"),
        F.concat(F.lit(f"{source.upper()} event "), event, F.lit(" ("), F.col("event_start_date"), F.lit(")")).alias("event_name"),
        start.alias("observed_date"), start.alias("observed_start_date"), end.alias("observed_end_date"), F.lit(sensor).alias("sensor"),
        F.lit("flood").alias("classification"), F.lit("moderate").alias("confidence"), F.lit(False).alias("field_validated"),
        "area_km2", "bbox", "source_feature_count", *optional, bad.alias("__bad"),
    )
    inconsistent = described.where("__bad").select(F.col("event_id").alias("group_value"), F.lit("missing or inconsistent event dates").alias("reason"))
    pieces = pieces.withColumn("event_id", event)
    return described.where(~F.col("__bad")).drop("__bad"), pieces, skipped.unionByName(inconsistent), rejected


def import_gfd_events(features: DataFrame, boundary: DataFrame | None, prefix: str = "demo", bucket_deg: float = 0.01):
    """D7."""
    return _import_events(features, boundary, "gfd", prefix, GFD_PROPERTIES, "Terra/Aqua MODIS", bucket_deg)


def import_sar_events(features: DataFrame, boundary: DataFrame | None, prefix: str = "demo", bucket_deg: float = 0.01):
    """Aliases are normalised first; a missing reference id comes from the ``sar-`` form of the event id."""
    named = features.withColumn("properties", S.normalize_sar("properties"))
    extents, pieces, skipped, rejected = _import_events(named, boundary, "sar", prefix, SAR_PROPERTIES, "Sentinel-1", bucket_deg)
    reference = F.coalesce(
        "reference_gfd_event_id", F.when(F.col("event_id").startswith("sar-"), S.strip_prefix("event_id", "sar-"))
    )
    return extents.withColumn("reference_gfd_event_id", reference).withColumn("label_source", F.lit("sar")), pieces, skipped, rejected


