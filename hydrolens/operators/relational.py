"""Filters, pages, lookups, patches, orders, top-k and set operations over the product tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.functions import geo
from hydrolens.functions import scalars as S

# --- paging -------------------------------------------------------------------------------


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, size: int = 100) -> DataFrame:
    """Rows of one page; ``orderBy`` + ``limit`` plans as a distributed top-k of ``page * size`` rows."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_meta(df: DataFrame, page: int = 1, size: int = 100) -> DataFrame:
    """One row: page, page_size, total and number of pages."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(page).alias("page"),
        F.lit(size).alias("page_size"),
        "total",
        F.ceil(F.col("total") / size).alias("pages"),
    )


def _where(df: DataFrame, **equals) -> DataFrame:
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


# --- filters ------------------------------------------------------------------------------


def list_assets(assets: DataFrame, asset_type: str | None = None) -> DataFrame:
    return _where(assets, asset_type=asset_type)


def assets_in_bounds(
    assets: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, asset_type: str | None = None,
    exact: bool = True,
) -> DataFrame:
    """Assets meeting a box: stored bbox first (pushed to the scan), then the exact test."""
    if xmin >= xmax or ymin >= ymax:
        raise ValueError("minimum coordinates must be below maximum coordinates")
    window = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("xmin", "ymin", "xmax", "ymax"), (xmin, ymin, xmax, ymax))])
    near = _where(assets, asset_type=asset_type).where(geo.bbox_intersects("geometry.bbox", window))
    if not exact:
        return near
    from hydrolens.operators.polygons import intersects

    return near.where(intersects(F.col("geometry"), geo.box(*map(F.lit, (xmin, ymin, xmax, ymax)))))


def list_layers(layers: DataFrame, category=None, quality_status=None, is_active=None) -> DataFrame:
    return _where(layers, category=category, quality_status=quality_status, is_active=is_active)


def extents_overlapping(extents: DataFrame, start=None, end=None, classification=None) -> DataFrame:
    """Extents whose date span meets [start, end]; a missing bound falls back to the observed date."""
    df = _where(extents, classification=classification)
    if start is not None:
        df = df.where(F.coalesce("observed_end_date", "observed_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.coalesce("observed_start_date", "observed_date") <= F.lit(end).cast("date"))
    return df


def list_observations(observations: DataFrame, station_id=None, quality_status=None, since=None, until=None) -> DataFrame:
    df = _where(observations, station_id=station_id, quality_status=quality_status)
    kind = dict(observations.dtypes)["observed_at"]
    if since is not None:
        df = df.where(F.col("observed_at") >= F.lit(since).cast(kind))
    if until is not None:
        df = df.where(F.col("observed_at") <= F.lit(until).cast(kind))
    return df


def list_alerts(alerts: DataFrame, status=None, risk_level=None, station_id=None) -> DataFrame:
    return _where(alerts, status=status, risk_level=risk_level, station_id=station_id)


def list_stations(stations: DataFrame, status=None) -> DataFrame:
    return _where(stations, status=status)


def rain_history(rain: DataFrame, start=None, end=None, limit: int = 365) -> DataFrame:
    """The newest ``limit`` days of a range, oldest first."""
    df = rain
    if start is not None:
        df = df.where(F.col("observed_date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("observed_date") <= F.lit(end).cast("date"))
    return df.orderBy(F.col("observed_date").desc()).limit(limit).orderBy("observed_date")


def with_keys(df: DataFrame, *keys: str, properties: str = "properties") -> DataFrame:
    return df.where(S.has_keys(properties, *keys))


def normalize_label_source(source: str) -> str:
    name = source.strip().lower()
    if name not in ("gfd", "sar", "all"):
        raise ValueError(f"unsupported label source {source!r}; expected gfd, sar or all")
    return name


def by_label_source(extents: DataFrame, source: str, prefix: str) -> DataFrame:
    """Event extents of one provenance; keys look like ``<prefix>:<source>:event:<id>``."""
    name = normalize_label_source(source)
    return extents if name == "all" else extents.where(F.col("source_key").startswith(f"{prefix}:{name}:event:"))


def get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def search_segments(segments: DataFrame, query: str, asset_type: str | None = None,
                    columns: Sequence[str] = ("name", "osm_id", "waterway")) -> DataFrame:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return _where(segments, asset_type=asset_type).where(text.contains(query.strip().lower()))


# --- changes ------------------------------------------------------------------------------


def apply_patches(target: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Bulk partial update: a patch row holds the key and ``changes MAP<STRING,STRING>``.

    Only keys present in the map change a column, so a present null clears it.
    """
    joined = target.join(patches.select(key, F.col("changes").alias("__changes")), key, "left")
    supplied = {
        f.name: F.coalesce(F.map_contains_key("__changes", F.lit(f.name)), F.lit(False))
        for f in target.schema.fields
        if f.name != key
    }
    return joined.select(
        *[
            F.col(f.name)
            if f.name == key
            else F.when(supplied[f.name], F.try_element_at("__changes", F.lit(f.name)).cast(f.dataType))
            .otherwise(F.col(f.name))
            .alias(f.name)
            for f in target.schema.fields
        ]
    )


def split_ordered(df: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(rows with start <= end or an open end, rows out of order), the check after a patch."""
    ordered = F.coalesce(F.col(start) <= F.col(end), F.lit(True))
    return df.where(ordered), df.where(~ordered)


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Set open alerts to acknowledged; alerts acknowledged before keep who did it."""
    a = acks.select("alert_id", *[F.col(c).alias(f"__{c}") for c in ("acknowledged_by", "acknowledged_at", "notes")])
    joined = alerts.join(a, "alert_id", "left")
    changes = F.col("__acknowledged_by").isNotNull() & (F.col("status") != "acknowledged")

    def pick(new: Column, old: str) -> Column:
        current = F.col(old) if old in alerts.columns else F.lit(None)
        return F.when(changes, new).otherwise(current).alias(old)

    kept = [c for c in alerts.columns if c not in ("status", "acknowledged_by", "acknowledged_at", "acknowledgement_notes")]
    return joined.select(
        *kept,
        F.when(changes, "acknowledged").otherwise(F.col("status")).alias("status"),
        pick(F.col("__acknowledged_by"), "acknowledged_by"),
        pick(F.col("__acknowledged_at"), "acknowledged_at"),
        pick(F.col("__notes"), "acknowledgement_notes"),
    )


def delete_ids(target: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return target.join(ids.select(key), key, "left_anti")


# --- projections --------------------------------------------------------------------------


def to_feature_rows(df: DataFrame, key: str, properties: Sequence[str], geometry: str | None = None,
                    rounded: dict[str, int] | None = None) -> DataFrame:
    """Publishable rows: id, optional geometry and a struct of properties (some rounded)."""
    rounded = rounded or {}
    fields = [
        (S.round_exact(c, rounded[c]).alias(c) if c in rounded else F.col(c)) for c in properties
    ]
    shape = [F.col(geometry).alias("geometry")] if geometry else []
    return df.select(F.lit("Feature").alias("type"), F.col(key).alias("id"), *shape, F.struct(*fields).alias("properties"))


def layer_availability(assets: DataFrame) -> DataFrame:
    """One row of flags: which kinds of layer hold at least one asset."""
    kind, props = F.col("asset_type"), F.col("properties")
    land_cover = ("land_cover_dominant_code", "land_cover_dataset_id", "land_cover_percentages")
    has_cover = F.lit(False)
    for name in land_cover:
        has_cover = has_cover | F.coalesce(F.map_contains_key(props, F.lit(name)), F.lit(False))

    def any_of(condition: Column, alias: str) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False)).alias(alias)

    return assets.agg(
        any_of(kind == "river_segment", "has_river"),
        any_of(kind == "canal_segment", "has_canal"),
        any_of(kind.contains("road"), "has_road"),
        any_of((kind == "terrain_cell") & has_cover, "has_land_cover"),
        any_of((kind == "terrain_cell") & F.coalesce(F.map_contains_key(props, F.lit("hand_mean_m")), F.lit(False)), "has_hand"),
        any_of(kind == "historical_flood_extent", "has_flood_history"),
    )


# --- orders, top-k ------------------------------------------------------------------------


def order_screening(df: DataFrame, key: str = "cell_id") -> DataFrame:
    return df.orderBy(F.col("screening_score").desc(), F.col(key).cast("string").asc())


def order_probability(df: DataFrame, key: str = "cell_id") -> DataFrame:
    return df.orderBy(F.col("probability").desc(), F.col(key).asc())


def latest(df: DataFrame, ts: str, tie: str, **equals) -> DataFrame:
    """The newest row that matches the filters."""
    return _where(df, **equals).orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(1)


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Newest row of every key through ``max_by``: partial aggregation keeps hot keys small."""
    others = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(F.col(ts), F.col(tie)))
    return df.groupBy(key).agg(best.alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*df.columns)


def list_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    total = runs.agg(F.count(F.lit(1)).alias("total"))
    newest = runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(limit)
    return newest.crossJoin(F.broadcast(total))  # one row


def top_contributions(features: Sequence[str], standardized: Sequence[Column], coefficients: Sequence[float], k: int = 3) -> Column:
    """The ``k`` largest linear contributions by size, as array of structs (ties keep feature order)."""
    items = F.array(
        *[
            F.struct(
                (-F.abs(z * F.lit(float(w)))).alias("__size"),
                F.lit(i).alias("__position"),
                F.lit(name).alias("feature"),
                z.alias("standardized_value"),
                (z * F.lit(float(w))).alias("contribution"),
            )
            for i, (name, z, w) in enumerate(zip(features, standardized, coefficients))
        ]
    )
    return F.transform(
        F.slice(F.array_sort(items), 1, k),
        lambda s: F.struct(
            s["feature"].alias("feature"),
            S.round_exact(s["standardized_value"], 4).alias("standardized_value"),
            S.round_exact(s["contribution"], 4).alias("contribution"),
        ),
    )


def top_false_positives(df: DataFrame, threshold: float, n: int = 50, key: str = "row_key") -> DataFrame:
    wrong = df.where((F.col("label") == 0) & (F.col("decision_probability") >= F.lit(threshold)))
    return wrong.orderBy(F.col("decision_probability").desc(), F.col(key).asc()).limit(n)


def select_event(events: DataFrame, event_id: str | None = None) -> DataFrame:
    """The requested event, else the newest test event, else the newest event."""
    if event_id is not None:
        return events.where(F.col("event_id") == event_id).limit(1)
    return events.orderBy(
        (F.col("split") == "test").desc(), F.col("event_start_date").desc(), F.col("event_id")
    ).limit(1)


def highest_alert(alerts: DataFrame) -> DataFrame:
    severity = F.array_position(F.array(*map(F.lit, K.ALERT_LEVELS)), F.col("risk_level"))
    return (
        alerts.where(F.col("status") == "open")
        .orderBy(severity.desc(), F.col("created_at").desc(), F.col("alert_id"))
        .limit(1)
    )


def group_keys(column: str) -> list[Column]:
    """Sort keys for mixed group values: numbers first, in numeric order, then text."""
    text = F.col(column).cast("string")
    number = text.try_cast("double")
    return [number.isNull(), F.coalesce(number, F.lit(0.0)), text]


def order_groups(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(*[k.asc() for k in group_keys(column)])


def extreme_cells(cells: DataFrame, products: dict[str, tuple[DataFrame, str]], key: str = "cell_id",
                  elevation: str = "elevation_mean_m") -> DataFrame:
    """One row: lowest cell and, for each product (frame, score column), its top cell among ``cells``."""
    result = cells.agg(F.min_by(key, F.struct(elevation, key)).alias("lowest_elevation"))
    for name, (frame, score) in products.items():
        known = frame.join(cells.select(key), key, "left_semi")
        top = known.agg(F.min_by(key, F.struct((-F.col(score)).alias("s"), F.col(key))).alias(f"top_{name}"))
        result = result.crossJoin(F.broadcast(top))  # one row each
    return result


# --- sets ---------------------------------------------------------------------------------


def distinct_events(extents: DataFrame) -> DataFrame:
    named = extents.where(F.col("event_id").isNotNull() & F.col("observed_start_date").isNotNull())
    return named.select("event_id", "observed_start_date").distinct()


def map_assets(*frames: DataFrame) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def shared_assets(a: DataFrame, b: DataFrame, key: str = "cell_id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def merge_rain(forecast: DataFrame, history: DataFrame) -> DataFrame:
    """One row per date, forecast over history; the inputs hold (date, precipitation_mm)."""
    both = forecast.select("date", "precipitation_mm", F.lit(1).alias("__priority")).unionByName(
        history.select("date", "precipitation_mm", F.lit(0).alias("__priority"))
    )
    return both.groupBy("date").agg(
        F.greatest(F.lit(0.0), F.max_by("precipitation_mm", "__priority")).alias("precipitation_mm")
    )


def merge_feed(current: DataFrame, new: DataFrame, limit: int = 500, key: str = "message_id", ts: str = "observed_at") -> DataFrame:
    """Newer rows replace rows of the same id; the newest ``limit`` remain."""
    both = new.withColumn("__new", F.lit(1)).unionByName(current.withColumn("__new", F.lit(0)))
    columns = new.columns
    kept = both.groupBy(key).agg(F.max_by(F.struct(*columns), "__new").alias("__row")).select("__row.*")
    return kept.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)


def last_levels(readings: DataFrame, n: int = 48, station: str = "station_id", ts: str = "observed_at",
                level: str = "water_level_cm", key: str = "message_id") -> DataFrame:
    """The newest ``n`` non-null levels per station.

    ``row_number() <= n`` plans as a group limit: every map task keeps at most ``n`` rows per station
    before the shuffle, so a hot station stays small.
    """
    newest = Window.partitionBy(station).orderBy(F.col(ts).desc(), F.col(key).desc())
    return readings.where(F.col(level).isNotNull()).withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def latest_observations(observations: DataFrame, limit: int, key: str = "observation_id") -> DataFrame:
    newest = latest_per_key(observations, "station_id", "observed_at", key)
    return newest.orderBy(F.col("observed_at").desc(), F.col(key).desc()).limit(limit)
