"""Scalar rules as column expressions: fractions, bands, classifications, keys and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolens.functions import constants as K


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def round_exact(value, digits: int) -> Column:
    """Round the exact binary value, halves to even, as C and Python do for doubles.

    ``format_number`` works on the exact value, whereas ``round`` works on the shortest decimal text.
    """
    return F.translate(F.format_number(_col(value), digits), ",", "").cast("double")


# --- semi-structured properties -----------------------------------------------------------


def json_double(properties, path: str, *defaults) -> Column:
    """Number at ``path`` of a JSON text, or the first non-null default."""
    found = F.try_variant_get(F.try_parse_json(_col(properties)), path, "double")
    return F.coalesce(found, *[_col(d) for d in defaults]) if defaults else found


def json_merge(base, patch) -> Column:
    """Right-biased merge of two maps (either may be null)."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(_col(base), empty), F.coalesce(_col(patch), empty)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def json_set(base, key: str, value) -> Column:
    return json_merge(base, F.create_map(F.lit(key), _col(value).cast("string")))


def json_drop(base, *keys: str) -> Column:
    return F.map_filter(_col(base), lambda k, _: ~k.isin(*keys))


def has_keys(base, *keys: str) -> Column:
    present = [F.map_contains_key(_col(base), F.lit(k)) for k in keys]
    result = present[0]
    for condition in present[1:]:
        result = result & condition
    return result


def class_map(code, share) -> Column:
    """Aggregate: map of class code to share, keys in order."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(_col(code), _col(share)))))


# --- fractions and labels -----------------------------------------------------------------


def as_fraction(value) -> Column:
    """A share stored as 0-1 or 0-100, as a fraction. Values above one are read as percent."""
    x = _col(value)
    return clip(F.when(x > 1.0, x / 100.0).otherwise(x), 0.0, 1.0)


def surface_water_share(water, wetland, mangrove) -> Column:
    """Permanent water, each class normalised on its own before summing."""
    return F.least(F.lit(1.0), as_fraction(water) + as_fraction(wetland) + as_fraction(mangrove))


def flood_excess(fraction, water, wetland, mangrove) -> Column:
    return F.greatest(F.lit(0.0), _col(fraction) - surface_water_share(water, wetland, mangrove))


def target_label(threshold: float, mode: str = "flood_excess", *, fraction="flooded_fraction",
                 water="landcover_water_pct", wetland="landcover_wetland_pct",
                 mangrove="landcover_mangrove_pct") -> Column:
    if mode == "flood_extent":
        score = _col(fraction)
    elif mode == "flood_excess":
        score = flood_excess(fraction, water, wetland, mangrove)
    else:
        raise ValueError(f"unsupported label mode: {mode}")
    return (score >= F.lit(float(threshold))).cast("int")


def _share(shares, code: int) -> Column:
    return F.coalesce(F.try_element_at(_col(shares), F.lit(code)), F.lit(0.0))


def surface_water(shares) -> Column:
    """Permanent water from a class map: classes are summed first, then read as percent if above one."""
    total = _share(shares, 80) + _share(shares, 90) + _share(shares, 95)
    return F.coalesce(clip(F.when(total > 1.0, total / 100.0).otherwise(total), 0.0, 1.0), F.lit(0.0))


def built_up(shares) -> Column:
    return F.coalesce(as_fraction(_share(shares, 50)), F.lit(0.0))


def class_columns(shares) -> dict[str, Column]:
    """Named land-cover shares from a class map; missing classes are zero, percents become fractions."""
    result = {}
    for name, code in K.LANDCOVER_FEATURES.items():
        x = _share(shares, code)
        result[name] = F.when(x > 1.0, x / 100.0).otherwise(x)
    return result


def temper(probability, water, beta) -> Column:
    """Lower a probability over permanent water."""
    return clip(_col(probability) * (F.lit(1.0) - _col(beta) * clip(_col(water), 0.0, 1.0)), 0.0, 1.0)


def sigmoid(value) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(_col(value), -35.0, 35.0)))


# --- bands and classifications ------------------------------------------------------------


def _banded(value, edges, labels) -> Column:
    x = _col(value)
    chain = F.when(x < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        chain = chain.when(x < edge, label)
    return F.when(x.isNotNull(), chain.otherwise(labels[-1]))


def risk_band(probability) -> Column:
    return _banded(probability, [0.25, 0.50, 0.75], K.RISK_BANDS)


def screening_band(score) -> Column:
    return _banded(score, [25.0, 50.0, 75.0], K.SCREENING_BANDS)


def screening(elevation_percentile, distance_percentile, relief_percentile) -> Column:
    """Relative terrain index: struct of factor scores, contributions, score and band."""
    percentiles = dict(zip(K.SCREENING_FACTORS, (elevation_percentile, distance_percentile, relief_percentile)))
    normalized = {k: clip(F.lit(100.0) - _col(p), 0.0, 100.0) for k, p in percentiles.items()}
    contribution = {k: round_exact(n * F.lit(K.SCREENING_FACTORS[k][0]), 1) for k, n in normalized.items()}
    low, near, flat = (contribution[k] for k in K.SCREENING_FACTORS)
    score = round_exact(low + near + flat, 1)
    return F.struct(
        *[round_exact(n, 1).alias(f"{k}_score") for k, n in normalized.items()],
        *[c.alias(f"{k}_contribution") for k, c in contribution.items()],
        score.alias("score"),
        screening_band(score).alias("band"),
    )


def screening_factors(result, elevation, distance, relief) -> Column:
    """The explainable factor list of one screening result."""
    observed = dict(zip(K.SCREENING_FACTORS, (elevation, distance, relief)))
    r = _col(result)
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                F.lit(label).alias("label"),
                r[f"{key}_score"].alias("normalized_score"),
                F.lit(weight).alias("weight"),
                r[f"{key}_contribution"].alias("contribution"),
                round_exact(observed[key], 2).alias("observed_value"),
                F.lit(unit).alias("unit"),
            )
            for key, (weight, label, unit) in K.SCREENING_FACTORS.items()
        ]
    )


def classify_level(level, warning, danger, critical) -> Column:
    """Water level against a station's thresholds: struct(risk_level, threshold_cm, explanation)."""
    x, w, d, c = _col(level), _col(warning), _col(danger), _col(critical)
    no_value = F.lit(None).cast("double")
    crossed = "The water stands at or above the station's {} mark."

    def result(risk: str, threshold: Column, text: str) -> Column:
        return F.struct(
            F.lit(risk).alias("risk_level"), threshold.alias("threshold_cm"), F.lit(text).alias("explanation")
        )

    return (
        F.when(x.isNull(), result("UNAVAILABLE", no_value, "The reading has no water level."))
        .when(
            w.isNull() | d.isNull() | c.isNull(),
            result("UNAVAILABLE", no_value, "The station lacks one of its three marks."),
        )
        .when(x >= c, result("CRITICAL", c, crossed.format("critical")))
        .when(x >= d, result("HIGH", d, crossed.format("danger")))
        .when(x >= w, result("MEDIUM", w, crossed.format("warning")))
        .otherwise(result("LOW", no_value, "The water stands below the station's warning mark."))
    )


def early_warning(probability) -> Column:
    """struct(probability, level, recommendation)."""
    p = clip(_col(probability), 0.0, 1.0)
    level = _banded(p, [0.25, 0.50, 0.75], ["LOW", "MODERATE", "HIGH", "CRITICAL"])
    advice = _banded(
        p,
        [0.25, 0.50, 0.75],
        K.WARNING_ADVICE,
    )
    return F.struct(
        round_exact(p, 4).alias("probability"), level.alias("level"), advice.alias("recommendation")
    )


def scenario(probability, sar_detected, threshold: float = 0.5) -> Column:
    """struct(scenario, headline) from model and satellite evidence."""
    high, seen = _col(probability) >= F.lit(threshold), _col(sar_detected)

    def result(key: str, headline: str) -> Column:
        return F.struct(F.lit(key).alias("scenario"), F.lit(headline).alias("headline"))

    return (
        F.when(high & seen, result("confirmed_high_risk", "Confirmed high-risk flood"))
        .when(high, result("high_predicted_risk", "High predicted risk"))
        .when(seen, result("observed_flood_alert", "Observed flood alert"))
        .otherwise(result("low_risk", "Low combined risk"))
    )


def outcome(predicted, observed) -> Column:
    p, o = _col(predicted), _col(observed)
    return F.when(p & o, "tp").when(p, "fp").when(o, "fn").otherwise("tn")


def recommendation(precision, recall, rolling_precision) -> Column:
    p, r, rp = (F.coalesce(_col(x), F.lit(0.0)) for x in (precision, recall, rolling_precision))
    keep, pilot, precise, usable = map(F.lit, K.MODEL_ADVICE)
    return F.when(p < 0.20, keep).when((p < 0.35) | (rp < 0.25), pilot).when(r < 0.25, precise).otherwise(usable)


def area_risk_level(forecast=None, susceptibility=None, screening_summary=None) -> Column:
    """Area level from the best product at hand.

    Arguments are struct columns with ``total_cells`` and ``high_cells`` (``very_high_cells`` for the
    screening), and ``flagged_cells`` for the forecast; null structs are skipped.
    """

    def ratio(summary: Column, part: str) -> Column:
        return summary[part] / F.greatest(summary["total_cells"], F.lit(1))

    def level(high: Column, moderate: Column) -> Column:
        return F.when(high, "HIGH").when(moderate, "MODERATE").otherwise("LOW")

    options = []
    if forecast is not None:
        f = _col(forecast)
        r = ratio(f, "high_cells")
        options.append(
            F.when(
                f.isNotNull(),
                level((r >= 0.12) | (f["flagged_cells"] >= 400), (r >= 0.04) | (f["flagged_cells"] >= 80)),
            )
        )
    if susceptibility is not None:
        s = _col(susceptibility)
        r = ratio(s, "high_cells")
        options.append(F.when(s.isNotNull(), level(r >= 0.15, r >= 0.06)))
    if screening_summary is not None:
        t = _col(screening_summary)
        r = ratio(t, "very_high_cells")
        options.append(F.when(t.isNotNull(), level(r >= 0.08, r >= 0.03)))
    return F.coalesce(*options, F.lit("LOW"))


# --- land-cover names ---------------------------------------------------------------------


def _legend(code, index: int) -> Column:
    pairs = [item for c, entry in K.LAND_COVER_CLASSES.items() for item in (F.lit(c), F.lit(entry[index]))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(code).cast("int")), F.lit(K.UNKNOWN_CLASS[index]))


def class_name(code) -> Column:
    return _legend(code, 0)


def class_color(code) -> Column:
    return _legend(code, 1)


# --- keys and texts -----------------------------------------------------------------------


def canonical_timestamp(ts) -> Column:
    """The instant as UTC text with microseconds, whatever the time zone of the session."""
    micros, day = F.unix_micros(_col(ts).cast("timestamp")), F.lit(86_400_000_000)
    rest = F.pmod(micros, day)
    date = F.date_from_unix_date(((micros - rest) / day).cast("int"))

    def digits(unit: int, most: int | None, width: int) -> Column:
        n = F.floor(rest / unit) if most is None else F.floor(rest / unit) % most
        return F.lpad(n.cast("string"), width, "0")

    clock = F.concat(digits(3_600_000_000, None, 2), F.lit(":"), digits(60_000_000, 60, 2), F.lit(":"), digits(1_000_000, 60, 2), F.lit("."), digits(1, 1_000_000, 6))
    return F.concat(date.cast("string"), F.lit("T"), clock)


def utc_day(ts) -> Column:
    """The UTC date of an instant."""
    return F.to_date(F.substring(canonical_timestamp(ts), 1, 10))


def ingestion_key(station, ts, source) -> Column:
    """Identity of a reading: station, instant (canonical UTC text) and trimmed source."""
    return F.sha2(
        F.concat_ws("|", _col(station).cast("string"), canonical_timestamp(ts), F.trim(_col(source))), 256
    )


def spatial_block(longitude, latitude, size: float = 0.04) -> Column:
    def index(x):
        return F.floor(_col(x) / F.lit(size)).cast("string")

    return F.concat_ws(":", index(longitude), index(latitude))


def spatial_bucket(longitude, latitude) -> Column:
    """0-9, the same for every point of one 0.04 degree block."""
    digest = F.substring(F.sha2(spatial_block(longitude, latitude), 256), 1, 8)
    return (F.conv(digest, 16, 10).cast("bigint") % 10).cast("int")


def spatial_split(longitude, latitude) -> Column:
    bucket = spatial_bucket(longitude, latitude)
    return F.when(bucket <= 1, "test").when(bucket == 2, "validation").otherwise("train")


def key_suffix(value) -> Column:
    """Text safe to append to a source key; null when nothing remains."""
    cleaned = F.trim(F.regexp_replace(_col(value).cast("string"), "[^a-zA-Z0-9._-]+", "-"))
    return F.nullif(F.regexp_replace(cleaned, "^-+|-+$", ""), F.lit(""))


def strip_prefix(value, prefix: str) -> Column:
    x = _col(value)
    return F.when(x.startswith(prefix), F.substr(x, F.lit(len(prefix) + 1))).otherwise(x)


def topic_station(subscription: str, topic) -> Column:
    """Text captured by the last ``+`` level of a subscription; null when the topic does not fit it."""
    parts = subscription.split("/")
    levels = F.split(_col(topic), "/", -1)
    fits = F.size(levels) == len(parts)
    captured = F.lit(None).cast("string")
    for position, part in enumerate(parts):
        level = F.get(levels, F.lit(position))
        if part == "+":
            captured = level
        else:
            fits = fits & (level == part)
    return F.when(fits, captured)


def parse_iso_date(value) -> Column:
    """Date from strict YYYY-MM-DD text, null otherwise (a validation rule reports it)."""
    x = _col(value)
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def relief(low, high) -> Column:
    return _col(high) - _col(low)


def relief_angle(low, high, size_m) -> Column:
    return F.degrees(F.atan(relief(low, high) / _col(size_m)))


def alert_message(name, level, explanation) -> Column:
    shown = F.translate(F.format_number(_col(level), 1), ",", "")
    return F.concat(_col(name), F.lit(" reported "), shown, F.lit(" cm. "), _col(explanation))


def normalize_sar(properties) -> Column:
    """Canonical names and defaults for satellite event properties held in a map."""
    p = _col(properties)

    def either(canonical: str, alias: str) -> Column:
        return F.coalesce(F.try_element_at(p, F.lit(canonical)), F.try_element_at(p, F.lit(alias)))

    def value(key: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(p, F.lit(key)), F.lit(default))

    patch = F.create_map(
        F.lit("sar_polarization"), either("sar_polarization", "polarization"),
        F.lit("sar_vh_threshold_db"), either("sar_vh_threshold_db", "vh_threshold_db"),
        F.lit("processing_scale_m"), either("processing_scale_m", "resolution_m"),
        F.lit("baseline_window_days"), value("baseline_window_days", "21"),
        F.lit("permanent_water_excluded"), value("permanent_water_excluded", "false"),
    )
    return json_merge(p, F.map_filter(patch, lambda _, v: v.isNotNull()))
