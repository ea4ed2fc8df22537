"""Raster work on pixel tables: zonal statistics, class shares, focal filters, patches and change detection.

A pixel table holds one row per pixel. Neighbourhood filters gather whole tiles with a thin halo, so a
shuffle moves each pixel about once and a task holds one tile, whatever the size of the raster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolens.functions import geo
from hydrolens.functions import scalars as S
from hydrolens.operators import outlines, polygons
from hydrolens.session import materialize

TILE = 256

# --- pixels to cells ----------------------------------------------------------------------


def with_tile(pixels: DataFrame, size: int = TILE, row: str = "px_row", column: str = "px_col") -> DataFrame:
    return pixels.withColumns(
        {"tile_row": F.floor(F.col(row) / size).cast("int"), "tile_col": F.floor(F.col(column) / size).cast("int")}
    )


def tile_footprints(pixels: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    return pixels.groupBy("tile_row", "tile_col").agg(
        F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"), F.count(F.lit(1)).alias("pixels")
    )


def drop_nodata(pixels: DataFrame, nodata: float, value: str = "value") -> DataFrame:
    return pixels.where(F.col(value).isNotNull() & (F.col(value) != F.lit(nodata)))


def assign_cells(pixels: DataFrame, size_m: int = 500, zone: int = 46) -> DataFrame:
    """Grid indices of each pixel centre, by arithmetic."""
    u = geo.to_utm("lon", "lat", zone)
    return pixels.withColumn("__u", u).withColumns(
        {"grid_i": F.floor(F.col("__u.x") / size_m).cast("bigint"), "grid_j": F.floor(F.col("__u.y") / size_m).cast("bigint")}
    ).drop("__u")


def pixel_cell_join(cells: DataFrame, pixels: DataFrame, on: Sequence[str] = ("grid_i", "grid_j")) -> DataFrame:
    return pixels.join(cells, list(on))


def zonal_stats(pixels: DataFrame, keys: Sequence[str] = ("cell_id",), value: str = "value", name: str = "elevation") -> DataFrame:
    """Count, mean, min, max and population deviation of the pixels of each cell."""
    v = F.col(value)
    return pixels.groupBy(*keys).agg(
        F.count(v).alias(f"{name}_sample_count"), F.avg(v).alias(f"{name}_mean_m"), F.min(v).alias(f"{name}_min_m"),
        F.max(v).alias(f"{name}_max_m"), F.stddev_pop(v).alias(f"{name}_stddev_m"),
    )


def class_counts(pixels: DataFrame, keys: Sequence[str] = ("cell_id",), code: str = "class_code") -> DataFrame:
    return pixels.where(F.col(code) != 0).groupBy(*keys, code).agg(F.count(F.lit(1)).alias("pixel_count"))


def percent_hundredths(part: Column, total: Column) -> Column:
    """100 * part / total with two digits, halves up, in exact integer arithmetic."""
    return F.floor((part * 20000 + total) / (total * 2)) / 100.0


def dominant_class(counts: DataFrame, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Class with most pixels per cell, the lower code on ties."""
    return counts.groupBy(*keys).agg(
        F.max_by("class_code", F.struct(F.col("pixel_count"), -F.col("class_code"))).alias("land_cover_dominant_code")
    )


def dominant_from_map(dominant, shares) -> Column:
    """Stored dominant code, else the code of the largest share (first on ties)."""
    entries = F.transform(
        F.map_entries(F.col(shares)), lambda e, i: F.struct(-e["value"], i, e["key"].alias("code"))
    )
    return F.coalesce(F.col(dominant), F.get(F.array_sort(entries), F.lit(0))["code"])


def zonal_classes(pixels: DataFrame, keys: Sequence[str] = ("cell_id",), code: str = "class_code") -> DataFrame:
    """Pixel count, dominant class and share map of each cell. A cell has at most one row per class."""
    counts = class_counts(pixels, keys, code)
    entry = F.struct(F.col(code), F.col("pixel_count"))
    grouped = counts.groupBy(*keys).agg(
        F.sum("pixel_count").alias("land_cover_pixel_count"),
        F.max_by(code, F.struct(F.col("pixel_count"), -F.col(code))).alias("land_cover_dominant_code"),
        F.sort_array(F.collect_list(entry)).alias("__classes"),  # bounded by the legend
    )
    total = F.col("land_cover_pixel_count")
    shares = F.map_from_entries(
        F.transform("__classes", lambda c: F.struct(c[code], percent_hundredths(c["pixel_count"], total)))
    )
    return grouped.select(
        *keys, "land_cover_pixel_count", "land_cover_dominant_code",
        S.class_name("land_cover_dominant_code").alias("land_cover_dominant_name"), shares.alias("land_cover_percentages"),
    )


def clip_pixels(pixels: DataFrame, boundary: DataFrame, x: str = "lon", y: str = "lat", bucket_deg: float = 0.01) -> DataFrame:
    """Pixels whose centre lies inside the boundary, through the boundary's disjoint pieces per grid bucket."""
    pieces = outlines.boxed(polygons.dissolve(boundary.select(F.lit(1).alias("__b"), "geometry"), ["__b"], bucket_deg)).withColumn("__plain", outlines._is_box())
    # the test costs far more a pixel than reading, and a file of few row groups is read by few tasks
    homes = polygons.spread(pixels).withColumn("bx", F.floor(F.col(x) / bucket_deg).cast("bigint")).withColumn("by", F.floor(F.col(y) / bucket_deg).cast("bigint"))
    # half-open even-odd test, so a pixel on a shared side belongs to one piece only
    ends = "xy[2 * i] AS x0, xy[2 * i + 1] AS y0, xy[2 * i + 2] AS x1, xy[2 * i + 3] AS y1"
    ends = ", ".join(f"'{e.split(' AS ')[1]}', {e.split(' AS ')[0]}" for e in ends.split(", "))
    test = (
        f"aggregate(transform(sequence(0, size(xy) div 2 - 2), i -> named_struct({ends})), 0, (n, s) -> n + "
        f"if((s.y0 > {y}) != (s.y1 > {y}) AND {x} < s.x0 + ({y} - s.y0) * (s.x1 - s.x0) / (s.y1 - s.y0), 1, 0)) % 2 = 1"
    )
    b = F.col("box")
    in_box = (F.col(x) >= b["xmin"]) & (F.col(x) < b["xmax"]) & (F.col(y) >= b["ymin"]) & (F.col(y) < b["ymax"])  # the same for a box
    held = F.when(F.col("__plain"), in_box).otherwise(F.expr(test))
    return homes.join(pieces.select("bx", "by", "xy", "box", "__plain"), ["bx", "by"]).where(held).select(*pixels.columns)


# --- neighbourhoods -----------------------------------------------------------------------


def tile_map(pixels: DataFrame, keys: Sequence[str], values: Sequence[str], halo: int,
             change: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], result: str, size: int = TILE,
             row: str = "px_row", column: str = "px_col") -> DataFrame:
    """Apply an array function to every tile with ``halo`` extra pixels on each side.

    ``change`` gets one float array per value column (NaN where there is no pixel) and returns arrays of the
    same shape; only pixels of the tile itself that exist in the table are returned. ``result`` is the DDL of
    the returned columns.
    """
    keys = list(keys)
    offsets = F.array(F.lit(-1), F.lit(0), F.lit(1))

    def position(c: str) -> Column:
        return F.pmod(F.col(c), F.lit(size))

    def needed(c: str, d: str) -> Column:
        return (F.col(d) == 0) | ((F.col(d) == -1) & (position(c) < halo)) | ((F.col(d) == 1) & (position(c) >= size - halo))

    # a pixel goes to its own tile and, near an edge, to the tile across it
    copied = (
        with_tile(pixels.select(*keys, row, column, *values), size, row, column)
        .withColumn("__dr", F.explode(offsets)).where(needed(row, "__dr"))
        .withColumn("__dc", F.explode(offsets)).where(needed(column, "__dc"))
        .withColumn("tile_row", F.col("tile_row") + F.col("__dr")).withColumn("tile_col", F.col("tile_col") + F.col("__dc"))
        .drop("__dr", "__dc")
    )
    types = dict(copied.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in (*keys, row, column)] + [result])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tile_row"].iloc[0]) * size - halo, int(pdf["tile_col"].iloc[0]) * size - halo
        r, c = pdf[row].to_numpy() - r0, pdf[column].to_numpy() - c0
        side = size + 2 * halo
        arrays = {}
        for name in values:
            array = np.full((side, side), np.nan)
            array[r, c] = pdf[name].to_numpy(dtype=float)
            arrays[name] = array
        changed = change(arrays)
        own = (r >= halo) & (r < size + halo) & (c >= halo) & (c < size + halo)
        out = pdf.loc[own, [*keys, row, column]].reset_index(drop=True)
        for name, array in changed.items():
            out[name] = array[r[own], c[own]]
        return out

    return copied.groupBy(*keys, "tile_row", "tile_col").applyInPandas(run, schema)


def _stack(array: np.ndarray, radius: int, circle: bool = False) -> np.ndarray:
    """The array moved to every place of a square, or of the circle in it."""
    padded = np.pad(array, radius, constant_values=np.nan)
    h, w = array.shape
    places = [(i, j) for i in range(2 * radius + 1) for j in range(2 * radius + 1) if not circle or (i - radius) ** 2 + (j - radius) ** 2 <= radius**2]
    return np.stack([padded[i : i + h, j : j + w] for i, j in places])


def focal_median(pixels: DataFrame, keys: Sequence[str] = (), value: str = "value", radius: int = 1, size: int = TILE) -> DataFrame:
    """Median of the square neighbourhood of each pixel (missing neighbours are left out)."""

    def change(arrays):
        with np.errstate(all="ignore"):
            import warnings

            with warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)
                return {value: np.nanmedian(_stack(arrays[value], radius), axis=0)}

    return tile_map(pixels, keys, [value], radius, change, f"{value} double", size)


def close_mask(pixels: DataFrame, keys: Sequence[str] = (), value: str = "flooded", radius: int = 1, size: int = TILE, circle: bool = True) -> DataFrame:
    """Morphological closing of a 0/1 mask over the pixels of the table: focal maximum, then focal minimum, in a circle or a square."""

    def change(arrays):
        import warnings

        a = arrays[value]
        known = ~np.isnan(a)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)
            grown = np.where(known, np.nanmax(_stack(a, radius, circle), axis=0), np.nan)
            closed = np.nanmin(_stack(grown, radius, circle), axis=0)
        return {value: np.nan_to_num(closed).astype("int32")}

    return tile_map(pixels, keys, [value], 2 * radius, change, f"{value} int", size)


# --- change detection ---------------------------------------------------------------------


def composite(images: DataFrame, events: DataFrame, baseline_days: int = 21, gap_days: int = 1, buffer_days: int = 3) -> DataFrame:
    """Median pixel before and during each event: (event_id, px_row, px_col, baseline, during).

    ``images`` has (image_date, px_row, px_col, value); windows are [start-21, start-1) and [start, end+3).
    Events and image dates are matched on the day first, so each pixel meets only its own events.
    """
    span = F.sequence(F.date_sub("event_start_date", baseline_days), F.date_add(F.coalesce("event_end_date", "event_start_date"), buffer_days - 1))
    days = events.select("event_id", "event_start_date", F.explode(span).alias("image_date")).where(
        (F.col("image_date") < F.date_sub("event_start_date", gap_days)) | (F.col("image_date") >= F.col("event_start_date"))
    )
    before = F.col("image_date") < F.col("event_start_date")
    return images.join(days, "image_date").groupBy("event_id", "px_row", "px_col").agg(
        F.median(F.when(before, F.col("value"))).alias("baseline"), F.median(F.when(~before, F.col("value"))).alias("during")
    )


def paired_events(composites: DataFrame) -> DataFrame:
    """Events with imagery on both sides."""
    return composites.groupBy("event_id").agg(
        F.bool_or(F.col("baseline").isNotNull()).alias("b"), F.bool_or(F.col("during").isNotNull()).alias("d")
    ).where(F.col("b") & F.col("d")).select("event_id")


def detect_water(composites: DataFrame, ratio: float = 0.5, absolute_db: float = -17.0, drop_db: float = 3.0, scale: str = "db") -> DataFrame:
    """Candidate water where any of three tests fires: ratio, absolute level, drop.

    ``scale="db"`` turns the difference into a power ratio first; ``"literal"`` divides the stored values with
    the baseline floored at 1e-6.
    """
    pre, post = F.col("baseline"), F.col("during")
    if scale == "db":
        quotient = F.pow(F.lit(10.0), (post - pre) / 10.0)
    elif scale == "literal":
        quotient = post / F.greatest(pre, F.lit(1e-6))
    else:
        raise ValueError(f"unknown scale: {scale}")
    tests = {"by_ratio": quotient < ratio, "by_level": post < absolute_db, "by_drop": pre - post > drop_db}
    marked = composites.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in tests.items()})
    return marked.withColumn("water", F.col("by_ratio") | F.col("by_level") | F.col("by_drop"))


def mask_pixels(pixels: DataFrame, water: DataFrame, hand: DataFrame, occurrence_min: float = 50.0, hand_max_m: float = 15.0) -> DataFrame:
    """Set ``flooded`` where water is neither permanent nor far above drainage.

    ``water`` holds (px_row, px_col, occurrence) and ``hand`` (px_row, px_col, hand_m).
    """
    joined = pixels.join(water, ["px_row", "px_col"], "left").join(hand, ["px_row", "px_col"], "left")
    permanent = F.coalesce(F.col("occurrence") >= occurrence_min, F.lit(False))
    low = F.coalesce(F.col("hand_m") <= hand_max_m, F.lit(False))
    return joined.withColumn("flooded", (F.col("water") & ~permanent & low).cast("int")).drop("occurrence", "hand_m")


def flood_frequency(pixels: DataFrame, keys: Sequence[str] = ("px_row", "px_col")) -> DataFrame:
    """Number of events that flooded each pixel outside permanent water; pixels never flooded are dropped."""
    wet = (F.col("flooded") == 1) & (F.coalesce(F.col("permanent_water"), F.lit(0)) != 1)
    # dealt out by pixel before any count is kept, so that no task that reads much holds a table of all its pixels
    return pixels.where(wet).select(*keys).repartition(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"))


# --- connected patches --------------------------------------------------------------------


def _local_labels(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Component label (smallest flat index) of every true pixel, by repeated minimum and pointer jumping."""
    n = mask.size
    label = np.where(mask.ravel(), np.arange(n), n)
    label = np.append(label, n)
    shape = mask.shape
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    index = np.arange(n).reshape(shape)
    pairs = []
    for dr, dc in steps:
        a = index[: shape[0] - dr, max(0, -dc) : shape[1] - max(0, dc)]
        b = index[dr:, max(0, dc) : shape[1] - max(0, -dc)]
        both = mask.ravel()[a] & mask.ravel()[b]
        pairs.append(np.column_stack([a[both], b[both]]))
    edges = np.vstack(pairs) if pairs else np.empty((0, 2), dtype=int)
    while True:
        low = np.minimum(label[edges[:, 0]], label[edges[:, 1]])
        before = label.copy()
        np.minimum.at(label, before[edges[:, 0]], low)
        np.minimum.at(label, before[edges[:, 1]], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return label[:n].reshape(shape)


def _components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest reachable node, by alternating large-star and small-star rounds.

    ``edges`` is (a, b) over strings or numbers. The number of rounds is logarithmic in practice, and each
    round is stored, so a lost executor never replays the whole history.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = materialize(both.where("a <> b").distinct())
    signature = None
    while True:
        # large star: larger neighbours point to the smallest of the neighbourhood
        pairs = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself point to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(least.select("a", F.col("m").alias("b"))).distinct()
        )
        current = materialize(small)
        row = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == signature:
            return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
        signature = (row["n"], row["h"])


def label_patches(pixels: DataFrame, keys: Sequence[str] = (), value: str = "flooded", connectivity: int = 4, min_px: int = 20, size: int = TILE) -> DataFrame:
    """Connected patches with more than ``min_px`` pixels: (keys, px_row, px_col, patch_id, patch_pixels).

    Patches are labelled inside tiles first; labels that touch across tile edges form a small graph whose
    components give the final labels. ``patch_id`` is the tile-ordered first pixel of the patch.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    keys = list(keys)
    diagonal = connectivity == 8
    wet = pixels.where(F.col(value) == 1)

    def change(arrays):
        return {"local": _local_labels(~np.isnan(arrays[value]), diagonal).astype("int64")}

    local = tile_map(wet, keys, [value], 0, change, "local long", size)
    named = materialize(
        with_tile(local, size).withColumn(
            "node", F.concat_ws(":", *keys, F.format_string("%012d:%012d:%010d", F.col("tile_row"), F.col("tile_col"), F.col("local")))
        )
    )
    last = size - 1
    edge = named.where(
        F.pmod("px_row", F.lit(size)).isin(0, last) | F.pmod("px_col", F.lit(size)).isin(0, last)
    ).select(*keys, "px_row", "px_col", "tile_row", "tile_col", "node")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    shifted = edge.withColumn("__d", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps]))).select(
        *keys, (F.col("px_row") + F.col("__d.r")).alias("px_row"), (F.col("px_col") + F.col("__d.c")).alias("px_col"), F.col("node").alias("a"),
        F.col("tile_row").alias("__tr"), F.col("tile_col").alias("__tc"),
    )
    across = (
        edge.join(shifted, [*keys, "px_row", "px_col"])
        .where((F.col("tile_row") != F.col("__tr")) | (F.col("tile_col") != F.col("__tc")))
        .select("a", F.col("node").alias("b")).distinct()
    )
    joined = _components(across)
    labelled = named.join(joined, "node", "left").withColumn("patch_id", F.coalesce("label", "node"))
    sizes = labelled.groupBy("patch_id").agg(F.count(F.lit(1)).alias("patch_pixels")).where(F.col("patch_pixels") > min_px)
    return labelled.join(sizes, "patch_id").select(*keys, "px_row", "px_col", "patch_id", "patch_pixels")


def tag_patches(patches: DataFrame, events: DataFrame, parameters: dict[str, object] | None = None) -> DataFrame:
    """Attach satellite event ids, reference ids, dates and detection parameters to patch rows."""
    known = events.select(
        "event_id", F.col("event_start_date"), F.coalesce("event_end_date", "event_start_date").alias("event_end_date"),
    )
    tagged = patches.join(known, "event_id").withColumns(
        {
            "reference_event_id": F.col("event_id"),
            "event_id": F.concat(F.lit("sar-"), F.col("event_id")),
            "event_year": F.year("event_start_date"),
        }
    )
    return tagged.withColumns({k: F.lit(v) for k, v in (parameters or {}).items()})

