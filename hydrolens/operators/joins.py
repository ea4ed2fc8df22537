"""Join shapes that the products share. The spatial joins are in ``operators.spatial``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolens.functions import scalars as S
from hydrolens.operators.relational import latest_per_key  # noqa: F401  (shared join shape)


def join_event_rain(events: DataFrame, rain: DataFrame, how: str = "inner", start: str = "event_start_date") -> DataFrame:
    """Events with the rainfall of their start date. Both sides are small by nature: let Spark decide."""
    return events.join(rain, events[start] == rain["observed_date"], how).drop(rain["observed_date"])


def event_cell_product(events: DataFrame, cells: DataFrame) -> DataFrame:
    """Every event with every cell: the dense dataset is the result itself.

    Events reach the cells through an equi-join on a constant-free key: each event is copied to every cell
    slice, so the product is spread over slices whichever side is large, and nothing is broadcast blindly.
    """
    slices = max(1, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    sliced = cells.withColumn("__slice", F.pmod(F.xxhash64(*cells.columns[:1]), F.lit(slices)).cast("int"))
    copied = events.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return copied.join(sliced, "__slice").drop("__slice")


def with_default_zero(cells: DataFrame, facts: DataFrame, columns: Sequence[str], key: str | Sequence[str] = "cell_id") -> DataFrame:
    joined = cells.join(facts, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})


def semi_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def attach_by_id(cells: DataFrame, products: dict[str, DataFrame], key: str = "cell_id") -> DataFrame:
    """Left-join each product as one struct column named after it."""
    result = cells
    for name, frame in products.items():
        packed = frame.select(key, F.struct(*[c for c in frame.columns if c != key]).alias(name))
        result = result.join(packed, key, "left")
    return result


def pair_labels(gfd: DataFrame, sar: DataFrame, mapping: DataFrame, key: str = "cell_id") -> DataFrame:
    """Rows of both sensors for the same event and cell, through (reference_event_id, sar_event_id)."""
    left = gfd.select(
        F.col("event_id").alias("reference_event_id"), key, *[F.col(c).alias(f"gfd_{c}") for c in gfd.columns if c not in ("event_id", key)]
    )
    right = sar.select(
        F.col("event_id").alias("sar_event_id"), key, *[F.col(c).alias(f"sar_{c}") for c in sar.columns if c not in ("event_id", key)]
    )
    return left.join(mapping, "reference_event_id").join(right, ["sar_event_id", key])


def has_sar(events: DataFrame, extents: DataFrame, prefix: str) -> DataFrame:
    """Add ``sar_detected``: a satellite extent exists under the event id or its ``sar-`` form."""
    # seen under either id form; distinct ids make the left join row-preserving
    seen = extents.where(F.col("source_key").startswith(f"{prefix}:sar:event:")).select(
        S.strip_prefix("event_id", "sar-").alias("__bare"), F.col("event_id").alias("__raw")
    )
    direct = seen.select(F.col("__raw").alias("event_id"))
    bare = seen.select(F.col("__bare").alias("event_id"))
    ids = direct.union(bare).distinct().withColumn("__seen", F.lit(True))
    return events.join(ids, "event_id", "left").withColumn("sar_detected", F.coalesce("__seen", F.lit(False))).drop("__seen")


def merge_properties(cells: DataFrame, summaries: DataFrame, key: str = "cell_id", properties: str = "properties") -> DataFrame:
    """Write summary columns back into each cell's property map; cells without a summary stay as they are."""
    added = [c for c in summaries.columns if c != key]
    patch = F.create_map(*[item for c in added for item in (F.lit(c), F.col(c).cast("string"))])
    packed = summaries.select(key, F.map_filter(patch, lambda _, v: v.isNotNull()).alias("__patch"))
    joined = cells.join(packed, key, "left")
    return joined.withColumn(properties, S.json_merge(properties, "__patch")).drop("__patch")


def enrich_stations(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Readings with their station (works on a stream); readings of unknown stations drop out."""
    return readings.join(stations, "station_id")


def unknown_stations(readings: DataFrame, stations: DataFrame) -> DataFrame:
    return readings.join(stations.select("station_id"), "station_id", "left_anti")


def new_only(batch: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return batch.join(table.select(key), key, "left_anti")


def with_total(df: DataFrame, keys: Sequence[str], column: str, name: str = "total") -> DataFrame:
    """Attach the total of each key through a pre-aggregated join, so that a hot key is never one task."""
    totals = df.groupBy(*keys).agg(F.sum(column).alias(name))
    return df.join(totals, list(keys))


def explode_grid(df: DataFrame, columns, rows) -> DataFrame:
    """One row per (i, j) of two index ranges given as (first, last) columns."""
    return df.withColumn("i", F.explode(F.sequence(*columns))).withColumn("j", F.explode(F.sequence(*rows)))
