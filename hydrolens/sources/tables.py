"""Keyed tables on plain files: upsert, replace, append, exports, pixel tables and artifacts.

Tables are Parquet folders. An upsert publishes a new version (``VersionedTable``) with the touched partitions rewritten.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.sources.versions import VersionedTable


def read_pixels(spark: SparkSession, path: str, nodata: float, value: str = "value") -> DataFrame:
    """IO6: a pixel table without nodata; the filter is pushed to the scan."""
    from hydrolens.operators.raster import drop_nodata

    return drop_nodata(spark.read.parquet(path), nodata, value)


def upsert(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """IO8: last write wins per key; keys repeated inside one batch are refused. Read the table with ``read_table``.

    With ``partition_by`` (which must be part of the key or fixed by it) only touched partitions are read and rewritten.
    """
    VersionedTable(spark, path, partition_by).upsert(updates, keys)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table that ``upsert`` wrote."""
    return VersionedTable(spark, path).read()


def replace_partition(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """IO9: replace exactly the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_run(run: DataFrame, predictions: DataFrame, path: str) -> None:
    """IO10: append an immutable run row and its predictions."""
    run.write.mode("append").parquet(f"{path}/runs")
    predictions.write.mode("append").partitionBy("run_version").parquet(f"{path}/predictions")


def export_dataset(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """IO11: ordered columns as CSV with a header, one file per task."""
    df.select(*[c for c in columns if c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def export_catalog(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """IO12: catalog as CSV and JSON, dates as ISO text and decimals as doubles."""
    safe = df.select(
        *[
            F.col(f.name).cast("string" if t == "date" else "double" if t.startswith("decimal") else t).alias(f.name)
            for f in df.schema.fields
            for t in [f.dataType.simpleString()]
            if columns is None or f.name in columns
        ]
    )
    if columns is not None:
        safe = safe.select(*[c for c in columns if c in safe.columns])
    safe.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    safe.write.mode("overwrite").json(f"{path}/json")


def read_event_dataset(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """IO13: a training CSV with typed columns; missing columns are an error before anything runs."""
    header = spark.read.option("header", True).csv(path).columns
    needed = [*features, "target_label", "temporal_split", "event_id"]
    missing = [c for c in needed if c not in header]
    if missing:
        raise ValueError(f"training file lacks columns: {', '.join(missing)}")
    types = {**{f: "double" for f in features}, "target_label": "int", "surface_water_influence_pct": "double"}
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    return spark.read.schema(schema).option("header", True).csv(path)


# --- model artifacts ----------------------------------------------------------------------


def save_artifact(spark: SparkSession, artifact: dict, path: str) -> None:
    """IO14: one JSON row (names, mean, scale, coefficients, intercept, profiles)."""
    spark.createDataFrame([(json.dumps(artifact),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_artifact(spark: SparkSession, path: str, version: str | None = None) -> dict:
    """IO14: accepts ``weights`` or ``coefficients``; a wrong version or missing part is an error."""
    rows = spark.read.text(path).limit(2).collect()  # an artifact is one row
    if len(rows) != 1:
        raise ValueError(f"{path} must hold one artifact")
    artifact = json.loads(rows[0]["value"])
    if version is not None and artifact.get("model_version") != version:
        raise ValueError(f"expected model_version {version!r}, found {artifact.get('model_version')!r}")
    coefficients = artifact.get("weights") or artifact.get("coefficients")
    if not coefficients:
        raise KeyError("artifact is missing weights or coefficients")
    artifact["coefficients"] = coefficients
    return artifact


# --- layer catalog ------------------------------------------------------------------------

LAYER_SCHEMA = (
    "layer_key string, name string, category string, data_kind string, provider string, source_url string, license_name string,"
    " spatial_resolution_m double, temporal_coverage_start timestamp, temporal_coverage_end timestamp, quality_status string, is_active boolean"
)


def register_layers(spark: SparkSession, layers: DataFrame, boundary: DataFrame, path: str) -> None:
    """IO15: register catalog rows under their key, each with the boundary as coverage. A boundary of several rows is an error."""
    several = F.raise_error(F.lit("the boundary must be one row"))
    one = boundary.agg(F.when(F.count(F.lit(1)) == 1, F.first("geometry")).otherwise(several.cast(boundary.schema["geometry"].dataType)).alias("coverage"))
    upsert(spark, path, layers.crossJoin(F.broadcast(one)), ["layer_key"])
