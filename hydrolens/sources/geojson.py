"""GeoJSON sources: feature collections, boundaries and asset-shaped features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolens.functions import constants as K
from hydrolens.functions import geo
from hydrolens.functions import scalars as S
from hydrolens.sources.collections import feature_texts

_SHAPE = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
_FEATURE = f"struct<geometry:{_SHAPE},properties:map<string,string>>"
# coordinates stay JSON text until the geometry type is known
DOCUMENT = (
    f"type string, features array<{_FEATURE}>, geometry {_SHAPE}, properties map<string,string>, coordinates string,"
    " geometries array<struct<type:string,coordinates:string>>"
)


def _fail(condition, message: str, value):
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def _exploded(df: DataFrame, shape: str) -> DataFrame:
    """One row per geometry; the members of a geometry collection become rows of their own."""
    g = F.col(shape)
    members = F.when(g["type"] == "GeometryCollection", g["geometries"]).otherwise(
        F.array(F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates")))
    )
    others = [c for c in df.columns if c != shape]
    rows = df.select(*others, F.explode_outer(F.when(g.isNotNull(), members)).alias("__g"))
    return rows.select(geo.from_geojson("__g.type", "__g.coordinates").alias("geometry"), *others)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """IO1: (geometry, properties) of every feature. Other documents and empty collections are an error.

    A large collection is cut into features by many tasks, see ``feature_texts``; many files are read side by side.
    """
    f = F.from_json("value", _FEATURE, {"mode": "FAILFAST"})
    rows = feature_texts(spark, path).select(f.alias("f"))
    rows = rows.select("f.geometry", F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"))
    return _exploded(rows, "geometry").select("geometry", "properties")


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """IO1 for newline-delimited features: splittable, so a large file is read by many tasks."""
    rows = spark.read.schema(DOCUMENT).json(path).where(F.col("type") == "Feature").select("geometry", "properties")
    return _exploded(rows, "geometry").select("geometry", "properties")


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """IO2: the single boundary of a collection with one feature, a feature or a bare geometry."""
    d = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    collection = F.col("type") == "FeatureCollection"
    one = _fail(
        collection & F.coalesce(F.size("features") != 1, F.lit(True)),
        "boundary collection must contain one feature",
        F.get("features", F.lit(0)),
    )
    bare = F.struct(F.col("type"), F.col("coordinates"), F.col("geometries"))
    shape = F.when(collection, one["geometry"]).when(F.col("type") == "Feature", F.col("geometry")).otherwise(bare)
    properties = F.when(collection, one["properties"]).otherwise(F.col("properties"))
    chosen = d.select(shape.alias("geometry"), F.coalesce(properties, F.create_map().cast("map<string,string>")).alias("properties"))
    return _exploded(chosen, "geometry").where(F.col("geometry.type").isin("Polygon", "MultiPolygon"))


def boundary_feature(boundary: DataFrame, name: str, code: str, prefix: str = "boundary") -> DataFrame:
    """The boundary as an asset row; property values win over the given defaults."""

    def prop(key: str, default: str):
        return F.coalesce(F.try_element_at("properties", F.lit(key)), F.lit(default))

    pcode = prop("pcode", code)
    return boundary.select(
        prop("township", name).alias("name"),
        F.lit("township_boundary").alias("asset_type"),
        F.concat(F.lit(f"{prefix}:"), pcode).alias("source_key"),
        F.lit("Project area boundary.").alias("description"),
        "geometry",
        S.json_merge("properties", F.create_map(F.lit("pcode"), pcode)).alias("properties"),
    )


def extents_to_assets(extents: DataFrame) -> DataFrame:
    """IO16: flood extents in asset shape, with their attributes merged into the property map."""
    fields = ("observed_date", "sensor", "classification", "confidence", "field_validated", "source_name", "source_url", "license_name", "area_km2")
    present = [f for f in fields if f in extents.columns]
    patch = F.create_map(
        *[item for f in present for item in (F.lit(f), F.col(f).cast("string"))], F.lit("training_label"), F.lit("true")
    )
    base = F.col("properties") if "properties" in extents.columns else F.create_map().cast("map<string,string>")
    description = F.col("notes") if "notes" in extents.columns else F.lit(None).cast("string")
    return extents.select(
        F.col("event_name").alias("name"),
        F.lit("historical_flood_extent").alias("asset_type"),
        "source_key",
        description.alias("description"),
        *(["geometry"] if "geometry" in extents.columns else []),
        S.json_merge(base, F.map_filter(patch, lambda _, v: v.isNotNull())).alias("properties"),
    )


SUPPORTED = K.GEOMETRY_TYPES
