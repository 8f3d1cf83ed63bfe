"""GeoJSON feature collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_FEATURE = "struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: array<double>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat and properties (map of texts) of every point feature. A file is one document, read by one task."""
    collections = spark.read.schema(f"type string, features array<{POINT_FEATURE}>").json(path, multiLine=True)
    features = collections.select(F.explode("features").alias("f")).where(F.col("f.geometry.type") == "Point")
    at = F.col("f.geometry.coordinates")
    return features.select(F.get(at, 0).alias("lon"), F.get(at, 1).alias("lat"), F.col("f.properties").alias("properties"))


def _feature(kind: str, coordinates: Column, properties: list[str]) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")), {"ignoreNullFields": "false"})


def point_features(df: DataFrame, properties: list[str], *, lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """One JSON text, ``feature``, for each row."""
    return df.select(_feature("Point", F.array(lon_col, lat_col), properties).alias("feature"))


def line_features(df: DataFrame, properties: list[str], coordinates: str) -> DataFrame:
    """``coordinates``: a column of arrays of [lon, lat]."""
    return df.select(_feature("LineString", F.col(coordinates), properties).alias("feature"))


def polygon_features(df: DataFrame, properties: list[str], ring: str) -> DataFrame:
    """``ring``: a column with one closed ring."""
    return df.select(_feature("Polygon", F.array(F.col(ring)), properties).alias("feature"))


def feature_collection(features: DataFrame) -> DataFrame:
    """One text, ``collection``, of a bounded number of features; large results are better written as lines."""
    joined = F.array_join(F.array_sort(F.collect_list("feature")), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("collection"))
