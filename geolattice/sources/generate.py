"""Made-up points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geohash import geohash

#: Text columns of a made-up row, each of ten random letters.
LETTER_COLUMNS = ("name", "address", "city", "url", "phone", "type", "zip")


def check_limits(lon_min: float, lon_max: float, lat_min: float, lat_max: float) -> None:
    if not (lon_min < lon_max and lat_min < lat_max):
        raise ValueError("the lower limit must be under the upper one")


def made_row(lon: Column, lat: Column, id_: Column, seed: int) -> list[Column]:
    """The ten cells of a row."""
    letters = [F.translate(F.randstr(F.lit(10), F.lit(seed + 2 + k)), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijabcdefghijklmnopqrstuvwxyz").alias(c) for k, c in enumerate(LETTER_COLUMNS)]
    return [id_.cast("string").alias("id"), lon.alias("lon"), lat.alias("lat"), *letters]


def bulk_points(spark: SparkSession, count: int, limits: tuple[float, float, float, float], *, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``count`` points, uniform in [lon_min, lon_max) x [lat_min, lat_max), with ids from 0 and geohash keys."""
    if count < 0:
        raise ValueError("count must be 0 or more")
    if len(limits) != 4:
        raise ValueError("limits are lon_min, lon_max, lat_min, lat_max")
    check_limits(*limits)
    lon_min, lon_max, lat_min, lat_max = limits
    rows = spark.range(0, count, 1, partitions) if partitions else spark.range(count)
    made = rows.select(*made_row(F.lit(lon_min) + F.rand(seed) * (lon_max - lon_min), F.lit(lat_min) + F.rand(seed + 1) * (lat_max - lat_min), F.col("id"), seed))
    return made.withColumn("rowkey", geohash("lat", "lon"))


def line_points(spark: SparkSession, count: int = 10) -> DataFrame:
    """Points on a line: lon = lat = 1, 2, ... with a binary big-endian key."""
    return spark.range(1, count + 1).select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("rowkey"), F.col("id").cast("double").alias("lon"), F.col("id").cast("double").alias("lat"))
