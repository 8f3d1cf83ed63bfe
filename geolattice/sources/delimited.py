"""Delimited text: read without quoting, trimmed, bound by position, keyed by geohash, and written in key order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geohash import geohash
from ..functions.values import composite_key, is_finite, lenient_double, strict_double
from ..operators.keys import collapse

#: Column order of the point files, and of the trip files.
POINT_COLUMNS = ("lon", "lat", "id", "name", "address", "city", "url", "phone", "type", "zip")
TRIP_COLUMNS = (
    "vendor_id", "pu_ts", "do_ts", "p_count", "trip", "ratecode_id", "flag", "pu_id", "do_id", "payment_type", "fare_amount", "extra", "mta_tax", "tip_amount", "tolls_amount",
    "imp_surcharge", "total_amount", "cong_surcharge",
)


def read_delimited(spark: SparkSession, path: str, columns: tuple[str, ...] = POINT_COLUMNS, *, separator: str = "\t", header: bool = True) -> DataFrame:
    """Text columns by position, and ``seq``, which orders the lines of a file and the files by name.

    The first line of every file is left out if it is a header, empty lines always. Fields are trimmed, empty ones
    stay, missing ones at the end are null, and the last column keeps further separators. Quotes have no meaning.
    """
    # Lines come whole: the reader gets a separator that no text holds, and no quotes. It drops headers file by file.
    reader = spark.read.schema("line string").option("header", header).option("sep", "\x01").option("quote", "").option("escape", "").option("comment", "")
    lines = reader.option("maxCharsPerColumn", -1).csv(path)
    # A line's place: its file, the block of the file that a task reads, and its number in that block.
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    fields = F.transform(F.split("line", re.escape(separator), len(columns)), lambda f: F.regexp_replace(f, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return lines.select(fields.alias("fields"), seq.alias("seq")).select(*(F.get("fields", i).alias(c) for i, c in enumerate(columns)), "seq")


def with_coordinates(df: DataFrame, *, lon_col: str = "lon", lat_col: str = "lat", strict: bool = True) -> DataFrame:
    """Coordinates as doubles. Strict: a missing or bad one fails the load. Lenient: its row is out."""
    if strict:
        return df.withColumn(lon_col, strict_double(lon_col)).withColumn(lat_col, strict_double(lat_col))
    parsed = df.withColumn(lon_col, lenient_double(lon_col)).withColumn(lat_col, lenient_double(lat_col))
    return parsed.where(is_finite(lon_col) & is_finite(lat_col))


def with_rowkey(df: DataFrame, *, lon_col: str = "lon", lat_col: str = "lat", rowkey_col: str = "rowkey") -> DataFrame:
    return df.withColumn(rowkey_col, geohash(lat_col, lon_col))


def read_points(spark: SparkSession, path: str, *, on_duplicate: str = "last", strict: bool = True) -> DataFrame:
    """Point files, keyed by geohash, one row for each key: the last line written, the first, or a merge of cells.

    With ``keep`` every line stays a row, also where lines share a key.
    """
    rows = with_rowkey(with_coordinates(read_delimited(spark, path), strict=strict))
    if on_duplicate == "keep":
        return rows.drop("seq")
    return collapse(rows, "rowkey", "seq", on_duplicate).drop("seq")


def read_trips(spark: SparkSession, path: str, *, on_duplicate: str = "first") -> DataFrame:
    """Trip files (comma separated), keyed by their two times as written."""
    rows = read_delimited(spark, path, TRIP_COLUMNS, separator=",").withColumn("rowkey", composite_key("pu_ts", "do_ts"))
    return collapse(rows, "rowkey", "seq", on_duplicate).drop("seq")
