"""The queries on streams of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import Geometry
from ..operators.points import within


def stream_within(spark: SparkSession, path: str, schema: str, geometry: Geometry | str, *, files_per_trigger: int = 64, **columns: str) -> DataFrame:
    """A stream of the points that arrive as Parquet files in ``path`` and that the geometry covers. Keeps no state."""
    return within(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path), geometry, **columns)


def windowed_counts(points: DataFrame, time_col: str, *, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Points in each time window; state of a window goes once the watermark has passed it."""
    return points.withWatermark(time_col, late).groupBy(F.window(time_col, window)).agg(F.count(F.lit(1)).alias("n"))
