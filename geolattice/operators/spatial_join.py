"""Points joined with many geometries: an extension of the within query, by shared geohash cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geohash
from ..functions.geometry import Geometry, as_geometry, covers


def _cells(geometry: Geometry, chars: int) -> list[str]:
    """The cells of a precision that the geometry's box touches."""
    lon0, lat0, lon1, lat1 = geometry.envelope()
    w, h = (b - a for a, b in zip(geohash.box("0" * chars)[:2], geohash.box("0" * chars)[2:], strict=True))
    nx, ny = int((lon1 - lon0) // w) + 2, int((lat1 - lat0) // h) + 2
    clip = lambda v, low: max(low, min(-low, v))
    return sorted({geohash.encode(clip(min(lat1, lat0 + j * h), -90.0), clip(min(lon1, lon0 + i * w), -180.0), chars) for i in range(nx) for j in range(ny)})


def points_in_geometries(points: DataFrame, geometries: dict[str, Geometry | str], *, lon_col: str = "lon", lat_col: str = "lat", rowkey_col: str = "rowkey", precision: int = 6) -> DataFrame:
    """Every (point, geometry_id) where the geometry covers the point.

    Geometries are constants of the query. Cells that they touch are joined with the cells of the points on equality;
    then the exact predicate of the row's geometry decides.
    """
    shapes = {name: as_geometry(g) for name, g in geometries.items()}
    spark = points.sparkSession
    rows = [(name, cell) for name, shape in shapes.items() for cell in _cells(shape, precision)]
    cells = spark.createDataFrame(rows, "geometry_id string, cell string")
    met = points.withColumn("cell", F.substring(rowkey_col, 1, precision)).join(cells, "cell").drop("cell")
    exact = reduce(lambda out, item: out.when(F.col("geometry_id") == item[0], covers(item[1], lon_col, lat_col)), shapes.items(), F.when(F.lit(False), F.lit(False)))
    return met.where(exact)
