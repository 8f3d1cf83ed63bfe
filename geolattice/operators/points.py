"""Queries over points: containment, nearest neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Geometry, as_geometry, covers, planar_distance
from ..functions.values import is_finite
from ..plans.prefixes import KNN_PRECISION, has_prefix, knn_cells, lossless, minimum_bounding_prefixes


def all_of(predicates: list[Column]) -> Column:
    """All of them; none at all lets every row pass."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def on_globe(lon: float, lat: float) -> None:
    if not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise ValueError(f"not on the globe: lon {lon}, lat {lat}")


def within(df: DataFrame, geometry: Geometry | str, *, lon_col: str = "lon", lat_col: str = "lat", rowkey_col: str | None = None) -> DataFrame:
    """The rows whose point the geometry covers (inside or on the boundary).

    The geometry's box is part of the predicate and reaches the scan. With ``rowkey_col`` the bounding prefixes are
    added, so that a table sorted by geohash is skipped by key as well; they are left out where they could lose a
    point on the outer edge of their block. Rows without a usable coordinate are out. Works on streams alike.
    """
    shape = as_geometry(geometry)
    predicates = [covers(shape, lon_col, lat_col)]
    if rowkey_col is not None:
        try:
            prefixes = minimum_bounding_prefixes(shape)
        except ValueError:
            prefixes = []
        if prefixes and lossless(shape, prefixes):
            predicates.insert(0, has_prefix(rowkey_col, prefixes))
    return df.where(all_of(predicates))


def within_counts(df: DataFrame, geometry: Geometry | str, *, lon_col: str = "lon", lat_col: str = "lat", rowkey_col: str = "rowkey") -> DataFrame:
    """One row: n_candidates under the bounding prefixes, n_within, n_excluded of them."""
    candidates = df.where(has_prefix(rowkey_col, minimum_bounding_prefixes(geometry)))
    inside = covers(geometry, lon_col, lat_col)
    n, hit = F.count(F.lit(1)), F.count_if(F.coalesce(inside, F.lit(False)))
    return candidates.agg(n.alias("n_candidates"), hit.alias("n_within"), (n - hit).alias("n_excluded"))


def matches(df: DataFrame, *, id_col: str = "id", rowkey_col: str = "rowkey", lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """The columns of a match: id (text), hash, lon, lat, and distance where there is one."""
    columns = [F.col(id_col).cast("string").alias("id"), F.col(rowkey_col).alias("hash"), F.col(lon_col).alias("lon"), F.col(lat_col).alias("lat")]
    return df.select(*columns, *(["distance"] if "distance" in df.columns else []))


def with_distance(df: DataFrame, lon: float, lat: float, *, lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """Add ``distance`` in degrees; rows without a usable coordinate are out (NaN would count as the largest)."""
    on_globe(lon, lat)
    return df.where(is_finite(lon_col) & is_finite(lat_col)).withColumn("distance", planar_distance(lon_col, lat_col, lon, lat))


def _at_least_one(k: int) -> int:
    if k < 1:
        raise ValueError("k must be 1 or more")
    return k


def _nearest_first(rowkey_col: str, id_col: str | None) -> list[str]:
    """Equal distances go by key, and rows of one key by id; without one, which of them come first is left open."""
    return ["distance", rowkey_col, *([] if id_col is None else [id_col])]


def knn_exact(df: DataFrame, lon: float, lat: float, k: int, *, lon_col: str = "lon", lat_col: str = "lat", rowkey_col: str = "rowkey", id_col: str | None = None) -> DataFrame:
    """The k nearest rows, nearest first; equal distances go by key, then id. Each task keeps k rows, then these are merged."""
    return with_distance(df, lon, lat, lon_col=lon_col, lat_col=lat_col).orderBy(*_nearest_first(rowkey_col, id_col)).limit(_at_least_one(k))


def knn_by_cells(
    df: DataFrame, lon: float, lat: float, k: int, *, precision: int = KNN_PRECISION, lon_col: str = "lon", lat_col: str = "lat", rowkey_col: str = "rowkey", id_col: str | None = None
) -> DataFrame:
    """The k nearest of the rows in the cell of the point and those around it: fewer than k where these hold fewer."""
    on_globe(lon, lat)
    return knn_exact(df.where(has_prefix(rowkey_col, knn_cells(lon, lat, precision))), lon, lat, k, lon_col=lon_col, lat_col=lat_col, rowkey_col=rowkey_col, id_col=id_col)


def knn_per_region(df: DataFrame, lon: float, lat: float, k: int, *, region: Column | None = None, lon_col: str = "lon", lat_col: str = "lat", rowkey_col: str = "rowkey") -> DataFrame:
    """The k nearest rows of every region (column ``region``), without a merge; regions default to partitions."""
    by = (F.spark_partition_id() if region is None else region).alias("region")
    near = with_distance(df, lon, lat, lon_col=lon_col, lat_col=lat_col).select("*", by)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("region").orderBy("distance", rowkey_col))).where(F.col("rank") <= _at_least_one(k))


def nearest_per_cell(
    df: DataFrame, lon: float, lat: float, k: int, *, precision: int = KNN_PRECISION, lon_col: str = "lon", lat_col: str = "lat", rowkey_col: str = "rowkey", id_col: str | None = None
) -> DataFrame:
    """The k nearest rows of each cell around the point, with their ``cell`` and ``rank``, before any merge."""
    inside = df.where(has_prefix(rowkey_col, knn_cells(lon, lat, precision)))
    near = with_distance(inside, lon, lat, lon_col=lon_col, lat_col=lat_col).withColumn("cell", F.substring(rowkey_col, 1, precision))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(*_nearest_first(rowkey_col, id_col)))).where(F.col("rank") <= _at_least_one(k))


def merge_nearest(parts: DataFrame, k: int, *, rowkey_col: str = "rowkey", id_col: str | None = None) -> DataFrame:
    """The k nearest rows of partial results that have a ``distance``."""
    return parts.orderBy(*_nearest_first(rowkey_col, id_col)).limit(_at_least_one(k))


def as_candidates(df: DataFrame, by: str | None = None, *columns: str) -> DataFrame:
    """Rows as one nested ``candidates`` array, for each value of ``by`` or over all; of bounded results only."""
    nested = F.array_sort(F.collect_list(F.struct(*columns))).alias("candidates")
    return df.groupBy(by).agg(nested) if by else df.agg(nested)
