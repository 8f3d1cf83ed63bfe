"""Plans by geohash prefix: which cells a query has to read, and the predicate that a sorted table can skip by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geohash
from ..functions.geometry import Geometry, as_geometry

#: Precision of the cells of an approximate nearest-neighbour query, and the finest tried for a geometry.
KNN_PRECISION = FINEST = 7


def block(cell: str) -> list[str]:
    """The cells around one, and that one last."""
    return [*geohash.neighbours(cell), cell]


def block_box(cell: str) -> tuple[float, float, float, float]:
    """The box of a cell and those around it; longitudes are not wrapped, latitudes end at the poles."""
    lon0, lat0, lon1, lat1 = geohash.box(cell)
    w, h = lon1 - lon0, lat1 - lat0
    return lon0 - w, max(-90.0, lat0 - h), lon1 + w, min(90.0, lat1 + h)


def _inside(inner: tuple, outer: tuple) -> bool:
    return outer[0] <= inner[0] and outer[1] <= inner[1] and inner[2] <= outer[2] and inner[3] <= outer[3]


def minimum_bounding_prefixes(geometry: Geometry | str) -> list[str]:
    """One cell, or a cell with those around it: the finest whose box holds the whole geometry.

    The cell is that of the geometry's centroid, at precision 7, 6, ... 1.
    """
    shape = as_geometry(geometry)
    envelope = shape.envelope()
    lon, lat = shape.centroid()
    for chars in range(FINEST, 0, -1):
        cell = geohash.encode(lat, lon, chars)
        if _inside(envelope, geohash.box(cell)):
            return [cell]
        if _inside(envelope, block_box(cell)):
            return block(cell)
    raise ValueError("no block of cells holds this geometry")


def lossless(geometry: Geometry | str, prefixes: list[str]) -> bool:
    """Whether every point that the geometry covers has one of the prefixes.

    Containment is closed, but cells are open at their upper edges, and blocks do not go round the globe.
    """
    lon0, lat0, lon1, lat1 = block_box(prefixes[-1]) if len(prefixes) > 1 else geohash.box(prefixes[0])
    g = as_geometry(geometry).envelope()
    # At the pole the last row of cells is closed, at longitude 180 the last column.
    return lon0 <= g[0] and lat0 <= g[1] and -180 <= g[0] and (g[2] < lon1 or lon1 == g[2] == 180) and (g[3] < lat1 or lat1 == g[3] == 90) and g[2] <= 180


def knn_cells(lon: float, lat: float, precision: int = KNN_PRECISION) -> list[str]:
    """The cell of a point and those around it."""
    return block(geohash.encode(lat, lon, precision))


def has_prefix(key: Column | str, prefixes: list[str]) -> Column:
    """Whether a key begins with one of them; each once, so that no row comes twice. Reaches the scan."""
    key = F.col(key) if isinstance(key, str) else key
    if not prefixes:
        return F.lit(False)
    return reduce(lambda a, b: a | b, (key.startswith(p) for p in dict.fromkeys(prefixes)))
