"""Geometries of queries: WKT read and written on the driver, predicates compiled into Catalyst expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]
#: Edges from which on a polygon is a literal array that is folded, rather than one term for each edge.
UNROLLED = 96
EARTH_RADIUS_M = 6378137.0
MERCATOR_LIMIT = 85.0511287798


@dataclass(frozen=True)
class Geometry:
    """``kind`` as in WKT; coordinates: a point, a list of points, rings (shell first), or member geometries."""

    kind: str
    points: tuple[Point, ...] = ()
    rings: tuple[tuple[Point, ...], ...] = ()
    members: tuple[Geometry, ...] = ()

    @property
    def is_empty(self) -> bool:
        return not (self.points or self.rings or any(not m.is_empty for m in self.members))

    def vertices(self) -> list[Point]:
        return [*self.points, *(p for r in self.rings for p in r), *(p for m in self.members for p in m.vertices())]

    def envelope(self) -> tuple[float, float, float, float]:
        """(lon0, lat0, lon1, lat1)."""
        if self.is_empty:
            raise ValueError("empty geometry")
        xs, ys = zip(*self.vertices(), strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def parts(self) -> list[Geometry]:
        return [p for m in self.members for p in m.parts()] if self.members else [] if self.is_empty else [self]

    def centroid(self) -> Point:
        """Of the parts of the highest dimension: by area, by length, or the mean of points."""
        if self.is_empty:
            raise ValueError("empty geometry")
        parts = self.parts()
        weights = [w for p in parts if p.kind == "POLYGON" for w in _areas(p)]
        if not weights or not sum(w for w, _, _ in weights):
            weights = [w for p in parts for line in ([p.points] if p.kind == "LINESTRING" else p.rings) for w in _lengths(line)]
        if not weights or not sum(w for w, _, _ in weights):
            weights = [(1.0, x, y) for p in parts for x, y in p.vertices()]
        total = sum(w for w, _, _ in weights)
        return sum(w * x for w, x, _ in weights) / total, sum(w * y for w, _, y in weights) / total

    def to_wkt(self) -> str:
        if self.is_empty:
            return f"{self.kind} EMPTY"
        line = lambda points: "(" + ", ".join(f"{_text(x)} {_text(y)}" for x, y in points) + ")"
        body = {
            "POINT": lambda g: line(g.points),
            "LINESTRING": lambda g: line(g.points),
            "POLYGON": lambda g: "(" + ", ".join(map(line, g.rings)) + ")",
        }
        if self.kind in body:
            return f"{self.kind} {body[self.kind](self)}"
        inner = [m.to_wkt() if self.kind == "GEOMETRYCOLLECTION" else "EMPTY" if m.is_empty else body[m.kind](m) for m in self.members]
        return f"{self.kind} ({', '.join(inner)})"


def _text(x: float) -> str:
    return repr(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def _areas(polygon: Geometry) -> list[tuple[float, float, float]]:
    """(signed weight, x, y) by triangle against the first vertex: shells add, holes take away."""
    ox, oy = polygon.rings[0][0]
    out = []
    for k, ring in enumerate(polygon.rings):
        own = []
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            own.append(((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy), (ox + x1 + x2) / 3, (oy + y1 + y2) / 3))
        sign = math.copysign(1, sum(w for w, _, _ in own)) * (1 if k == 0 else -1)
        out += [(sign * w, x, y) for w, x, y in own]
    return out


def _lengths(line: tuple[Point, ...]) -> list[tuple[float, float, float]]:
    return [(math.hypot(x2 - x1, y2 - y1), (x1 + x2) / 2, (y1 + y2) / 2) for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False)]


class _Reader:
    SINGLE = {"MULTIPOINT": "POINT", "MULTILINESTRING": "LINESTRING", "MULTIPOLYGON": "POLYGON"}

    def __init__(self, text: str):
        self.tokens = re.findall(r"[A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),]|\S", text)
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise ValueError(f"bad WKT: {wanted or 'more'} expected, {token or 'the end'} found")
        self.at += 1
        return token

    def listed(self, one) -> list:
        self.take("(")
        out = [one()]
        while self.peek() == ",":
            self.take()
            out.append(one())
        self.take(")")
        return out

    def point(self) -> Point:
        try:
            x, y = float(self.take()), float(self.take())
            while self.peek() not in (",", ")", ""):  # further dimensions are read over
                float(self.take())
        except ValueError as e:
            raise ValueError(f"bad WKT: {e}") from e
        return x, y

    def body(self, kind: str) -> Geometry:
        if self.peek().upper() in ("Z", "M", "ZM"):
            self.take()
        if self.peek().upper() == "EMPTY":
            self.take()
            return Geometry(kind)
        if kind == "POINT":
            points = self.listed(self.point)
            if len(points) != 1:
                raise ValueError("bad WKT: a point has one position")
            return Geometry(kind, points=tuple(points))
        if kind == "LINESTRING":
            points = self.listed(self.point)
            if len(points) < 2:
                raise ValueError("bad WKT: a line has two positions at least")
            return Geometry(kind, points=tuple(points))
        if kind == "POLYGON":
            rings = [tuple(r) for r in self.listed(lambda: self.listed(self.point))]
            if any(len(r) < 4 or r[0] != r[-1] for r in rings):
                raise ValueError("bad WKT: a ring is closed and has four positions at least")
            return Geometry(kind, rings=tuple(rings))
        if kind == "MULTIPOINT":
            member = lambda: self.body("POINT") if self.peek() in ("(", "EMPTY") else Geometry("POINT", points=(self.point(),))
            return Geometry(kind, members=tuple(self.listed(member)))
        if kind in self.SINGLE:
            return Geometry(kind, members=tuple(self.listed(lambda: self.body(self.SINGLE[kind]))))
        if kind == "GEOMETRYCOLLECTION":
            return Geometry(kind, members=tuple(self.listed(lambda: self.body(self.take().upper()))))
        raise ValueError(f"bad WKT: no geometry is called {kind}")


def from_wkt(text: str) -> Geometry:
    reader = _Reader(text)
    out = reader.body(reader.take().upper())
    if reader.peek():
        raise ValueError(f"bad WKT: {reader.peek()} after the end")
    return out


def as_geometry(geometry: Geometry | str) -> Geometry:
    return from_wkt(geometry) if isinstance(geometry, str) else geometry


# -- predicates ------------------------------------------------------------------------------------------------------


def _edges(points: tuple[Point, ...]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(points, points[1:], strict=False)]


def _on_segment(x: Column, y: Column, edge: tuple[float, float, float, float]) -> Column:
    x1, y1, x2, y2 = edge
    inside = x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2))
    if x1 == x2 or y1 == y2:  # along an axis the box is the segment
        return inside
    return inside & (F.lit(x2 - x1) * (y - F.lit(y1)) == F.lit(y2 - y1) * (x - F.lit(x1)))


def _crosses(x: Column, y: Column, edge: tuple[float, float, float, float]) -> Column:
    """Whether a ray to the east meets the edge, which has its lower end and not its upper one."""
    x1, y1, x2, y2 = edge
    low, high = min(y1, y2), max(y1, y2)
    return (y >= low) & (y < high) & (x < F.lit(x2 - x1) * (y - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1))


def _any(terms: list[Column]) -> Column:
    while len(terms) > 1:  # a balanced tree: deep chains cost the optimiser dearly
        terms = [reduce(lambda a, b: a | b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def _folded(edges: list, x: Column, y: Column) -> Column:
    """Boundary or odd crossings, over a literal array of edges: the size of the code does not grow with it."""
    literal = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e, strict=True))) for e in edges))
    on = F.exists(literal, lambda e: (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"])) & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"])) & ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])))
    met = lambda e: (y >= F.least(e["y1"], e["y2"])) & (y < F.greatest(e["y1"], e["y2"])) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y1"] != e["y2"], e["y2"] - e["y1"]) + e["x1"])
    return on | (F.size(F.filter(literal, met)) % 2 == 1)


def covers(geometry: Geometry | str, lon: Column | str, lat: Column | str) -> Column:
    """Whether the geometry covers the point: its inside or its boundary, rings of holes included.

    Null or NaN coordinates are not covered. The box around the geometry comes first, as plain comparisons that reach
    the scan.
    """
    shape = as_geometry(geometry)
    x, y = (F.col(c) if isinstance(c, str) else c for c in (lon, lat))
    return envelope_predicate(shape, x, y) & F.coalesce(_covers(shape, x, y), F.lit(False))


def envelope_predicate(geometry: Geometry | str, lon: Column | str, lat: Column | str) -> Column:
    lon0, lat0, lon1, lat1 = as_geometry(geometry).envelope()
    x, y = (F.col(c) if isinstance(c, str) else c for c in (lon, lat))
    return x.between(lon0, lon1) & y.between(lat0, lat1)


def _covers(shape: Geometry, x: Column, y: Column) -> Column:
    terms = []
    for part in shape.parts():
        if part.kind == "POINT":
            terms.append((x == part.points[0][0]) & (y == part.points[0][1]))
        elif part.kind == "LINESTRING":
            terms.append(_any([_on_segment(x, y, e) for e in _edges(part.points)]))
        else:
            edges = [e for ring in part.rings for e in _edges(ring)]
            if len(edges) > UNROLLED:
                terms.append(_folded(edges, x, y))
            else:
                sloped = [_crosses(x, y, e).cast("int") for e in edges if e[1] != e[3]]
                odd = (reduce(lambda a, b: a + b, sloped) % 2 == 1) if sloped else F.lit(False)
                terms.append(_any([_on_segment(x, y, e) for e in edges]) | odd)
    return _any(terms)


# -- measures and shapes ---------------------------------------------------------------------------------------------


def planar_distance(lon: Column | str, lat: Column | str, at_lon, at_lat) -> Column:
    """Distance in degrees on the plane, not on the sphere."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (lon, lat))
    dx, dy = x - (at_lon if isinstance(at_lon, Column) else F.lit(float(at_lon))), y - (at_lat if isinstance(at_lat, Column) else F.lit(float(at_lat)))
    return F.sqrt(dx * dx + dy * dy)


def great_circle_distance(lon: Column, lat: Column, at_lon: Column, at_lat: Column) -> Column:
    """Metres along the sphere (haversine)."""
    a = F.pow(F.sin(F.radians(at_lat - lat) / 2), 2) + F.pow(F.sin(F.radians(at_lon - lon) / 2), 2) * F.cos(F.radians(lat)) * F.cos(F.radians(at_lat))
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def spherical_mercator(lon: Column, lat: Column) -> Column:
    """struct<x, y> in radians of the projection; latitudes beyond its limit are taken as the limit."""
    held = F.greatest(F.least(lat, F.lit(MERCATOR_LIMIT)), F.lit(-MERCATOR_LIMIT))
    return F.struct(F.radians(lon).alias("x"), F.log(F.tan(F.lit(math.pi / 4) + F.radians(held) / 2)).alias("y"))


def from_spherical_mercator(x: Column, y: Column) -> Column:
    """struct<lon, lat>."""
    return F.struct(F.degrees(x).alias("lon"), F.degrees(2 * F.atan(F.exp(y)) - F.lit(math.pi / 2)).alias("lat"))


def box_contains(box: tuple[float, float, float, float], lon: Column, lat: Column) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def boxes_intersect(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Of boxes with lon0, lat0, lon1, lat1: closed, so touching boxes intersect."""
    return (a["lon0"] <= b["lon1"]) & (b["lon0"] <= a["lon1"]) & (a["lat0"] <= b["lat1"]) & (b["lat0"] <= a["lat1"])


def rectangle_ring(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """The closed ring of five positions around two corners."""
    return F.array(*(F.array(x, y) for x, y in ((lon0, lat0), (lon1, lat0), (lon1, lat1), (lon0, lat1), (lon0, lat0))))


def midpoint(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    return F.array((lon0 + lon1) / 2, (lat0 + lat1) / 2)
