import math
import random

import pytest
from pyspark.sql import functions as F

from geolattice.functions import geohash
from geolattice.functions.geometry import (
    boxes_intersect,
    covers,
    from_spherical_mercator,
    from_wkt,
    great_circle_distance,
    midpoint,
    rectangle_ring,
    spherical_mercator,
)
from geolattice.operators.points import within, within_counts
from geolattice.plans.prefixes import has_prefix, lossless, minimum_bounding_prefixes
from geolattice.queries import SQUARE, TRIANGLE

#: Keys of the points that the square holds; those that the triangle holds as well.
HELD = {
    644: "dr5ru7tt72wm", 634: "dr5rukjkhsd0", 847: "dr5ru7q2tn3k", 1294: "dr5ru7hpn094", 569: "dr5ru7rxeqn2", 732: "dr5ru7fvm5jh", 580: "dr5rukn9brrk", 445: "dr5ru7zsemkp", 517: "dr5ru7yhj0n3",
    372: "dr5ru7m0bm8m", 516: "dr5rue8nk1y4", 514: "dr5ru77myu3f", 566: "dr5rukk42vj7", 656: "dr5ru7e5hcp5", 640: "dr5rukhnyc3x", 653: "dr5ru7epfg17", 570: "dr5ru7fvdecd", 1313: "dr5ru7k6h9ub",
    403: "dr5ru7hv4vyw", 750: "dr5ru7ss0bu1", 515: "dr5ru7g0bgy5", 669: "dr5ru7hzsnz1", 631: "dr5ru7t33776", 637: "dr5ru7xxuccw", 1337: "dr5ru7dsdf6g", 565: "dr5rukp0fp9v",
}
IN_TRIANGLE = {445, 516, 517, 565, 569, 580, 634, 637, 644, 847}


def plain_covers(shape, x, y):
    """Containment by rational arithmetic."""
    from fractions import Fraction as Q

    x, y = Q(x), Q(y)
    for part in shape.parts():
        if part.kind == "POINT":
            if part.points[0] == (x, y):
                return True
            continue
        edges = [(*map(Q, a), *map(Q, b)) for ring in (part.rings or [part.points]) for a, b in zip(ring, ring[1:], strict=False)]
        for x1, y1, x2, y2 in edges:
            if min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) and (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1):
                return True
        if part.kind == "POLYGON" and sum(min(y1, y2) <= y < max(y1, y2) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges if y1 != y2) % 2:
            return True
    return False


@pytest.fixture(scope="module")
def held(spark):
    rows = [(i, k, (b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for i, k in HELD.items() for b in [geohash.box(k)]]
    east = [(9000 + i, geohash.encode(40.76, -73.97 + i * 1e-4), -73.97 + i * 1e-4, 40.76) for i in range(17)]
    return spark.createDataFrame(rows + east, "id int, rowkey string, lon double, lat double").cache()


def test_known_counts(held):
    assert {r.id for r in within(held, SQUARE).collect()} == set(HELD)
    assert {r.id for r in within(held, TRIANGLE).collect()} == IN_TRIANGLE
    assert {r.id for r in within(held, SQUARE, rowkey_col="rowkey").collect()} == set(HELD)
    n = within_counts(held, TRIANGLE).first()
    assert n.n_within == 10 and n.n_candidates == n.n_within + n.n_excluded


def test_corners_are_covered(spark):
    line = spark.range(1, 11).select(F.col("id").cast("double").alias("lon"), F.col("id").cast("double").alias("lat"))
    assert within(line, "POLYGON ((0.0 0.0, 0.0 2.999, 2.999 2.999, 2.999 0.0, 0.0 0.0))").count() == 2
    assert within(line, "POLYGON ((0.0 0.0, 0.0 3.0, 3.0 3.0, 3.0 0.0, 0.0 0.0))").count() == 3


@pytest.mark.parametrize("edges", [5, 40, 150])
def test_covers_against_plain_arithmetic(spark, edges):
    rnd = random.Random(edges)
    ring = [(round(math.cos(2 * math.pi * i / edges) * rnd.uniform(2, 9), 2), round(math.sin(2 * math.pi * i / edges) * rnd.uniform(2, 9), 2)) for i in range(edges)]
    hole = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]
    text = ", ".join(f"{x} {y}" for x, y in [*ring, ring[0]])
    shape = from_wkt(f"GEOMETRYCOLLECTION (POLYGON (({text}), (-1 -1, 1 -1, 1 1, -1 1, -1 -1)), POINT (20 20), LINESTRING (12 0, 12 4, 16 4))")
    rows = [(rnd.uniform(-10, 10), rnd.uniform(-10, 10)) for _ in range(600)] + ring + hole + [(20.0, 20.0), (12.0, 2.0), (14.0, 4.0), (14.0, 2.0), (0.0, 0.0), (1.0, 0.5)]
    got = spark.createDataFrame(rows, "lon double, lat double").select("lon", "lat", covers(shape, "lon", "lat").alias("c")).collect()
    assert all(r.c == plain_covers(shape, r.lon, r.lat) for r in got)


def test_no_usable_coordinate_is_not_covered(spark):
    df = spark.createDataFrame([(None, 40.757), (-73.985, None), (float("nan"), 40.757), (-73.985, float("nan"))], "lon double, lat double")
    assert within(df, SQUARE).count() == 0
    assert df.where(~covers(SQUARE, "lon", "lat")).count() <= 4


def test_box_reaches_the_scan(spark, tmp_path, held):
    held.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert "GreaterThanOrEqual(lon" in plan(within(stored, SQUARE))
    assert "StringStartsWith(rowkey" in plan(within(stored, SQUARE, rowkey_col="rowkey"))


def test_prefixes():
    assert set(minimum_bounding_prefixes(SQUARE)) == set("dr5ru7 dr5ruk dr5rus dr5rue dr5rud dr5ru6 dr5ru4 dr5ru5 dr5ruh".split())
    assert minimum_bounding_prefixes("POLYGON ((-76.0 44.97, -76.0 45.0, -75.9 45.0, -75.9 44.97, -76.0 44.97))")[-1] == "drczz"
    assert minimum_bounding_prefixes("POLYGON ((0.0 0.0, 0.0 2.999, 2.999 2.999, 2.999 0.0, 0.0 0.0))")[-1] == "s03"
    assert minimum_bounding_prefixes("POINT (1 1)") == [geohash.encode(1, 1, 7)]
    with pytest.raises(ValueError):
        minimum_bounding_prefixes("POLYGON ((-179 -89, 179 -89, 179 89, -179 89, -179 -89))")
    with pytest.raises(ValueError):
        minimum_bounding_prefixes("POLYGON EMPTY")


def test_prefixes_that_lose_an_edge_are_left_out(spark):
    lon0, lat0, lon1, lat1 = geohash.box("dr5ru7t")
    cell = f"POLYGON (({lon0!r} {lat0!r}, {lon1!r} {lat0!r}, {lon1!r} {lat1!r}, {lon0!r} {lat1!r}, {lon0!r} {lat0!r}))"
    assert minimum_bounding_prefixes(cell) == ["dr5ru7t"] and not lossless(cell, ["dr5ru7t"])
    edge = (lon1, (lat0 + lat1) / 2)
    assert not geohash.encode(edge[1], edge[0]).startswith("dr5ru7t")
    df = spark.createDataFrame([(*edge, geohash.encode(edge[1], edge[0]))], "lon double, lat double, rowkey string")
    assert within(df, cell, rowkey_col="rowkey").count() == 1
    assert df.where(has_prefix("rowkey", [])).count() == 0


WKT = [
    "POINT (1 2)", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))", "MULTIPOINT (1 2, 3 4)", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POINT EMPTY", "point z (1 2 3)",
]


@pytest.mark.parametrize("text", WKT)
def test_wkt_round_trip(text):
    shape = from_wkt(text)
    assert from_wkt(shape.to_wkt()) == shape


@pytest.mark.parametrize("text", ["", "CIRCLE (1 2)", "POINT (1)", "POINT (1 2", "POINT (1 2) x", "POLYGON ((0 0, 1 1, 2 2))", "LINESTRING (0 0)", "POINT (a b)", "POLYGON ((0 0, 1 0, 1 1, 0 1))"])
def test_bad_wkt(text):
    with pytest.raises(ValueError):
        from_wkt(text)


def test_centroid():
    assert from_wkt("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))").centroid() == (1, 1)
    holed = from_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (2 0, 4 0, 4 4, 2 4, 2 0))").centroid()
    assert holed == pytest.approx((1, 2))
    assert from_wkt("LINESTRING (0 0, 2 0, 2 2)").centroid() == (1.5, 0.5)
    assert from_wkt("GEOMETRYCOLLECTION (POINT (9 9), LINESTRING (0 0, 2 0))").centroid() == (1, 0)
    assert from_wkt("MULTIPOINT (0 0, 2 4)").centroid() == (1, 2)
    assert from_wkt("LINESTRING (3 3, 3 3)").centroid() == (3, 3)


def test_measures(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0)], "lon double, lat double, lon2 double, lat2 double")
    c = [F.col(x) for x in df.columns]
    r = df.select(great_circle_distance(*c).alias("d"), midpoint(*c).alias("m"), rectangle_ring(*c).alias("r")).first()
    assert r.d == pytest.approx(6378137 * math.pi / 2) and r.m == [0, 45] and len(r.r) == 5 and r.r[0] == r.r[-1]
    p = df.select(spherical_mercator(F.lit(12.0), F.lit(50.0)).alias("p")).select(from_spherical_mercator(F.col("p.x"), F.col("p.y")).alias("q")).first().q
    assert (p.lon, p.lat) == pytest.approx((12, 50))
    boxes = [{n: F.lit(v) for n, v in zip(("lon0", "lat0", "lon1", "lat1"), b, strict=True)} for b in ((0, 0, 1, 1), (1, 1, 2, 2), (3, 3, 4, 4))]
    assert list(df.select(boxes_intersect(boxes[0], boxes[1]), boxes_intersect(boxes[0], boxes[2])).first()) == [True, False]
