import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geolattice.functions import geohash as g
from geolattice.plans.prefixes import block

#: Sample points (lon, lat) and their keys.
SAMPLES = {
    "dr5ruez4z1q2": (-73.97201151, 40.75838285), "dr5rug8pt7f5": (-73.97071906, 40.75783900), "dr5ruu29vytq": (-73.97000655, 40.76098703),
    "dr5ruu91jyfd": (-73.96932375, 40.76223214), "dr5ruu693jhm": (-73.96746533, 40.76089302),
}


def by_halving(lat, lon, chars):
    """The definition: halve in turns, the upper half has the middle."""
    ranges, bits = [[-180.0, 180.0], [-90.0, 90.0]], []
    for i in range(5 * chars):
        r, v = ranges[i % 2], (lon, lat)[i % 2]
        middle = (r[0] + r[1]) / 2
        bits.append(v >= middle)
        r[0 if v >= middle else 1] = middle
    return "".join(g.ALPHABET[sum(b << 4 - k for k, b in enumerate(bits[i : i + 5]))] for i in range(0, len(bits), 5))


def test_samples():
    for key, (lon, lat) in SAMPLES.items():
        assert g.encode(lat, lon) == key
        lon0, lat0, lon1, lat1 = g.box(key)
        assert lon0 <= lon < lon1 and lat0 <= lat < lat1


@settings(max_examples=300, deadline=None)
@given(st.floats(-90, 90), st.floats(-180, 180), st.integers(1, 12))
def test_constant_encoding_is_halving(lat, lon, chars):
    assert g.encode(lat, lon, chars) == by_halving(lat, lon, chars)


def test_column_encoding_is_halving_at_edges(spark):
    rnd = random.Random(3)
    rows = [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(3000)]
    for _ in range(1000):
        k, lat = rnd.randrange(2**30), -90 + rnd.randrange(2**30) * 180 / 2**30
        lon = -180 + k * 360 / 2**30
        rows += [(lat, lon), (math.nextafter(lat, -91), math.nextafter(lon, -181)), (math.nextafter(lat, 91), math.nextafter(lon, 181))]
    rows += [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (-1e-300, 1e-300), (-0.0, -0.0)]
    rows = [(a, b) for a, b in rows if abs(a) <= 90 and abs(b) <= 180]
    df = spark.createDataFrame(rows, "lat double, lon double")
    for r in df.select("lat", "lon", g.geohash("lat", "lon").alias("h"), g.geohash("lat", "lon", 5).alias("s")).collect():
        assert r.h == by_halving(r.lat, r.lon, 12), (r.lat, r.lon)
        assert r.s == r.h[:5]


def test_column_of_no_place_is_null(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0), (91.0, 0.0), (0.0, 181.0), (float("inf"), 0.0)], "lat double, lon double")
    assert [r[0] for r in df.select(g.geohash("lat", "lon")).collect()] == [None] * 6


def test_column_box(spark):
    keys = [*SAMPLES, "d", "zz", "000"]
    df = spark.createDataFrame([(k,) for k in [*keys, None, "", "abc"]], "k string")
    got = [r[0] for r in df.select(g.geohash_box("k")).collect()]
    assert [tuple(x) for x in got[: len(keys)]] == [g.box(k) for k in keys]
    assert got[len(keys) :] == [None, None, None]


def test_neighbours():
    assert g.neighbours("dr5ru7t") == "dr5ru7v dr5ru7y dr5ru7w dr5ru7q dr5ru7m dr5ru7k dr5ru7s dr5ru7u".split()
    assert block("dr5ruu2") == [*"dr5ruu8 dr5ruu9 dr5ruu3 dr5ruu1 dr5ruu0 dr5rusp dr5rusr dr5rusx".split(), "dr5ruu2"]
    pole = g.encode(90, 10, 5)
    assert len(g.neighbours(pole)) == 5
    west = g.encode(0.1, -180, 4)
    assert g.encode(0.1, 179.999, 4) in g.neighbours(west)
    with pytest.raises(ValueError):
        g.encode(91, 0)
    with pytest.raises(ValueError):
        g.box("a")
    assert len(g.corners("dr5")) == 4
