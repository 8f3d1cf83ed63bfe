import datetime
import random

import pytest
from pyspark.sql import functions as F

from geolattice.functions import geohash, values
from geolattice.operators import keys, points
from geolattice.operators.spatial_join import points_in_geometries
from geolattice.queries import SQUARE, TRIANGLE

#: Sample points: id, lon, lat.
SAMPLE = [
    (1032, -73.97201151, 40.75838285), (635, -73.97149101, 40.75899747), (615, -73.97071906, 40.75783900), (442, -73.96993203, 40.75815170), (388, -73.96978387, 40.75850573), (441, -73.96974759, 40.75890919),
    (564, -73.96910155, 40.75873061), (870, -73.96992760, 40.75928170), (472, -73.96880474, 40.76048717), (593, -73.97000655, 40.76098703), (219, -73.96974993, 40.76170883), (463, -73.96873588, 40.76107453),
    (1132, -73.96881406, 40.76110682), (742, -73.96770372, 40.76059666), (525, -73.96746533, 40.76089302), (875, -73.96766719, 40.76148561), (1179, -73.96932375, 40.76223214),
]
AT = (-73.97000655, 40.76098703)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(SAMPLE, "id int, lon double, lat double").withColumn("rowkey", geohash.geohash("lat", "lon")).cache()


def test_key_order(sample):
    nine = {442, 388, 441, 564, 472, 593, 219, 463, 525}
    rows = sample.where(F.col("id").isin(nine))
    assert [r.id for r in rows.orderBy("rowkey").collect()] == [442, 388, 441, 564, 472, 593, 219, 463, 525]
    assert [r.id for r in rows.orderBy(F.desc("lon")).collect()] == [525, 463, 472, 564, 441, 219, 388, 442, 593]


def test_nearest(sample):
    got = points.knn_exact(sample, *AT, 5).collect()
    assert [r.id for r in got] == [593, 219, 1132, 463, 472]
    assert [r.distance for r in got] == pytest.approx([0.0, 0.0007660607445855149, 0.0011984915703439614, 0.001273679119280636, 0.0013016171847742345], abs=1e-15)
    assert [r.id for r in points.knn_by_cells(sample, *AT, 10).collect()] == [593, 219, 1132, 463, 472, 1179, 870]
    assert points.knn_exact(sample, *AT, 10).count() == 10
    cells = points.nearest_per_cell(sample, *AT, 10)
    assert [r.id for r in points.merge_nearest(cells, 10).collect()] == [593, 219, 1132, 463, 472, 1179, 870]
    per = points.knn_per_region(sample, *AT, 2, region=F.col("id") % 3).collect()
    assert len(per) == 6 and {r["rank"] for r in per} == {1, 2}
    assert points.knn_per_region(sample, *AT, 2).count() >= 2
    assert points.matches(points.knn_exact(sample, *AT, 1)).columns == ["id", "hash", "lon", "lat", "distance"]
    assert points.as_candidates(points.knn_exact(sample, *AT, 3), None, "distance", "id").first().candidates[0].id == 593


def test_nearest_limits(sample, spark):
    for bad in (0, -1):
        with pytest.raises(ValueError):
            points.knn_exact(sample, *AT, bad)
    with pytest.raises(ValueError):
        points.knn_exact(sample, 40.76, -173.97, 1)
    rows = spark.createDataFrame([(1, float("nan"), 1.0), (2, None, 1.0), (3, 1.0, 1.0), (4, 1.0, 1.0)], "rowkey int, lon double, lat double")
    assert [r.rowkey for r in points.knn_exact(rows, 1.0, 1.0, 5).collect()] == [3, 4]


def test_cell_query_is_part_of_exact_one(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(i, AT[0] + rnd.gauss(0, 1e-3), AT[1] + rnd.gauss(0, 1e-3)) for i in range(2000)], "id int, lon double, lat double").withColumn("rowkey", geohash.geohash("lat", "lon"))
    assert points.knn_by_cells(rows, *AT, 5).exceptAll(points.knn_exact(rows, *AT, 5)).isEmpty()


@pytest.mark.parametrize("x", [1, 2, 100])
def test_earliest(spark, x):
    rnd = random.Random(x)
    rows = [(f"k{i:04}", rnd.choice(["a", "b", "c", None]), rnd.choice([None, *range(20)])) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, ref string, ts long")
    got = keys.earliest_x(df, "ref", "ts", x, key_col="key")
    for ref in "abc":
        exp = sorted((t, k) for k, r, t in rows if r == ref and t is not None)[:x]
        assert sorted((r.ts, r.key) for r in got.where(F.col("ref") == ref).collect()) == exp
    latest = keys.earliest_x(df, "ref", "ts", 1, key_col="key", ascending=False)
    assert {r.ts for r in latest.collect()} == {19}
    with pytest.raises(ValueError):
        keys.earliest_x(df, "ref", "ts", 0, key_col="key")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize(
    ("n", "expected"), [(None, "a1bf a2be a3bd a4bc a5bb"), (1, "a1bf a6ca"), (2, "a1bf a2be a6ca a7c9"), (3, "a1bf a2be a3bd a6ca a7c9")]
)
def test_bins(spark, n, expected):
    df = spark.createDataFrame([(k,) for k in "a1bf a2be a3bd a4bc a5bb a6ca a7c9 a8c8 b1a7".split()], "key string")
    got = keys.limited_scan(df, "key", 5, start="a", end="b") if n is None else keys.first_n_per_bin(df, "key", 2, 1, n, start="a", end="b", limit=5)
    assert [r.key for r in got.collect()] == expected.split()


def test_collapse(spark):
    df = spark.createDataFrame([("k", 1, "a", "x"), ("k", 2, "b", None), ("l", 1, None, "y")], "key string, seq int, p string, q string")
    take = lambda how: {r.key: (r.p, r.q) for r in keys.collapse(df, "key", "seq", how).collect()}
    assert take("last") == {"k": ("b", None), "l": (None, "y")}
    assert take("first") == {"k": ("a", "x"), "l": (None, "y")}
    assert take("merge") == {"k": ("b", "x"), "l": (None, "y")}
    with pytest.raises(ValueError):
        take("any")


def test_relations(sample, spark):
    inside = sample.where("id < 500")
    assert {r.id for r in keys.unmatched(sample, inside, "id").collect()} == {i for i, _, _ in SAMPLE if i >= 500}
    assert keys.same_rows(inside, inside) and not keys.same_rows(inside, sample) and not keys.same_rows(inside.union(inside), inside)
    cells = spark.createDataFrame([("dr5ruu2",), ("dr5ruu2",), ("dr5ruu3",)], "cell string")
    assert {r.id for r in keys.in_cells(sample, "rowkey", cells, 7).collect()} == {593, 219, 463, 1132}
    assert keys.prefix_scan(sample, "rowkey", "dr5ruu2", "dr5ruu").count() == 10
    assert keys.distinct_sorted(sample.union(sample), "id").count() == 17
    assert keys.group_counts(sample.union(sample), "id").first().n == 2
    assert sample.where(points.all_of([])).count() == 17


def test_spatial_join(spark):
    rnd = random.Random(4)
    rows = spark.createDataFrame([(i, rnd.uniform(-73.995, -73.975), rnd.uniform(40.75, 40.765)) for i in range(800)], "id int, lon double, lat double").withColumn("rowkey", geohash.geohash("lat", "lon"))
    got = points_in_geometries(rows, {"s": SQUARE, "t": TRIANGLE})
    for name, shape in (("s", SQUARE), ("t", TRIANGLE)):
        assert {r.id for r in got.where(F.col("geometry_id") == name).collect()} == {r.id for r in points.within(rows, shape).collect()}


def test_values(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("x",), (None,), ("NaN",), ("Infinity",)], "t string").withColumn("v", values.lenient_double("t"))
    assert [r.t for r in df.where(values.is_finite("v")).collect()] == ["1.5", " 2 "]
    for bad in ("x", None):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(bad,)], "t string").select(values.strict_double("t")).collect()
    line = spark.range(1).select(values.match_line(F.lit("7"), F.lit("dr5ru7"), F.lit(1.5), F.lit(-2.25), F.lit(0.125))).first()[0]
    assert line == "<QueryMatch:    7,       dr5ru7, 1.5000, -2.2500, 0.12500 >"
    t = spark.range(1).select(values.local_time_millis(F.lit("2021-07-01 00:00:34")), values.key_bin(F.lit("abcdef"), 2, 3), values.composite_key(F.lit("a"), F.lit("b")), values.strict_long(F.lit(" 12 "))).first()
    assert list(t) == [int(datetime.datetime(2021, 7, 1, 0, 0, 34, tzinfo=datetime.UTC).timestamp() * 1000), "cde", "a|b", 12]
