import json

import pytest
from pyspark.sql import functions as F

from geolattice.functions import geohash
from geolattice.operators.points import within
from geolattice.sources import delimited, generate, geojson, keyed
from geolattice.streaming.points import stream_within, windowed_counts

HEADER = "X\tY\tID\tNAME\tADDRESS\tCITY\tURL\tPHONE\tTYPE\tZIP"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_points_from_text(spark, tmp_path):
    path = write(
        tmp_path / "p.txt", HEADER, '-73.97\t40.75\t1\t "Cafe" \t\t NYC\thttp://x\t\tFree\t10001', "-73.98\t40.76\t2\tshort", "-73.99\t40.77\t3\ta\tb\tc\td\te\tf\tg\th\ti", "-73.97\t40.75\t4\tlater"
    )
    raw = delimited.read_delimited(spark, path).orderBy("seq").collect()
    assert [r.id for r in raw] == ["1", "2", "3", "4"]
    assert raw[0].name == '"Cafe"' and raw[0].address == "" and raw[0].city == "NYC" and raw[1].address is None and raw[2].zip == "g\th\ti"
    last = {r.id: r for r in delimited.read_points(spark, path).collect()}
    assert set(last) == {"2", "3", "4"} and last["4"].type is None and last["4"].rowkey == geohash.encode(40.75, -73.97)
    assert {r.id for r in delimited.read_points(spark, path, on_duplicate="first").collect()} == {"1", "2", "3"}
    merged = {r.id: r for r in delimited.read_points(spark, path, on_duplicate="merge").collect()}["4"]
    assert (merged.name, merged.type) == ("later", "Free")


def test_headers_and_order_of_several_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k in range(3):
        write(tmp_path / "d" / f"{k}.txt", HEADER, *(f"1\t2\t{k}-{i}" for i in range(50)))
    rows = delimited.read_delimited(spark, str(tmp_path / "d")).orderBy("seq").collect()
    assert [r.id for r in rows] == [f"{k}-{i}" for k in range(3) for i in range(50)]
    assert [r.id for r in delimited.read_points(spark, str(tmp_path / "d")).collect()] == ["2-49"]


@pytest.mark.parametrize("bad", ["\t40.75\t9\tx", "abc\t40.75\t9\tx", "-73.9"])
def test_bad_coordinates(spark, tmp_path, bad):
    path = write(tmp_path / "b.txt", HEADER, "-73.97\t40.75\t1\tok", bad)
    with pytest.raises(Exception):  # noqa: B017
        delimited.read_points(spark, path).collect()
    assert [r.id for r in delimited.read_points(spark, path, strict=False).collect()] == ["1"]


def test_trips(spark, tmp_path):
    line = lambda a, b, p: ",".join(["1", a, b, "1", "2.5", "1", "N", p, "7", *["0"] * 9])
    path = write(tmp_path / "t.csv", ",".join(delimited.TRIP_COLUMNS), line("2021-07-01 00:00:34", "2021-07-01 00:08:00", "68"), line("2021-07-01 00:00:34", "2021-07-01 00:08:00", "99"))
    rows = delimited.read_trips(spark, path).collect()
    assert [(r.rowkey, r.pu_id) for r in rows] == [("2021-07-01 00:00:34|2021-07-01 00:08:00", "68")]


def test_made_points(spark):
    df = generate.bulk_points(spark, 1000, (-75.99, -75.01, 44.01, 44.99), seed=5)
    rows = df.collect()
    assert len(rows) == 1000 == len({r.id for r in rows}) and all(-75.99 <= r.lon < -75.01 and 44.01 <= r.lat < 44.99 for r in rows)
    assert all(len(r[c]) == 10 and r[c].isalpha() for r in rows for c in generate.LETTER_COLUMNS) and len(df.columns) == 11
    assert rows == generate.bulk_points(spark, 1000, (-75.99, -75.01, 44.01, 44.99), seed=5).collect()
    assert within(df, "POLYGON ((-76.0 44.0, -76.0 45.0, -75.0 45.0, -75.0 44.0, -76.0 44.0))").count() == 1000
    assert generate.line_points(spark).count() == 10 and bytes(generate.line_points(spark).first().rowkey) == b"\x00\x00\x00\x01"
    for limits in ((1, 1, 0, 2), (0, 1, 2, 2), (0, 1, 2)):
        with pytest.raises(ValueError):
            generate.bulk_points(spark, 1, limits)


def test_keyed_tables(spark, tmp_path):
    df = generate.bulk_points(spark, 500, (-75.99, -75.01, 44.01, 44.99), seed=5).drop("name")
    keyed.write_sorted(df, str(tmp_path / "a"), partitions=4)
    stored = keyed.read_keyed(spark, str(tmp_path / "a"))
    assert stored.count() == 500 and keyed.read_keyed(spark, str(tmp_path / "a"), ["id"]).columns == ["id"]
    firsts = stored.groupBy(F.input_file_name()).agg(F.min("rowkey").alias("a"), F.max("rowkey").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(firsts, firsts[1:], strict=False))
    keyed.upsert(spark, str(tmp_path / "a"), stored.limit(3).withColumn("city", F.lit("new")), str(tmp_path / "b"))
    after = keyed.read_keyed(spark, str(tmp_path / "b"))
    assert after.count() == 500 and after.where("city = 'new'").count() == 3
    cells = spark.createDataFrame([("r", "a", "1", 1), ("r", "a", "2", 2), ("r", "b", "3", 1), ("s", "a", "4", 9)], "rowkey string, column string, value string, version int")
    assert {tuple(r) for r in keyed.latest_cells(cells, columns=["a", "b"]).collect()} == {("r", "2", "3"), ("s", "4", None)}


def test_geojson(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", -73.5, 40.25), (2, None, 0.0, 1.0)], "id int, name string, lon double, lat double")
    text = geojson.feature_collection(geojson.point_features(df, ["id", "name"])).first()[0]
    parsed = json.loads(text)
    assert parsed["type"] == "FeatureCollection" and {f["properties"]["name"] for f in parsed["features"]} == {"x", None}
    (tmp_path / "f.geojson").write_text(json.dumps(parsed, indent=1))
    rows = geojson.read_features(spark, str(tmp_path / "f.geojson")).collect()
    assert {(r.lon, r.lat, r.properties["id"]) for r in rows} == {(-73.5, 40.25, "1"), (0.0, 1.0, "2")}
    ring = df.select("id", F.array(F.array("lon", "lat"), F.array(F.lit(1.0), F.lit(2.0)), F.array("lon", "lat")).alias("ring"))
    assert json.loads(geojson.polygon_features(ring, ["id"], "ring").first()[0])["geometry"]["coordinates"][0][1] == [1.0, 2.0]
    assert json.loads(geojson.line_features(ring, ["id"], "ring").first()[0])["geometry"]["type"] == "LineString"


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(10)], "id int, lon double, lat double")
    df.write.parquet(str(tmp_path / "in"))
    stream = stream_within(spark, str(tmp_path / "in"), "id int, lon double, lat double", "POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0))")
    query = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.id for r in spark.table("found").collect()} == {0, 1, 2, 3}
    assert "window" in windowed_counts(spark.range(3).select(F.timestamp_seconds("id").alias("t")), "t").columns
