"""Command line: ``python -m geolattice COMMAND ...``; each prints what it found, or writes a keyed table."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession

from .functions.values import match_line
from .operators import keys, points
from .sources import delimited, generate, keyed


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="geolattice", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest", help="delimited points into a table sorted by geohash")
    one.add_argument("source")
    one.add_argument("table")
    one.add_argument("--on-duplicate", choices=("last", "first", "merge"), default="last")
    one.add_argument("--lenient", action="store_true", help="leave out rows with bad coordinates instead of failing")
    one = commands.add_parser("generate", help="made-up points into a table sorted by geohash")
    one.add_argument("table")
    one.add_argument("count", type=int)
    one.add_argument("limits", type=float, nargs=4, metavar=("LON_MIN", "LON_MAX", "LAT_MIN", "LAT_MAX"))
    one.add_argument("--seed", type=int, default=0)
    one = commands.add_parser("within", help="points that a geometry covers")
    one.add_argument("table")
    one.add_argument("wkt")
    one.add_argument("--full-scan", action="store_true", help="do not skip by key")
    one = commands.add_parser("knn", help="nearest points")
    one.add_argument("table")
    one.add_argument("lon", type=float)
    one.add_argument("lat", type=float)
    one.add_argument("k", type=int)
    one.add_argument("--cells", action="store_true", help="only the cell of the point and those around it")
    one = commands.add_parser("earliest", help="the earliest rows of every reference value")
    one.add_argument("table")
    one.add_argument("reference")
    one.add_argument("timestamp")
    one.add_argument("x", type=int)
    one.add_argument("--key", default="rowkey")
    return top


def _show(found: DataFrame) -> int:
    lines = points.matches(found)
    if "distance" not in lines.columns:
        from pyspark.sql import functions as F

        lines = lines.withColumn("distance", F.lit(float("nan")))
    n = 0
    for row in lines.select(match_line("id", "hash", "lon", "lat", "distance")).toLocalIterator():
        print(row[0])
        n += 1
    return n


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one command; gives the number of rows found or written."""
    top = parser()
    given = top.parse_args(args)
    spark = spark or SparkSession.builder.appName("geolattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    began = time.perf_counter()
    if given.command == "ingest":
        keyed.write_sorted(delimited.read_points(spark, given.source, on_duplicate=given.on_duplicate, strict=not given.lenient), given.table)
        n = spark.read.parquet(given.table).count()
    elif given.command == "generate":
        try:
            made = generate.bulk_points(spark, given.count, tuple(given.limits), seed=given.seed)
        except ValueError as e:
            top.error(str(e))
        keyed.write_sorted(made, given.table)
        n = spark.read.parquet(given.table).count()
    else:
        table = keyed.read_keyed(spark, given.table)
        if given.command == "within":
            n = _show(points.within(table, given.wkt, rowkey_col=None if given.full_scan else "rowkey"))
        elif given.command == "knn":
            n = _show((points.knn_by_cells if given.cells else points.knn_exact)(table, given.lon, given.lat, given.k))
        else:
            rows = keys.earliest_x(table, given.reference, given.timestamp, given.x, key_col=given.key).orderBy(given.reference, "rank")
            n = 0
            for n, row in enumerate(rows.select(given.reference, given.key, given.timestamp).toLocalIterator(), 1):
                print(*row, sep="\t")
    print(f"{n} rows, {(time.perf_counter() - began) * 1000:.0f} ms")
    return n


if __name__ == "__main__":
    main()
