"""Keyed tables as sorted Parquet: a range of keys is then a few row groups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import collapse


def write_sorted(df: DataFrame, path: str, *, rowkey_col: str = "rowkey", mode: str = "errorifexists", partitions: int | None = None) -> None:
    """Deal out by ranges of the key and sort, so that files and row groups hold narrow ranges of it."""
    ranged = df.repartitionByRange(partitions, rowkey_col) if partitions else df.repartitionByRange(rowkey_col)
    ranged.sortWithinPartitions(rowkey_col).write.mode(mode).parquet(path)


def working_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Only where that is unset and everything runs on this machine, in a folder of our own; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='geolattice-tables-')}"
    return f"{folder.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def read_keyed(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All rows, or some columns (a family is the list of its columns)."""
    out = spark.read.parquet(path)
    return out.select(*columns) if columns else out


def upsert(spark: SparkSession, path: str, rows: DataFrame, new_path: str, *, rowkey_col: str = "rowkey", on_duplicate: str = "last") -> None:
    """Write what the table and the new rows make together to ``new_path``; the old table stays for its readers."""
    old = spark.read.parquet(path).withColumn("_version", F.lit(0))
    both = old.unionByName(rows.withColumn("_version", F.lit(1)), allowMissingColumns=True)
    write_sorted(collapse(both, rowkey_col, "_version", on_duplicate).drop("_version"), new_path, rowkey_col=rowkey_col)


def latest_cells(cells: DataFrame, *, rowkey_col: str = "rowkey", column_col: str = "column", value_col: str = "value", version_col: str = "version", columns: list[str]) -> DataFrame:
    """A row for each key from versioned cells: of every column the value with the highest version."""
    picked = [F.max_by(F.when(F.col(column_col) == c, F.col(value_col)), F.when(F.col(column_col) == c, F.col(version_col))).alias(c) for c in columns]
    return cells.groupBy(rowkey_col).agg(*picked)
