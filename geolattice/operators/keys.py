"""Queries over keys: earliest rows of a group, first rows of a key bin, scans, and which write of a key counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import key_bin
from ..plans.prefixes import has_prefix


def earliest_x(df: DataFrame, reference_col: str, timestamp_col: str, x: int, *, key_col: str, ascending: bool = True) -> DataFrame:
    """The x earliest (or latest) rows of every reference value; equal times go by key.

    Rows without a reference or a time are out. Each task keeps x rows of a group before the shuffle, so a group that
    holds a third of all rows costs no more than x rows from each task.
    """
    if x < 1:
        raise ValueError("x must be 1 or more")
    time = F.col(timestamp_col).asc() if ascending else F.col(timestamp_col).desc()
    known = df.where(F.col(reference_col).isNotNull() & F.col(timestamp_col).isNotNull())
    return known.withColumn("rank", F.row_number().over(Window.partitionBy(reference_col).orderBy(time, F.col(key_col)))).where(F.col("rank") <= x)


def first_n_per_bin(df: DataFrame, key_col: str, offset: int, length: int, n: int, *, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """The first n rows, in key order, of every bin (a substring of the key) in the range [start, end).

    The limit comes after the cut by bin. Bins are ``bin``, places in a bin ``rank``.
    """
    if n < 1 or (limit is not None and limit < 1):
        raise ValueError("n and limit must be 1 or more")
    rows = key_range(df, key_col, start, end).withColumn("bin", key_bin(key_col, offset, length))
    cut = rows.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy(key_col))).where(F.col("rank") <= n)
    return cut.orderBy(key_col).limit(limit) if limit is not None else cut


def key_range(df: DataFrame, key_col: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= key < end; either may be missing."""
    out = df
    if start is not None:
        out = out.where(F.col(key_col) >= start)
    return out.where(F.col(key_col) < end) if end is not None else out


def prefix_scan(df: DataFrame, key_col: str, *prefixes: str) -> DataFrame:
    """Rows whose key begins with one of the prefixes, each once: one scan, skipped by key where files are sorted."""
    return df.where(has_prefix(key_col, list(prefixes)))


def limited_scan(df: DataFrame, key_col: str, limit: int, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """The first rows in key order."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return key_range(df, key_col, start, end).orderBy(key_col).limit(limit)


def collapse(df: DataFrame, key_col: str, seq: Column | str, on_duplicate: str = "last") -> DataFrame:
    """One row for each key. ``seq`` orders the writes; it must differ within a key.

    ``last`` and ``first`` take whole rows; ``merge`` takes for every column its last value that is not null.
    """
    order = F.col(seq) if isinstance(seq, str) else seq
    others = [c for c in df.columns if c != key_col]
    if on_duplicate in ("last", "first"):
        pick = F.max_by if on_duplicate == "last" else F.min_by
        whole = df.groupBy(key_col).agg(pick(F.struct(*others), order).alias("row"))
        return whole.select(key_col, *(F.col("row").getField(c).alias(c) for c in others)).select(*df.columns)
    if on_duplicate == "merge":
        return df.groupBy(key_col).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in others)).select(*df.columns)
    raise ValueError("on_duplicate is last, first or merge")


def unmatched(df: DataFrame, matched: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` without a partner in ``matched``."""
    return df.join(matched.select(on), on, "left_anti")


def in_cells(df: DataFrame, key_col: str, cells: DataFrame, precision: int) -> DataFrame:
    """Rows whose key lies in one of many cells (column ``cell``, all of one precision): for sets beyond a predicate."""
    keyed = df.withColumn("cell", F.substring(key_col, 1, precision))
    return keyed.join(cells.select("cell").distinct(), "cell", "left_semi").drop("cell")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows, each as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def group_counts(df: DataFrame, reference_col: str) -> DataFrame:
    return df.groupBy(reference_col).agg(F.count(F.lit(1)).alias("n"))
