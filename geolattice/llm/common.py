"""What the text operators share: the shared folder, shipping of code, batches, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker works on at once; a longer document makes a batch of its own.
BATCH_BYTES = 2_000_000


#: Rows that Spark sends to a Python worker at once: with long texts its default of 10,000 takes much memory.
ARROW_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once for each context).

    Larger Arrow batches are cut down to ARROW_ROWS for the session.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows, "10000")) > ARROW_ROWS:
        spark.conf.set(rows, ARROW_ROWS)
    context = spark.sparkContext
    if getattr(context, "_geolattice_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="geolattice-")) / "geolattice_code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent).as_posix())
    context.addPyFile(str(target))
    context._geolattice_shipped = True


#: What this worker keeps from task to task: at most one tool, by the name of its kind and its source.
_KEPT: dict = {}


def kept_tool(kind: str, source: bytes, build):
    """The worker's tool of this kind for this source. It stays for the next task that ``worker_memory(kind)`` runs."""
    key = (kind, hash(source))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build(source)
    return _KEPT[key]


@contextlib.contextmanager
def worker_memory(kind: str | None = None):
    """For the run of a task: no scans of large caches for garbage; afterwards, free memory goes back to the system.

    Workers outlive their tasks, and beside an executor's heap there is little room for what they would hold on to.
    So a tool of another kind than this task's, with all that it remembers, is let go of first.
    """
    if any(held != kind for held, _ in _KEPT):
        _KEPT.clear()
        _give_back()
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        _give_back()


def _give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Remembered(dict):
    """What is known of parts of texts, in about ``most()`` bytes and what one batch adds; beyond, it starts anew."""

    def __init__(self, most):
        super().__init__()
        self.most, self.size = most, 0

    def make_room(self) -> bool:
        """Forget all if it is full; whether that was so."""
        full = self.size > self.most()
        if full:
            self.clear()
            self.size = 0
        return full

    def learn(self, parts, values: list) -> None:
        """``values`` are tuples or bytes of their own, or numbers."""
        self.update(zip(parts, values, strict=True))
        self.size += 100 * len(values) + sum(map(sys.getsizeof, parts)) + sum(map(sys.getsizeof, values))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where that is unset and everything runs on this machine (tests),
    one of our own; on a cluster without that setting this is an error, since executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="geolattice-shared-"))
            held = spark.sparkContext.getCheckpointDir()
        folder = held
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/geolattice/{name}-{uuid.uuid4().hex}"


#: The innermost list of a ``scratch`` that is open.
_OPEN: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch():
    """Inside, tables that a result is still read from are noted; they go when it is left, so write the result before."""
    _OPEN.append([])
    try:
        yield
    finally:
        discard_all(_OPEN.pop())


def materialise(df: DataFrame, name: str, held: list[DataFrame] | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors.

    What is added to ``held`` is to be discarded once the result that it goes into is written itself.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._geolattice_path = path
    if held is not None:
        held.append(out)
    elif _OPEN:
        _OPEN[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(df, "_geolattice_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard_all(held: list[DataFrame]) -> None:
    while held:
        discard(held.pop())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(spark: SparkSession, path: str):
    """A broadcast of a tokenizer's file: read on the driver, since executors need not have it."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def batches(record_batches, text: str = "text", limit: int = BATCH_BYTES) -> Iterator:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text, or one row."""
    for whole in record_batches:
        if whole.num_rows == 0:
            continue
        lengths = [0 if s is None else s for s in _byte_lengths(whole.column(whole.schema.get_field_index(text)))]
        start = size = 0
        for row, length in enumerate(lengths):
            if row > start and size + length > limit:
                yield whole.slice(start, row - start)
                start, size = row, 0
            size += length
        yield whole.slice(start)


def _byte_lengths(column) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def distinct_parts(lists):
    """(codes, distinct parts, offsets) of an Arrow array of lists of strings: codes[offsets[i]:offsets[i+1]] is row i.

    Parts are hashed in Arrow, so Python touches distinct ones only. Null lists are empty ones.
    """
    import numpy as np
    import pyarrow.compute as pc

    coded = lists.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), offsets.astype(np.int64)


def spread(codes, values, lengths):
    """The concatenation of ``values`` rows: row c of ``codes`` has lengths[c] values, which lie one after another."""
    import numpy as np

    starts = np.cumsum(lengths) - lengths
    size = lengths[codes]
    ends = np.cumsum(size)
    shift = np.repeat(starts[codes] - (ends - size), size)
    return values[np.arange(len(shift)) + shift], ends


#: Rows of a key from which on it is hot, and how many hot keys are sent to all executors at most (a few bytes each).
HOT, SENDABLE = 1000, 200_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, held: list[DataFrame]) -> DataFrame:
    """``rows`` joined to ``keyed`` (one row for each key; many: about how often ``rows`` has it) on ``key``.

    Hot keys are sent to where their rows are, if their checked number allows; the others meet by a shuffle.
    """
    hot = materialise(keyed.where(F.col("many") >= HOT), "hot-keys", held)
    if hot.count() > SENDABLE:
        return rows.join(keyed.drop("many"), key)
    few = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col("many") < HOT).drop("many"), key)
    return few.unionByName(rows.join(F.broadcast(hot.drop("many")), key))


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 100) -> DataFrame:
    """Components of the graph with ``edges`` (a, b: long): rows (node, component), smallest node as component.

    Alternates large-star and small-star steps until the set of edges stays as it is; every round is written to
    the shared folder, so a lost executor costs one round at most. Nodes without an edge do not appear; loops are
    ignored; no edges give no rows.
    """
    current = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    seen = _digest(current)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        linked = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(linked.select("e.u", "e.v").where("u <> v").distinct(), name)
        digest = _digest(after)
        discard(current)
        current, last = after, seen
        seen = digest
        if digest == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))


def _digest(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u") % 1_000_003).alias("s"),
    ).first()
    return row["n"], row["x"], row["s"]
