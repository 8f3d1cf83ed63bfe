"""SimHash near-dedup (operator 4): deletion-variant signatures.

Two fingerprints at 2 or fewer differing bits are cut into two segments, of which one differs by at most one bit. So
each distinct fingerprint is indexed under every segment with every one bit left out (a wildcard), the variants are
joined on equality, and the pairs are verified. A variant that many fingerprints share (a tight group of near
copies) is not paired out: its members are indexed again by whole fingerprints with one bit flipped, over the bits in
which that group differs at all; those that share such a value are all linked, so each is linked to the least of
them. Both ways are exact. Links go to a connected-components step; work is on distinct fingerprints, so copies cost nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Members of a variant above which it is indexed by flipped bits.
CROWDED = 24
#: Shingles that are counted at once, which bounds memory on very long texts.
AT_ONCE = 1 << 15
_SEGMENT = 32


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half the XXH64 of 3-word shingles; 0 without a word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest, counts, total, some = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for shingle in shingles:
        some.append(digest(shingle, SEED))
        if len(some) == AT_ONCE:
            counts += _bit_counts(some)
            total, some = total + len(some), []
    if some:
        counts += _bit_counts(some)
    return int.from_bytes(np.packbits(2 * counts > total + len(some)).tobytes(), "big")


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many hashes have each bit, highest first."""
    octets = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body: hash of the text, bits: long) of every row; null texts are like empty ones."""
    import pyarrow as pa

    common.ship(docs.sparkSession)

    def run(record_batches):
        with common.worker_memory():
            for batch in common.batches(record_batches):
                bits = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits)], names=["doc_id", "body", "bits"])

    text = F.col(f"`{text_col}`")
    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))
    return inner.mapInArrow(run, "doc_id long, body long, bits long")


def _apart(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints in ``bits`` that differ by 2 bits or fewer, each once.

    Of crowded groups, only as many of these pairs as connect what all of them would.
    """
    variants = []
    for segment in (0, 1):
        part = F.shiftrightunsigned(F.col("bits"), _SEGMENT) if segment else F.col("bits").bitwiseAND(F.lit((1 << _SEGMENT) - 1))
        for wildcard in range(_SEGMENT):
            left = part.bitwiseAND(F.lit(~(1 << wildcard) & ((1 << _SEGMENT) - 1)))
            variants.append(F.shiftleft(left, 6).bitwiseOR(F.lit(segment * _SEGMENT + wildcard)))
    # Fingerprints are few bytes, so few tasks would hold them all; each makes 64 rows. (Dealt out by a hash of its own:
    # a repartition by the column itself would be merged with the aggregation before it, and that is coalesced.)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    indexed = distinct.repartition(parts, F.xxhash64("bits")).select("bits", F.explode(F.array(*variants)).alias("key"))
    shared = indexed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_or("bits").bitwiseXOR(F.bit_and("bits")).alias("differ")).where("n > 1")
    members = common.materialise(indexed.join(shared.hint("merge"), "key"), "simhash-members", held)

    few = members.where(F.col("n") <= CROWDED).select("key", "bits")
    paired = few.select("key", F.col("bits").alias("a")).join(few.select("key", F.col("bits").alias("b")), "key")
    paired = paired.where("a < b").where(_apart(F.col("a"), F.col("b")) <= MOST_BITS).select("a", "b")

    # Two members of a crowded variant differ in bits of its ``differ`` only, and both know all of these. Each stands
    # under itself and under itself with one such bit flipped: fingerprints share a value if and only if they differ
    # by 2 bits or fewer, so all that share one are linked, and links to the least of them connect as well.
    crowd = members.where(F.col("n") > CROWDED).groupBy("bits").agg(F.bit_or("differ").alias("differ"))
    flips = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: F.getbit("differ", p) == 1), lambda p: F.col("bits").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), p)))
    near = crowd.select("bits", F.explode(F.concat(F.array("bits"), flips)).alias("middle"))
    least = near.groupBy("middle").agg(F.min("bits").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starred = near.join(least, "middle").select("a", F.col("bits").alias("b")).where("a < b")
    return paired.union(starred).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), for every row.

    Null and empty texts, and texts of white space alone, have fingerprint 0 and are linked like any other. Rows
    with the same doc_id come out each. A null doc_id stays null and takes no part in the smallest one; a component
    of such rows only has a null component_id. An empty table gives an empty result.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, body, bits, component_id of every row."""
    held: list[DataFrame] = []
    marked = common.materialise(fingerprints(docs, id_col=id_col, text_col=text_col), "simhash")
    # The smallest id of its copies stands for a fingerprint; without any, the fingerprint itself would not be an id.
    nodes = marked.groupBy("bits").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many"))
    pairs = common.materialise(links(nodes.select("bits"), held), "simhash-links", held)
    joined = common.connected_components(pairs)
    grouped = joined.join(nodes, joined["node"] == nodes["bits"]).select("component", "bits", "least")
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = grouped.join(smallest, "component").select("bits", "component_id")
    # Most fingerprints are linked to none: only the others need a join, and they keep their own smallest id.
    classes = nodes.join(linked, "bits", "left").select("bits", "many", F.coalesce("component_id", "least").alias("component_id"))
    classes = common.materialise(classes, "simhash-classes", held)
    out = common.materialise(common.join_hot(marked, classes, "bits", held), "simhash-rows")
    common.discard_all([marked, *held])
    return out


def op4_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir).select("doc_id", "text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest doc_id stays.

    Rows go by id and text: another row with the id of one that goes is judged by its own text. Equal doc_ids of a
    component stay together; rows with a null doc_id stay.
    """
    gone = _grouped(docs).where("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("body").alias("__of")).distinct()
    marked = docs.withColumn("__body", F.xxhash64("text"))
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__body") == F.col("__of"))
    return marked.join(gone.hint("merge"), same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
