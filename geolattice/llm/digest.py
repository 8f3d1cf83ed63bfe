"""Document fingerprints (operator 8): quartile bucket digests.

The byte triplets of a text are hashed into buckets and counted. A digest holds, for each bucket, in which quartile
of all bucket counts it lies (2 bits), the length on a logarithmic scale, and how the quartiles relate. Two digests
are compared by a difference score with a fixed upper bound, which gives a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 256
#: Difference of a bucket by how many quartiles lie between; the widest is punished more than in proportion.
STEPS = np.array([0, 1, 2, 6])
#: Most that the length, and each of two relations of quartiles, add to a difference.
MOST_LENGTH, MOST_RATIO = 48, 16
MOST = int(STEPS[-1]) * BUCKETS + MOST_LENGTH + 2 * MOST_RATIO
#: Bytes whose triplets are counted at once.
AT_ONCE = 1 << 20
#: Odd multipliers that mix the bytes of a triplet.
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of hashed triplets; texts of under three bytes have none."""
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(0, len(data) - 2), AT_ONCE):
        b = np.frombuffer(data, np.uint8, min(AT_ONCE + 2, len(data) - start), start).astype(np.uint32)
        mixed = b[:-2] * np.uint32(_MIX[0]) + b[1:-1] * np.uint32(_MIX[1]) + b[2:] * np.uint32(_MIX[2])
        mixed ^= mixed >> np.uint32(15)
        counts += np.bincount((mixed * np.uint32(_MIX[0])) >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(text: str | None) -> str:
    """Hex digits: length (2), relations of quartiles (2), quartiles of 256 buckets (128)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    low, middle, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > low).astype(np.uint8) + (counts > middle) + (counts > high)
    packed = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(axis=1).astype(np.uint8)
    length = min(255, int(round(8 * np.log2(len(data) + 1))))
    ratios = (int(15 * low / high) << 4 | int(15 * middle / high)) if high else 0
    return bytes([length, ratios]).hex() + packed.tobytes().hex()


def difference(a: str, b: str) -> int:
    """From 0 (equal digests) to MOST."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    quartiles = [(p[2:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(-1).astype(np.int64) for p in (x, y)]
    total = int(STEPS[np.abs(quartiles[0] - quartiles[1])].sum())
    total += min(MOST_LENGTH, abs(int(x[0]) - int(y[0])))
    for shift in (4, 0):
        total += min(MOST_RATIO, abs(int(x[1] >> shift & 15) - int(y[1] >> shift & 15)))
    return total


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the widest difference."""
    return 1.0 - difference(a, b) / MOST


def digests(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Add the digest of every text; a null text counts as an empty one."""
    common.ship(docs.sparkSession)

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return docs.withColumn(out_col, digest(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def with_edited_texts(docs: DataFrame) -> DataFrame:
    """Every row with its edited text: doc_id, n_chars, edited_sha256, fingerprints, near_edited, near_next.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document's
    text, in descending order of doc_id; after the last document comes the first. A table of one document follows
    itself. Null texts are empty; rows with equal doc_ids follow in the order of their texts, rows without doc_id come
    last. An empty table gives an empty result.

    Documents are dealt out by ranges of doc_id. The range that a document is in is found from quantiles of doc_id,
    and the first document of each range goes, in a copy, to the end of the range before: no task reads another's.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(x) for x in known.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    # Ranges count from the highest ids: range r holds cuts[r - 1] > doc_id >= cuts[r], the last one also the nulls.
    below = cuts[::-1]
    of = F.array_size(F.filter(F.array(*map(F.lit, below)), lambda c: c > F.col("doc_id"))) if below else F.lit(0)
    ranged = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(of).cast("int"))
    ends = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("e")).collect()
    filled = sorted(r["part"] for r in ends)
    if not filled:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # The document that comes after range r: the highest of the next range that has any, or the very first.
    top = {r["part"]: r["e"]["doc_id"] for r in ends}
    follower = {part: filled[(k + 1) % len(filled)] for k, part in enumerate(filled)}
    before = {after: part for part, after in follower.items()}
    pairs = [F.lit(x) for part, doc_id in top.items() if doc_id is not None for x in (part, doc_id)]
    first = F.create_map(*pairs)[F.col("part")] if pairs else F.lit(None)
    home = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    leads = F.coalesce(F.col("doc_id") == first, F.lit(False)) | (F.col("doc_id").isNull() & F.col("part").isin([p for p, d in top.items() if d is None]))
    # Of rows that share the highest id only the first text is needed: the smallest, found in the range itself.
    copies = F.when(leads, F.array(F.struct(F.col("part"), F.lit(False).alias("copy")), F.struct(home[F.col("part")].alias("part"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("copy"))))
    dealt = ranged.select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.part", "to.copy")
    # Dealt out by range: a hash of so few numbers would give some tasks several ranges and others none.
    sorted_rows = dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(record_batches):
        with common.worker_memory():
            held, done = None, []  # the row that waits for the next, (doc_id, text, digest)

            def pair(row, nxt):
                doc_id, text, own = row
                half = len(text) // 2
                edited = text[: len(text) - half] + nxt[1][:half]
                other = own if edited == text else fingerprint(edited)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                done.append((doc_id, len(text), sha, own, other, likeness(own, other), likeness(own, nxt[2])))

            last_part = None
            for batch in common.batches(record_batches):
                for doc_id, text, part, copy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    row = (doc_id, text, fingerprint(text))
                    if part == last_part and held is not None:
                        pair(held, row)
                    held, last_part = (None if copy else row), part
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _types(), strict=True)], names=names)
                    done.clear()

    return sorted_rows.mapInArrow(run, schema)


def _types():
    import pyarrow as pa

    return [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_edited_texts(common.documents(spark, sf_dir).select("doc_id", "text"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER w AS nxt, first_value(coalesce(text, '')) OVER w AS head
  FROM documents WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, coalesce(text, ''))
), f AS (
  SELECT doc_id, text, coalesce(nxt, head) AS nxt, length(text) AS n, substr(text, 1, length(text) - length(text) // 2) || substr(coalesce(nxt, head), 1, length(text) // 2) AS edited FROM d
), t AS (
  SELECT DISTINCT text AS t FROM f UNION SELECT DISTINCT edited FROM f
), b AS (
  SELECT t, [CAST('0x' || x AS UBIGINT) FOR x IN regexp_extract_all(hex(encode(t)), '..')] AS bytes FROM t
), m AS (
  SELECT t, (z[1] * 2654435761 + z[2] * 2246822507 + z[3] * 3266489909) % 4294967296 AS m
  FROM (SELECT t, unnest(list_zip(bytes[1:len(bytes) - 2], bytes[2:len(bytes) - 1], bytes[3:len(bytes)])) AS z FROM b WHERE len(bytes) > 2)
), c AS (
  SELECT t, ((xor(m, m >> 15) * 2654435761::UBIGINT) % 4294967296) >> 24 AS bucket, count(*) AS c FROM m GROUP BY 1, 2
), full_counts AS (
  SELECT b.t, r.bucket, coalesce(c.c, 0) AS c FROM b CROSS JOIN (SELECT unnest(range(256)) AS bucket) r LEFT JOIN c ON b.t = c.t AND c.bucket = r.bucket
), q AS (
  SELECT t, s[64] AS low, s[128] AS middle, s[192] AS high FROM (SELECT t, list_sort(list(c)) AS s FROM full_counts GROUP BY t)
), k AS (
  SELECT x.t, x.bucket, (c > low)::INT + (c > middle)::INT + (c > high)::INT AS code FROM full_counts x JOIN q ON x.t = q.t
), p AS (
  SELECT t, bucket // 4 AS place, sum(code << CAST(6 - 2 * (bucket % 4) AS INT)) AS octet FROM k GROUP BY 1, 2
), h AS (
  SELECT t, string_agg(printf('%02x', octet::INT), '' ORDER BY place) AS digits FROM p GROUP BY t
), codes AS (
  SELECT t, list(code ORDER BY bucket) AS codes FROM k GROUP BY t
), g AS (
  SELECT q.t, codes.codes, least(255, CAST(round(8 * log2(strlen(q.t) + 1)) AS INT)) AS size, CASE WHEN high > 0 THEN CAST(15 * low // high AS INT) ELSE 0 END AS r1,
         CASE WHEN high > 0 THEN CAST(15 * middle // high AS INT) ELSE 0 END AS r2, h.digits
  FROM q JOIN h ON q.t = h.t JOIN codes ON q.t = codes.t
), o AS (
  SELECT f.doc_id, f.n, f.edited, printf('%02x%02x', x.size, x.r1 * 16 + x.r2) || x.digits AS fx, printf('%02x%02x', y.size, y.r1 * 16 + y.r2) || y.digits AS fy,
         list_sum([CASE WHEN abs(u[1] - u[2]) = 3 THEN 6 ELSE abs(u[1] - u[2]) END FOR u IN list_zip(x.codes, y.codes)]) + least(48, abs(x.size - y.size)) + least(16, abs(x.r1 - y.r1)) + least(16, abs(x.r2 - y.r2)) AS dy,
         list_sum([CASE WHEN abs(u[1] - u[2]) = 3 THEN 6 ELSE abs(u[1] - u[2]) END FOR u IN list_zip(x.codes, z.codes)]) + least(48, abs(x.size - z.size)) + least(16, abs(x.r1 - z.r1)) + least(16, abs(x.r2 - z.r2)) AS dz
  FROM f JOIN g x ON f.text = x.t JOIN g y ON f.edited = y.t JOIN g z ON f.nxt = z.t
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fx AS fingerprint, fy AS edited_fingerprint, 1 - dy::DOUBLE / 1616 AS near_edited, 1 - dz::DOUBLE / 1616 AS near_next FROM o
"""
