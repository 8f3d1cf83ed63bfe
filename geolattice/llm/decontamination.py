"""Benchmark decontamination (operator 2): spaced-seed hashing.

Fixed masks over words ignore selected positions, so a window still hashes alike if words there were substituted.
Hashes of all windows of the documents are joined with those of the benchmark on equality; around each hit the two
texts are compared word by word on the same diagonal, and an overlap counts if enough words agree. Before the join, a
bit table of bounded size, made from the benchmark's hashes, drops windows that can have no partner; it never drops
one that has.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Masks: 1 is a position that counts. Wherever a fifth of 13 to 30 words is substituted, one of them still hits.
MASKS = ("1101011", "1110011", "1011101", "11100101", "11001011", "1111001", "110111")
#: Items of this many words or more are searched for; shorter ones (under a five-word shingle) are not.
LEAST_WORDS = 5
#: Words that an overlap must have, and the share of them that must agree; words from which on that share of a whole
#: item is enough.
OVERLAP, AGREE, MOSTLY = 13, 0.8, 10
#: Entries of the bit table for each hash of the benchmark, and its largest size (a fuller table only sifts less).
SPARSE, LARGEST = 64, 1 << 26
#: Where in a hash its places in the table are read from.
_PLACES = (0, 19, 38)
#: Text bytes of a batch, and bytes of words that a task remembers.
HASHED_BYTES, REMEMBERED = 6_000_000, 80_000_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalise(chunk: str) -> str:
    """A word without case and without marks at its ends; empty for marks alone."""
    return _EDGES.sub("", chunk.lower())


class WordHasher:
    """64-bit hashes of the words of a batch of texts; distinct chunks between ASCII white space are hashed once."""

    def __init__(self):
        self.known = common.Remembered(lambda: REMEMBERED)

    def hash(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ends) of an Arrow array of texts: the words of text i end at ends[i]; null texts have none."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        self.known.make_room()
        codes, parts, offsets = common.distinct_parts(pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string())))
        known = self.known
        new = [p for p in parts if p not in known]
        named = map(normalise, new)
        known.learn(new, [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 1) | 1 if w else 0 for w in named])
        table = np.fromiter((known[p] for p in parts), np.uint64, len(parts))
        hashes = table[codes] if len(codes) else np.empty(0, np.uint64)
        real = hashes != 0
        ends = np.concatenate([[0], np.cumsum(real)])[offsets[1:]]
        return hashes[real], ends


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each start of a window; windows reach over the ends of texts, and the caller drops those."""
    size = len(words) - len(mask) + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.full(size, np.uint64(zlib.crc32(mask.encode())), np.uint64)
    for place, used in enumerate(mask):
        if used == "1":
            out *= _ODD
            out += words[place : place + size]
            out ^= out >> np.uint64(29)
    return out


def _seeds(words: np.ndarray, ends: np.ndarray, masks: tuple[str, ...], table: np.ndarray | None):
    """(text, position in it, hash) of windows inside one text, those only that the table may know."""
    starts = np.concatenate([[0], ends[:-1]])
    for mask in masks:
        hashes = seed_hashes(words, mask)
        at = np.arange(len(hashes)) if table is None else np.flatnonzero(in_table(table, hashes))
        text = np.searchsorted(ends, at, side="right")
        inside = at + len(mask) <= ends[text]
        at, text = at[inside], text[inside]
        yield text, at - starts[text], hashes[at].view(np.int64)


def _benchmark_seeds(items: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """Items with their words; their hashes (hash, item_id, place); the masks, with whole-item ones for short items."""
    import pyarrow as pa

    def words(record_batches):
        hasher = WordHasher()
        for batch in common.batches(record_batches):
            hashes, ends = hasher.hash(batch.column(1))
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["item_id", "item_words"])

    named = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), "text").where("item_id is not null")
    known = common.materialise(named.mapInArrow(words, "item_id long, item_words array<long>").where(F.size("item_words") >= LEAST_WORDS), "benchmark")
    longest = max(map(len, MASKS))
    short = [r[0] for r in known.where(F.size("item_words") < longest).select(F.size("item_words")).distinct().collect()]
    masks = MASKS + tuple("1" * n for n in sorted(short) if "1" * n not in MASKS)

    def seeds(record_batches):
        for batch in record_batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for text, place, hashes in _seeds(flat, ends, masks, None):
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids[text]), pa.array(place)], names=["hash", "item_id", "place"])

    return known, common.materialise(known.mapInArrow(seeds, "hash long, item_id long, place long"), "benchmark-seeds"), masks


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """Marks three places for each hash. Its pieces are made on the executors; their number has a bound."""
    distinct = max(1, hashes.select(column).distinct().count())
    size = min(LARGEST, max(1 << 16, 1 << (SPARSE * distinct - 1).bit_length()))
    places = hashes.select(F.explode(F.array(*(F.shiftrightunsigned(column, s).bitwiseAND(F.lit(size - 1)) for s in _PLACES))).alias("place"))
    pieces = places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
    table = np.zeros(size, bool)
    for row in pieces.collect():
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        start = (row["piece"] - 1) * len(bits)
        table[start : start + len(bits)] = bits[: max(0, size - start)]
    return table


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one that the table was made of."""
    last = np.uint64(len(table) - 1)
    out = table[hashes & last]
    for shift in _PLACES[1:]:
        some = np.flatnonzero(out)
        out[some] = table[(hashes[some] >> np.uint64(shift)) & last]
    return out


def best_overlap(agree: np.ndarray) -> tuple[int, int, int]:
    """(start, end, words that agree) of the stretch with the highest sum of +1 for agreement and a cost otherwise.

    The cost makes at least AGREE of any such stretch agree; of equal sums the first is taken.
    """
    score = np.where(agree, 1.0, -AGREE / (1 - AGREE))
    sums = np.concatenate([[0.0], np.cumsum(score)])
    lowest = np.minimum.accumulate(sums)
    gain = sums[1:] - lowest[:-1]
    if not len(gain) or gain.max() <= 0:
        return 0, 0, 0
    end = int(gain.argmax()) + 1
    start = int(np.flatnonzero(sums[:end] == lowest[end - 1])[-1])
    return start, end, int(agree[start:end].sum())


def longest_overlap(agree: np.ndarray) -> tuple[int, int, int]:
    """(start, end, words that agree) of the longest stretch of which AGREE or more agree.

    Of equal ones that with the most agreement is taken, then the first. Words at its ends that do not agree are left
    off as far as OVERLAP words remain.
    """
    share = round(1000 * AGREE)
    sums = np.concatenate([[0], np.cumsum(np.where(agree, 1000 - share, -share))])
    ahead = np.maximum.accumulate(sums[::-1])[::-1]  # falls, so the last place that is as high is found by bisection
    ends = np.searchsorted(-ahead, -sums, side="right") - 1
    lengths = ends - np.arange(len(sums))
    longest = np.flatnonzero(lengths == lengths.max())
    start = int(longest[(sums[ends[longest]] - sums[longest]).argmax()])
    end = int(ends[start])
    same = np.flatnonzero(agree[start:end]) + start
    if not len(same):
        return 0, 0, 0
    start = max(start, min(int(same[0]), end - OVERLAP))
    end = min(end, max(int(same[-1]) + 1, start + OVERLAP))
    return start, end, len(same)


def verified(agree: np.ndarray, item_length: int) -> tuple[int, int, int] | None:
    """The overlap to report, as ``longest_overlap`` does: a long enough stretch, or else most of a short item."""
    if item_length >= OVERLAP:
        found = longest_overlap(agree)
        if found[1] - found[0] >= OVERLAP:
            return found
    total = int(agree.sum())
    return (0, len(agree), total) if total >= (AGREE * item_length if item_length >= MOSTLY else item_length) else None


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, doc_start, n_words, n_agree, coverage: the best verified overlap of each pair, each pair once.

    An overlap has OVERLAP words or more, of which AGREE or more are the same, at the same distance from the item's
    start; or else that share of a whole item of MOSTLY words or more, or all of a shorter one. ``coverage`` is the share of the item's words in it that agree. Null and
    empty texts, and items of under LEAST_WORDS words, overlap with nothing; rows without an id are left out, as no
    result could name them; repeated rows give the pair once; an empty table gives an empty result.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    common.ship(spark)
    items, seeds, masks = _benchmark_seeds(benchmark, item_col)
    table = spark.sparkContext.broadcast(np.packbits(bit_table(seeds, "hash")))
    schema = "doc_id long, row long, words array<long>, hits array<struct<hash: long, at: int>>"
    kind = pa.struct([("hash", pa.int64()), ("at", pa.int32())])

    def search(record_batches):
        with common.worker_memory():
            from pyspark import TaskContext

            hasher, bits = WordHasher(), np.unpackbits(table.value).astype(bool)
            row = TaskContext.get().partitionId() << 40  # tells repeated ids apart within this run of the job
            for batch in common.batches(record_batches, "text", HASHED_BYTES):
                words, ends = hasher.hash(batch.column(1))
                found = [np.concatenate(x) for x in zip(*_seeds(words, ends, masks, bits), strict=True)]
                order = np.argsort(found[0], kind="stable")
                text, at, hashes = (x[order] for x in found)
                some, counts = np.unique(text, return_counts=True)
                starts = np.concatenate([[0], ends[:-1]])
                inside = np.concatenate([np.arange(starts[t], ends[t]) for t in some]) if len(some) else np.empty(0, np.int64)
                lengths = ends[some] - starts[some]
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(words[inside].view(np.int64)))
                hits = pa.StructArray.from_arrays([pa.array(hashes), pa.array(at.astype(np.int32))], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), hits)
                ids = batch.column(0).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(row + np.arange(len(some))), rows, lists], names=["doc_id", "row", "words", "hits"])
                row += len(some)

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null and text is not null")
    hit = common.materialise(named.mapInArrow(search, schema), "decontamination-hits")
    met = hit.select("row", F.explode("hits").alias("hit")).select("row", "hit.hash", "hit.at").join(seeds, "hash")
    diagonals = met.select("row", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    # Only the stretch beside the item goes on: an item's length, however long the document.
    aligned = diagonals.join(items, "item_id").join(hit.select("doc_id", "row", "words"), "row")
    begin, skip = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("item_words") - skip, F.size("words") - begin)
    slices = aligned.select(
        "doc_id", "item_id", begin.alias("begin"), F.size("item_words").alias("item_length"),
        F.slice("words", (begin + 1).cast("int"), length.cast("int")).alias("a"), F.slice("item_words", (skip + 1).cast("int"), length.cast("int")).alias("b"),
    )
    agree = slices.select("doc_id", "item_id", "begin", "item_length", F.zip_with("a", "b", lambda a, b: a == b).alias("agree"))

    def verify(record_batches):
        for batch in record_batches:
            rows = [(d, i, s + o[0], o[1] - o[0], o[2], o[2] / n) for d, i, s, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True) for o in [verified(np.array(v, bool), n)] if o]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(columns)], names=["doc_id", "item_id", "doc_start", "n_words", "n_agree", "coverage"])

    found = agree.mapInArrow(verify, "doc_id long, item_id long, doc_start long, n_words long, n_agree long, coverage double")
    best = F.max(F.struct("n_agree", "coverage", -F.col("n_words"), -F.col("doc_start"))).alias("best")
    pairs = found.groupBy("doc_id", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", (-F.col("best.col4")).alias("doc_start"), (-F.col("best.col3")).alias("n_words"), "best.n_agree", "best.coverage")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have no overlap with any item.

    Rows are told apart by a 64-bit hash of id and text, so rows without an id, or with one that others have, are
    judged by their own text; items without an id are searched for as well.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.xxhash64("text")).alias("item_id"), "text")
    leaks = overlaps(keyed, items, id_col="__key").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(leaks.hint("merge"), "__key", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(common.documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
