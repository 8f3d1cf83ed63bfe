"""Substring dedup (operator 7): MinHash banding of paragraphs.

Paragraphs are what blank lines part, or line breaks in texts without blank lines. Those of enough words are banded
by MinHash of their five-word shingles; paragraphs that collide in a band are verified by exact Jaccard, all pairs of
a bucket. A crowded bucket is not paired out: its members are dealt into blocks, and a row of two blocks has all their
pairs verified at once, by a product of matrices; out come only as many links as connect what all of these pairs would.
Similar paragraphs make up clusters, by connected components.

Passages repeat inside longer paragraphs and across them too. So every text is also cut into windows of ``WINDOW`` words
that begin at anchors chosen by content (the least trigram hash of each run of ``RUN`` trigrams): a passage of WINDOW +
RUN - 1 words has the same windows wherever it stands. Equal windows are a cluster. In each cluster the document with
the least id keeps its piece, the others have it removed.

Documents are read twice. The first pass counts keys and finds those of several documents; a bit table of bounded size,
made from these, lets the second pass send on only pieces that may collide.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .decontamination import WordHasher, bit_table, in_table, normalise

#: Words of a window, and trigrams of which one is an anchor: passages of 51 words are surely caught.
WINDOW, RUN = 44, 8
#: Words that a paragraph has at least (the query's value; fewer find shorter ones, down to a shingle).
LEAST = 51
SHINGLE, SIMILAR = 5, 0.8
#: Bands and rows: paragraphs at the least similarity collide with a chance of 98.5 %.
BANDS, ROWS = 8, 4
#: Different paragraphs in a bucket above which they are not paired out, but verified in blocks; about how many members
#: and shingles a block has at most; how many blocks of a bucket one task takes with all others; columns of a product.
CROWDED, BLOCK_MEMBERS, BLOCK_SHINGLES, SPREAD, PRODUCT = 24, 512, 32_768, 8, 4096
HASHED_BYTES = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURNS = [np.uint64((2 * k + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) for k in range(BANDS * ROWS)]


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each position."""
    size = max(0, len(words) - n + 1)
    out = np.full(size, np.uint64(n), np.uint64)
    for k in range(n):
        out *= _ODD
        out += words[k : k + size]
        out ^= out >> np.uint64(31)
    return out


def anchors(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of anchors; every run inside one text has one. Ties go by position modulo RUN."""
    grams = _rolled(words, 3)
    if len(grams) < RUN:
        return np.empty(0, np.int64)
    place = np.arange(len(grams))
    least = (grams & ~np.uint64(63)) | (place % RUN).astype(np.uint64)
    width = 1
    while width < RUN:  # least of ever wider runs
        step = min(width, RUN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    start = np.arange(len(least))
    text = np.searchsorted(ends, start, side="right")
    inside = start + RUN + 2 <= ends[text]
    start, least = start[inside], least[inside]
    return np.unique(start + ((least & np.uint64(63)).astype(np.int64) - start) % RUN)


def windows(words: np.ndarray, ends: np.ndarray):
    """(text, position in it, content hash) of the windows of a batch of texts."""
    at = anchors(words, ends)
    starts = np.concatenate([[0], ends[:-1]])
    # Every text that is long enough has a window at its start and one at its end, wherever its anchors are.
    enough = ends - starts >= WINDOW
    at = np.unique(np.concatenate([at, starts[enough], ends[enough] - WINDOW]))
    text = np.searchsorted(ends, at, side="right")
    inside = at + WINDOW <= (ends[text] if len(at) else at)
    at, text = at[inside], text[inside]
    grams = _rolled(words, WINDOW // 4)
    content = np.full(len(at), np.uint64(WINDOW), np.uint64)
    for k in range(0, WINDOW, WINDOW // 4):
        content = (content ^ grams[at + k]) * _ODD if len(at) else content
        content ^= content >> np.uint64(29)
    return text, at - starts[text], content


def blocks(counts: np.ndarray, lines: np.ndarray, least: int):
    """(text, first word in the batch, number of words) of paragraphs, from the words of each line and lines of texts.

    Lines without a word part paragraphs in texts that have such a line between others; else every line is one.
    """
    text = np.repeat(np.arange(len(lines)), lines)
    end = np.cumsum(counts)
    real = np.flatnonzero(counts)
    if not len(real):
        return (np.empty(0, np.int64),) * 3
    mine = text[real]
    same = mine[1:] == mine[:-1]
    gap = same & (real[1:] - real[:-1] > 1)
    parted = np.zeros(len(lines), bool)
    parted[mine[1:][gap]] = True
    begins = np.concatenate([[True], ~same | gap | ~parted[mine[1:]]])
    first = np.flatnonzero(begins)
    start = (end - counts)[real[first]]
    stop = end[real[np.concatenate([first[1:] - 1, [len(real) - 1]])]]
    long = stop - start >= max(least, SHINGLE)
    return mine[first][long], start[long], (stop - start)[long]


def minhashes(words: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(content hash, band keys, shingles, where those of each begin) of paragraphs that lie one after another."""
    sizes = size - SHINGLE + 1
    begin = np.cumsum(sizes) - sizes
    if not len(start):
        return np.empty(0, np.uint64), [np.empty(0, np.uint64)] * BANDS, np.empty(0, np.uint64), begin
    place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    shingles = _rolled(words, SHINGLE)[place + np.repeat(start, sizes)]
    mixed = (shingles ^ (place.astype(np.uint64) * _TURNS[1])) * _ODD
    mixed ^= mixed >> np.uint64(31)
    content = np.add.reduceat(mixed * _TURNS[2], begin) ^ size.astype(np.uint64)
    keys = []
    for band in range(BANDS):
        key = np.full(len(start), np.uint64(band + 1), np.uint64)
        for row in range(ROWS):
            mixed = shingles * _TURNS[band * ROWS + row]
            mixed ^= mixed >> np.uint64(32)
            mixed *= _ODD
            key = (key ^ np.minimum.reduceat(mixed, begin)) * _ODD
            key ^= key >> np.uint64(30)
        keys.append(key)
    return content, keys, shingles, begin


def _pieces(hasher: WordHasher, texts, least: int):
    """(words, ends, paragraphs as ``blocks`` gives them) of an Arrow array of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lines = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
    number = lines.value_lengths().to_numpy(zero_copy_only=False)
    words, line_ends = hasher.hash(lines.flatten())
    counts = np.diff(np.concatenate([[0], line_ends]))
    ends = line_ends[np.cumsum(number) - 1] if len(number) else line_ends
    return words, ends, blocks(counts, number, least)


def _named(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.select("doc_id", F.xxhash64("text").alias("body"), "text")


def _recurrent_keys(docs: DataFrame, least: int, held: list[DataFrame]) -> DataFrame:
    """Keys (band keys of paragraphs, contents of windows) of two documents or more."""
    import pyarrow as pa

    def run(record_batches):
        with common.worker_memory():
            hasher = WordHasher()
            for batch in common.batches(record_batches, "text", HASHED_BYTES):
                words, ends, (text, start, size) = _pieces(hasher, batch.column(2), least)
                content, keys, *_ = minhashes(words, start, size)
                found = windows(words, ends)
                rows = np.concatenate([found[0], *[text] * BANDS])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate([found[2], *keys]).view(np.int64))], names=["doc_id", "key"])

    each = docs.mapInArrow(run, "doc_id long, key long")
    found = each.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return common.materialise(found.where("first <> last").select("key"), "passage-keys", held)


def _colliding(docs: DataFrame, keys: DataFrame, least: int, held: list[DataFrame]) -> DataFrame:
    """doc_id, body, at, n, content of pieces that the bit table does not rule out; keys and shingles of paragraphs."""
    import pyarrow as pa

    table = docs.sparkSession.sparkContext.broadcast(np.packbits(bit_table(keys, "key")))
    names = ["doc_id", "body", "at", "n", "content", "keys", "shingles"]

    def run(record_batches):
        with common.worker_memory():
            hasher, bits = WordHasher(), np.unpackbits(table.value).astype(bool)
            for batch in common.batches(record_batches, "text", HASHED_BYTES):
                words, ends, (text, start, size) = _pieces(hasher, batch.column(2), least)
                at_text, at, content = windows(words, ends)
                may = np.flatnonzero(in_table(bits, content))
                columns = [batch.column(k).take(pa.array(at_text[may])) for k in (0, 1)] + [pa.array(x) for x in (at[may], np.full(len(may), WINDOW), content[may].view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(may), pa.list_(pa.int64()))] * 2], names=names)
                content, keys, shingles, begin = minhashes(words, start, size)
                may = np.flatnonzero(np.logical_or.reduce([in_table(bits, k) for k in keys]))
                begins = np.concatenate([[0], ends[:-1]])
                columns = [batch.column(k).take(pa.array(text[may])) for k in (0, 1)] + [pa.array(x) for x in (start[may] - begins[text[may]], size[may], content[may].view(np.int64))]
                lengths = size[may] - SHINGLE + 1
                flat = np.concatenate([shingles[begin[k] : begin[k] + n] for k, n in zip(may.tolist(), lengths.tolist(), strict=True)]) if len(may) else shingles[:0]
                banded = np.stack(keys, axis=1)[may].reshape(-1)
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v.view(np.int64))) for o, v in ((np.arange(len(may) + 1) * BANDS, banded), (np.concatenate([[0], np.cumsum(lengths)]), flat))]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=names)

    return common.materialise(docs.mapInArrow(run, "doc_id long, body long, at long, n long, content long, keys array<long>, shingles array<long>"), "passage-candidates", held)


def _alike(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingles have a Jaccard similarity of SIMILAR or more."""
    one = distinct.select(F.col("content").alias("a"), F.col("shingles").alias("left"))
    other = distinct.select(F.col("content").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    joined = pairs.join(one, "a").join(other, "b").withColumn("both", both)
    return joined.where(F.col("both") >= SIMILAR * (F.size("left") + F.size("right") - F.col("both"))).select("a", "b")


def block_links(left: tuple, right: tuple):
    """(a, b) that connect what all similar pairs of two blocks connect; a block: (contents, sizes, shingles one after
    another, without repeats in a member). Shingles of both blocks alone can agree, so one product counts these."""
    (one, sizes, shingles), (other, others, more) = left, right
    owner, holder = np.repeat(np.arange(len(one)), sizes), np.repeat(np.arange(len(other)), others)
    shared = np.intersect1d(shingles, more)
    at, place = np.searchsorted(shared, shingles), np.searchsorted(shared, more)
    here, there = np.flatnonzero(np.isin(shingles, shared)), np.flatnonzero(np.isin(more, shared))
    both = np.zeros((len(one), len(other)), np.float32)
    for start in range(0, len(shared), PRODUCT):
        grids = []
        for rows, columns, chosen, height in ((owner, at, here, len(one)), (holder, place, there, len(other))):
            some = chosen[(columns[chosen] >= start) & (columns[chosen] < start + PRODUCT)]
            grids.append(np.zeros((height, min(PRODUCT, len(shared) - start)), np.float32))
            grids[-1][rows[some], columns[some] - start] = 1
        both += grids[0] @ grids[1].T
    agree = both.astype(np.float64)
    alike = agree >= SIMILAR * (sizes[:, None] + others[None, :] - agree)
    a, b = [], []
    rows, columns = alike.any(axis=1), alike.any(axis=0)  # those to be reached yet
    while rows.any():
        first = int(rows.argmax())
        found = np.array([first])
        rows[first] = False
        while len(found):  # by turns to the other side and back
            met = np.flatnonzero(alike[found].any(axis=0) & columns)
            columns[met] = False
            b.append(other[met])
            found = np.flatnonzero(alike[:, met].any(axis=1) & rows)
            rows[found] = False
            b.append(one[found])
            a.append(np.full(len(met) + len(found), one[first]))
    return (np.concatenate(a), np.concatenate(b)) if a else (one[:0], other[:0])


def _crowd_links(crowd: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect what all similar pairs of each of the crowded buckets (key, content, size) connect.

    Members are dealt into blocks by their content, and each block meets each other one of its bucket in one row; blocks
    of large buckets are spread over tasks.
    """
    import pyarrow as pa

    session = crowd.sparkSession
    common.ship(session)
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    number = F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS))
    dealt = crowd.join(crowd.groupBy("key").agg(number.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("content", F.lit(7)), F.col("blocks")))
    rows = dealt.drop("size").join(distinct.select("content", "shingles"), "content")
    blocks = rows.groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("content", "shingles")).alias("m"))
    blocks = blocks.select("key", "block", F.ceil(F.col("blocks") / SPREAD).alias("shares"), F.col("m.content").alias("contents"), F.transform("m.shingles", F.size).alias("sizes"), F.flatten("m.shingles").alias("shingles"))
    left = blocks.withColumn("share", F.pmod("block", "shares")).repartition(parts, "key", "share")
    right = blocks.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).repartition(parts, "key", "share")
    columns = [F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in "xy" for name in ("contents", "sizes", "shingles")]
    paired = left.alias("x").join(right.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.share") == F.col("y.share")) & (F.col("x.block") <= F.col("y.block"))).select(*columns)

    def run(record_batches):
        with common.worker_memory():
            for batch in record_batches:
                for row in range(batch.num_rows):
                    x, y = ([batch.column(k)[row].values.to_numpy(zero_copy_only=False) for k in range(at, at + 3)] for at in (0, 3))
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in block_links(x, y)], names=["a", "b"])

    return paired.mapInArrow(run, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_paragraphs(distinct: DataFrame, held: list[DataFrame]) -> DataFrame:
    """Links (a, b) between paragraphs (content, keys, shingles without repeats): all of small buckets; of crowded ones,
    as many as connect what all of them would, with no pair of a bucket left out."""
    members = distinct.select(F.explode("keys").alias("key"), "content", F.size("shingles").alias("size"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    members = common.materialise(members.join(sizes, "key"), "passage-buckets", held)
    few = members.where(F.col("many") <= CROWDED).select("key", "content", "size")
    pairs = few.alias("x").join(few.alias("y"), "key").where("x.content < y.content and least(x.size, y.size) >= 0.8 * greatest(x.size, y.size)")
    pairs = pairs.select(F.col("x.content").alias("a"), F.col("y.content").alias("b")).distinct()
    edges = common.materialise(_alike(pairs, distinct), "passage-edges", held)
    crowd = members.where(F.col("many") > CROWDED).select("key", "content", "size")
    return edges.union(common.materialise(_crowd_links(crowd, distinct), "passage-crowds", held)).distinct()


def repeated_paragraphs(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """doc_id, body (hash of the text), at (word), n (words), cluster_id, keeper (doc_id): every piece, paragraph or
    window, of a cluster over two documents or more.

    Null texts and texts of under ``least`` words have none, but for windows; rows without doc_id are left out, as no
    result could name them; rows with the same doc_id count as one document; repeats inside one document are none
    across documents. An empty table gives an empty result.
    """
    common.ship(docs.sparkSession)
    docs = _named(docs)
    held: list[DataFrame] = []
    keys = _recurrent_keys(docs, least, held)
    found = _colliding(docs, keys, least, held)
    chosen = found.where("keys is not null").groupBy("content").agg(F.any_value("keys").alias("keys"), F.array_distinct(F.any_value("shingles")).alias("shingles"))
    distinct = common.materialise(chosen, "passage-distinct", held)
    joined = common.connected_components(similar_paragraphs(distinct, held), "passage-components")
    # Everything but the last join is on different contents, so copies cost nothing.
    contents = found.groupBy("content").agg(F.count(F.lit(1)).alias("many"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    named = contents.join(joined.withColumnRenamed("node", "content"), "content", "left").withColumn("cluster_id", F.coalesce("component", "content"))
    named = common.materialise(named.drop("component"), "passage-contents", held)
    spread = named.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("many"), F.min("first").alias("keeper"), F.max("last").alias("last")).where("keeper <> last")
    kept = common.join_hot(named.drop("first", "last").withColumnRenamed("many", "rows"), spread.select("cluster_id", "many", "keeper"), "cluster_id", held)
    kept = common.materialise(kept.select("content", F.col("rows").alias("many"), "cluster_id", "keeper"), "passage-clusters", held)
    members = common.join_hot(found.select("doc_id", "body", "at", "n", "content"), kept, "content", held)
    members = common.materialise(members.select("doc_id", "body", "at", "n", "cluster_id", "keeper").distinct(), "passage-members")
    common.discard_all(held)
    return members


def _passages(docs: DataFrame, least: int) -> DataFrame:
    rows = repeated_paragraphs(docs, least=least).withColumn("removed", F.col("doc_id") != F.col("keeper")).withColumn("end", F.col("at") + F.col("n"))
    order = Window.partitionBy("doc_id", "body", "removed").orderBy("at", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("at") > F.max("end").over(before), F.lit(True)).cast("int")
    numbered = rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "body", "removed", "island").agg(
        F.min("at").alias("start_word"), (F.max("end") - F.min("at")).alias("n_words"), F.min("cluster_id").alias("cluster_id"), F.min("keeper").alias("keeper_doc_id")
    )


def repeated_passages(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """doc_id, start_word, n_words, cluster_id, keeper_doc_id, removed: pieces that touch are one passage.

    ``cluster_id`` is the least of a passage's clusters, ``keeper_doc_id`` the least document that holds any of it;
    a passage is removed where its pieces have an earlier keeper. Words are those with a letter or digit. Rows with
    the same doc_id and other texts have passages of their own; those of equal rows come once.
    """
    return _passages(docs, least).select("doc_id", "start_word", "n_words", "cluster_id", "keeper_doc_id", "removed")


def remove_passages(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """``docs`` with removed passages cut out of ``text`` (n_chars is made to fit); other rows stay as they are.

    Rows go by id and text: another row with the same id is cut where its own text has passages.
    """
    cuts = _passages(docs, least).where("removed").groupBy("doc_id", "body").agg(F.collect_list(F.struct("start_word", "n_words")).alias("__cuts"))
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"), "__cuts")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, places):
            if text is None or places is None:
                return text
            words = [m for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text) if normalise(m.group())]
            keep, at = [], 0
            for place in sorted(places, key=lambda p: p["start_word"]):
                begin, end = words[place["start_word"]].start(), words[place["start_word"] + place["n_words"] - 1].end()
                keep.append(text[at : max(at, begin)])
                at = max(at, end)
            return "".join(keep) + text[at:]

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    marked = docs.withColumn("__key", F.xxhash64("text"))
    joined = marked.join(cuts, (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__key") == F.col("__body")), "left").withColumn("text", cut("text", "__cuts"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__cuts").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(common.documents(spark, sf_dir).select("doc_id", "text"))
