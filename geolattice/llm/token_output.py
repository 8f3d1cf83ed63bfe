"""Token-ID output (operator 5): encode documents and write their ids as Simple-8b shards, in order of doc_id.

Documents are dealt out by ranges of doc_id and sorted there; each task encodes its range and makes shards of whole
documents. Spark's own file writer puts each shard into a file of the shared folder, with its commit protocol, so
lost tasks leave nothing behind and any file system that Spark knows will do. A text chunk that begins with a single
space is a pre-token boundary of byte-level BPE, so each distinct chunk is split once, and the library encodes each
distinct pre-token once.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import chain, compress

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simple8b
from .word_bpe import _BYTES

#: Ids in a shard, but for a longer document, which is not cut.
SHARD_IDS = 1 << 21
#: Bytes of chunks and of pre-tokens that a worker remembers, half of it each; either starts anew beyond.
REMEMBERED = 80_000_000
#: Text bytes that are encoded at once, about: the more, the fewer distinct chunks to each of them.
ENCODED_BYTES = 12_000_000
#: What Spark's writer puts after each record; read_shard ignores it.
END = "S8BEND\n"
#: Stands in front of a text, and behind a chunk; a text that holds it goes to the library as a whole.
_FIRST = "\x00"
_BETWEEN = _FIRST + " "
#: Letters of plain chunks, letters and digits in any version of Unicode, and what byte-level pre-tokenisers make of these.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e"
_ODD = re.compile(f"[^\\n\x00 -~{_LETTERS}]")
_PLAIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\n\x00 0-9{_LETTERS}]+|\\n+(?![^\\n\x00])|\\n|\x00(?: \x00)?")
#: How a vocabulary of bytes writes each of them.
_ALPHABET = np.array([_BYTES.get(b, b) for b in range(256)], "<u2")
#: Ends a chunk's ids: no id of a vocabulary.
_STOP = 0xFFFFFFFF
#: Where a space stands beside another or a line break, and the rarer white space.
_BESIDE = ("  ", " \n", "\n ")
_RARE = tuple(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n") + ("\u180e", "\u200b", "\ufeff")


class Known:
    """Ids of parts of texts, in Arrow and numpy: no Python object for each part. Beyond ``most()`` bytes it starts anew."""

    def __init__(self, most, stops=()):
        self.most, self.stops = most, stops
        self.clear()

    def clear(self) -> None:
        import pyarrow as pa

        self.parts = pa.array(self.stops, pa.large_string())
        self.ids, self.lengths = np.full(len(self.stops), _STOP, "<u4"), np.ones(len(self.stops), np.int32)

    def make_room(self) -> None:
        if self.parts.nbytes + self.ids.nbytes + self.lengths.nbytes > self.most():
            self.clear()

    def places(self, parts) -> np.ndarray:
        """The number of each of these distinct parts, -1 where it is not known."""
        import pyarrow.compute as pc

        # The table to look up in is of the distinct parts of a batch, which are fewer than those known.
        at, out = pc.index_in(self.parts, value_set=parts), np.full(len(parts), -1, np.int64)
        out[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        return out

    def learn(self, parts, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers of new parts, whose ids lie one after another."""
        import pyarrow as pa

        first = len(self.parts)
        self.parts = pa.concat_arrays([self.parts, parts])
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths.astype(np.int32)])
        return np.arange(first, len(self.parts))

    def spread(self, places: np.ndarray):
        return common.spread(places, self.ids, self.lengths.astype(np.int64))


class ByteLevelEncoder:
    """The library's ids of whole texts, as little-endian uint32 numbers; each distinct pre-token is encoded once."""

    def __init__(self, source: bytes):
        import json

        from tokenizers import Tokenizer

        spec = json.loads(source)
        self.tok = Tokenizer.from_str(source.decode("utf-8"))
        self.tok.no_truncation()
        self.tok.no_padding()
        pre = spec.get("pre_tokenizer") or {}
        strips = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] for t in spec.get("added_tokens", []))
        #: Whether a text may be cut at single spaces; else the library gets whole texts.
        self.cuts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not strips
        #: The special strings of the vocabulary, which are found before anything else.
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        #: The ids of chunks, and of the pre-tokens of new ones.
        self.chunks = Known(lambda: REMEMBERED // 2)
        self.words = Known(lambda: REMEMBERED // 2, [_FIRST, _BETWEEN + _FIRST])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Distinct chunks are found in Arrow, and only new ones are encoded."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        plain, rest = [], []
        for i, t in enumerate(texts):
            if t:
                (plain if self.cuts and not self._odd(t) else rest).append(i)
        if plain:
            # A mark in front of a text tells its first chunk, which no space precedes, from the others.
            lists = pc.split_pattern(pa.array([_FIRST + texts[i] for i in plain], pa.large_string()), " ")
            coded = lists.flatten().dictionary_encode()
            place = self._places(coded.dictionary)
            ids, ends = self.chunks.spread(place[coded.indices.to_numpy()])
            bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()].tolist()
            for k, i in enumerate(plain):
                out[i] = ids[bounds[k] : bounds[k + 1]]
        # White space in runs: the library gets whole texts.
        for i, code in zip(rest, self._library([texts[i] for i in rest]), strict=True):
            out[i] = np.frombuffer(code, "<u4")
        return out

    def _places(self, parts) -> np.ndarray:
        """The number of each distinct chunk; Python touches new ones only."""
        import pyarrow as pa

        self.chunks.make_room()
        self.words.make_room()
        place = self.chunks.places(parts)
        new = np.flatnonzero(place < 0)
        if len(new):
            order, ids, lengths = self._split(parts.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
            new = new[order]
            place[new] = self.chunks.learn(parts.take(pa.array(new)), ids, lengths)
        return place

    def _split(self, parts: list[str]):
        """(order, ids, number of ids) of new chunks: ids lie one after another, in this order of the chunks."""
        import pyarrow as pa

        # Chunks with the space before them, between marks; the first one of a text has a mark in that space's place.
        joined = _BETWEEN + _BETWEEN.join(parts) + _FIRST
        odd = {m.start() for m in _ODD.finditer(joined)}
        for string in self.special:
            at = joined.find(string)
            while at >= 0:
                odd.add(at)
                at = joined.find(string, at + 1)
        plain = np.ones(len(parts), bool)
        if odd:
            ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + len(_BETWEEN))
            plain[np.searchsorted(ends, np.array([*odd]), side="right")] = False
            joined = _BETWEEN + _BETWEEN.join(compress(parts, plain)) + _FIRST if plain.any() else _FIRST
        coded = pa.array(_PLAIN.findall(joined), pa.large_string()).dictionary_encode()
        place = self.words.places(coded.dictionary)
        new = np.flatnonzero(place < 0)
        if len(new):
            words = coded.dictionary.take(pa.array(new))
            place[new] = self.words.learn(words, *self._encode(words.to_numpy(zero_copy_only=False).tolist()))
        ids, _ = self.words.spread(place[coded.indices.to_numpy()])
        ending = ids == _STOP
        lengths, ids = np.diff(np.flatnonzero(ending)) - 1, ids[~ending]
        if odd:
            more = self._library([p[1:] if p[0] == _FIRST else " " + p for p in compress(parts, ~plain)])
            ids = np.concatenate([ids, np.frombuffer(b"".join(more), "<u4")])
            lengths = np.concatenate([lengths, np.fromiter(map(len, more), np.int64, len(more)) // 4])
        return np.argsort(~plain, kind="stable"), ids, lengths

    def _encode(self, words: list[str]):
        """(ids, number of ids) of plain pre-tokens: the library's model takes them in the byte alphabet, without splitting."""
        tokenize = self.tok.model.tokenize
        names = _ALPHABET[np.frombuffer(_FIRST.join(words).encode(), np.uint8)].tobytes().decode("utf-16-le").split(chr(_ALPHABET[ord(_FIRST)]))
        codes = [[t.id for t in tokenize(name)] for name in names]
        lengths = np.fromiter(map(len, codes), np.int64, len(codes))
        return np.fromiter(chain.from_iterable(codes), "<u4", int(lengths.sum())), lengths

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether a space may stand beside white space, or at an end: then spaces alone do not bound pre-tokens."""
        return _FIRST in text or text[0] in " \n" or text[-1] == " " or any(s in text for s in _BESIDE) or any(s in text for s in _RARE)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]


def encoder(source: bytes) -> ByteLevelEncoder:
    return common.kept_tool("bytes", source, ByteLevelEncoder)


def _gathered(batches):
    """(doc_ids, texts) of as many batches as have ENCODED_BYTES together."""
    numbers, texts, size = [], [], 0
    for batch in batches:
        numbers += batch.column(0).to_pylist()
        texts += [t or "" for t in batch.column(1).to_pylist()]
        size += batch.column(1).nbytes
        if size >= ENCODED_BYTES:
            yield numbers, texts
            numbers, texts, size = [], [], 0
    if numbers:
        yield numbers, texts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every text, ``end_id`` after each document, as shards in ``path``, in ascending doc_id order.

    Null doc_ids come first and stay null; rows with the same doc_id follow in the order of their texts. A null
    text counts as an empty one: only the end id. An empty table writes no shard. Other columns are not read.
    """
    import os

    import pyarrow as pa

    common.ship(docs.sparkSession)
    source = common.vocabulary(docs.sparkSession, tokenizer)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    def run(record_batches):
        with common.worker_memory("bytes"):
            import os as worker_os

            from pyspark import TaskContext

            worker_os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            tool, part, shard = encoder(source.value), TaskContext.get().partitionId(), 0
            end = np.array([end_id], "<u4")
            ids, coded, size = [], [], 0

            def flush():
                lengths = np.array([len(c) + 1 for c in coded[::2]])
                data = simple8b.write_shard(part, shard, ids, lengths, np.concatenate(coded))
                return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["shard"])

            for numbers, texts in _gathered(common.batches(record_batches, "text", ENCODED_BYTES)):
                for doc_id, code in zip(numbers, tool.encode(texts), strict=True):
                    if ids and size + len(code) + 1 > shard_ids:
                        yield flush()
                        ids, coded, size, shard = [], [], 0, shard + 1
                    ids.append(doc_id)
                    coded += [code, end]
                    size += len(code) + 1
            if ids:
                yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(run, "shard binary")
    shards.select(F.col("shard").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark, path: str, *, with_ids: bool = False) -> DataFrame:
    """Read shards back: part, shard, doc_id, local_start (ids of the shard before it), n_tokens, ids_crc32[, ids]."""
    import pyarrow as pa

    common.ship(spark)
    schema = "part long, shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(record_batches):
        with common.worker_memory():
            for batch in record_batches:
                for data in batch.column(0):
                    if not len(data.as_buffer()):
                        continue
                    part, shard, doc_ids, lengths, ids = simple8b.read_shard(data.as_buffer())
                    plain, stops = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                    starts = stops - lengths
                    crcs = [zlib.crc32(plain[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                    columns = [pa.array([x] * len(doc_ids), pa.int64()) for x in (part, shard)]
                    columns += [pa.array(x, pa.int64()) for x in (doc_ids, starts, lengths, crcs)]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, stops], pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before, over all shards. Sums are by shard, then by part."""
    sizes = rows.groupBy("part", "shard").agg(F.sum("n_tokens").alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("part_size"))
    # One row for each part of the job, however many documents there are.
    before = parts.select("part", (F.sum("part_size").over(Window.orderBy("part")) - F.col("part_size")).alias("part_start"))
    inside = sizes.withColumn("shard_start", F.sum("size").over(Window.partitionBy("part").orderBy("shard")) - F.col("size"))
    starts = inside.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    return rows.join(starts, ["part", "shard"]).withColumn("start", F.col("shard_start") + F.col("local_start"))


def op5_token_output(spark, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "tokens")
    write_tokens(common.documents(spark, sf_dir), path, common.tokenizer_path("byte_bpe_50k.json"))
    rows = common.materialise(read_tokens(spark, path), "tokens-read")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
