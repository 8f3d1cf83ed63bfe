"""Token counts (operator 10): pieces are counted once for each distinct pre-token and joined to frequencies.

No piece of the vocabulary holds a word mark after another character, so no merge crosses the start of a run of
word marks, and the count of a text is the sum of its pre-tokens' counts. Each worker counts a distinct pre-token
once (``encode`` in the library, with only that pre-token), joins the counts to the frequencies of pre-tokens in
each document, and sums. Ids of a document are never built, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of distinct pre-tokens that a worker remembers; it starts anew beyond, so memory stays bounded.
REMEMBERED = 80_000_000
MARK = "▁"


class PieceCounter:
    """Counts the pieces of texts as the library does for a byte-pair model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not self.sp.is_byte(i)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model span words; its counts cannot be summed over pre-tokens")
        self.prefix = self.sp.encode("a", out_type=str)[0].startswith(MARK)
        # A character that no piece of two or more holds is never merged, and so is a pre-token by itself.
        alone = "\n" if not any("\n" in p for p in pieces) else ""
        self.pattern = re.compile(rf"[ {MARK}]*[^ {MARK}{alone}]+|[ {MARK}]+" + (rf"|{alone}" if alone else ""))
        # Message fields that come twice are merged: normalizer_spec (3) { add_dummy_prefix (3): false }.
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        self.counts = common.Remembered(lambda: REMEMBERED)

    def count(self, texts: list[str]) -> list[int]:
        self.counts.make_room()
        known, totals = self.counts, []
        for text in texts:
            if not text:
                totals.append(0)
                continue
            often = Counter(self.pattern.findall(" " + text if self.prefix else text))
            new = [p for p in often if p not in known]
            if new:
                known.learn(new, [*map(len, self.bare.encode(new, num_threads=1))])
            totals.append(sum(n * known[p] for p, n in often.items()))
        return totals


def count_tokens(docs: DataFrame, model_path: str, *, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Add n_bytes, n_tokens (long) and over_limit (n_tokens > limit) to every row of ``docs``.

    A null text counts as an empty one: 0 bytes, 0 tokens. Repeated rows are counted each. An empty table gives an
    empty result. Input columns named like the added ones are replaced.
    """
    import pyarrow as pa

    common.ship(docs.sparkSession)
    model = common.vocabulary(docs.sparkSession, model_path)
    # The text goes to the workers, last, and does not come back.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens", "over_limit")]
    size = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("n_bytes")
    inner = docs.select(*others, size, F.col(f"`{text_col}`").alias("__text"))
    kept = inner.schema.fields[:-1]
    schema = T.StructType([*kept]).add("n_tokens", "long", False)

    def run(record_batches):
        with common.worker_memory("pieces"):
            counter = common.kept_tool("pieces", model.value, PieceCounter)
            for batch in common.batches(record_batches, "__text"):
                totals = counter.count([t or "" for t in batch.column(len(kept)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(totals, pa.int64())], names=[f.name for f in schema.fields])

    return inner.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, common.tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
