"""From documents to token ids, in five stages; each reads all that the one before it kept, as written Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm import common, decontamination, language_id, line_templates, simhash, word_bpe


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, trained on labelled ones of them, accepts."""
    predicted = language_id.identify(docs, language_id.train(docs))
    return predicted.where("accepted").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of templates that recur across them."""
    return line_templates.drop_recurrent_lines(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id."""
    return simhash.keep_one(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.remove_leaks(docs, benchmark).select(*(F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    coded = word_bpe.encode(docs.select("doc_id", "text"), common.tokenizer_path("word_bpe_49k.json"), keep_text=False)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

#: Models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage was read from is deleted once the stage is written."""
    docs, written = common.documents(spark, sf_dir), []
    for name, stage in STAGES:
        before, written = written, []
        with common.scratch():
            docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", written)
        common.discard_all(before)
    return docs
