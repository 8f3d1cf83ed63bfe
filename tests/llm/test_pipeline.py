import random

import corpus_pipeline
import duckdb
import pytest

from geolattice.llm import queries

from . import fixtures

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(9)
    item = fixtures.prose(rnd, 30)
    rows = [(k, fixtures.prose(rnd, 60, lang) + f"\nRead more on page {k} of this site", lang) for k in range(160) for lang in [rnd.choice(["en", "fr", "de"])]]
    rows += [(200, rows[0][1], "en"), (201, fixtures.prose(rnd, 40) + " " + item, "en"), (202, None, "en"), (203, "12345", None)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns, name
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {200, 201, 202, 203} and len(ids) >= 158 and all("Read more" not in r.text for r in kept.collect())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == ids and out.where("n_tokens <> size(ids)").count() == 0


def test_empty_tables(spark, tmp_path):
    fixtures.no_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = fixtures.odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = db.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() > 0
