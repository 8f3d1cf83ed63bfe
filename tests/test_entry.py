import duckdb
import pytest

import __spark_entry__ as entry_point
from geolattice import queries as point_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry_point.entry(spark).count() == 198


@pytest.mark.parametrize("name", sorted(point_queries.oracle_sql()))
def test_against_sql(spark, db, name):
    df = point_queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    rel = db.sql(point_queries.oracle_sql()[name])
    assert sorted(rel.columns) == names
    order = [rel.columns.index(c) for c in names]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, (tuple(r[i] for i in order) for r in rel.fetchall())))


def test_every_query_has_a_name_of_its_own():
    assert set(point_queries.oracle_sql()) <= set(point_queries.queries()) <= set(entry_point.queries())
