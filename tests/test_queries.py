import os

import duckdb
import pytest

import __spark_entry__ as entry
from gradloom import oracle, queries

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def table(arrow):
    names = sorted(arrow.column_names)
    return names, sorted(tuple(map(repr, r)) for r in zip(*(arrow[n].to_pylist() for n in names), strict=True))


@needs_data
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_gives_what_the_sql_says(spark, db, name):
    got, want = queries.queries()[name](spark, DATA).toArrow(), db.sql(oracle.oracle_sql()[name]).to_arrow_table()
    assert table(got) == table(want)
    # Too few epochs here for a tracker to fire; tests of the trackers have longer traces.
    assert got.num_rows or name in ("convergence_epoch", "switch_epoch")


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_other_queries_run_twice_alike(spark, name):
    run = queries.queries()[name]
    one, two = run(spark, DATA).collect(), run(spark, DATA).collect()
    assert one and sorted(map(repr, one)) == sorted(map(repr, two))


@needs_data
def test_entry(spark):
    assert entry.entry(spark).filter("kind = 'loss'").count() == 16


def test_registry():
    assert set(oracle.oracle_sql()) <= set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
