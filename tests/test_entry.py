"""The entry file and every registered query of the core against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as e
from brindle.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = ("chunks", "documents", "fingerprints", "index_headers", "index_vectors", "projects", "source_files")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_the_entry_file_has_the_core(spark):
    assert set(queries.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA)
    want = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(repr(r) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == rows
    assert rows
