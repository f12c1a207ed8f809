"""The registered queries, on the smallest tables."""

import duckdb
import pytest

from brindle.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["project", "path"],
    "p2_found": ["vec_id_a", "vec_id_b"],
    "p4_found": ["project", "path", "start_line", "symbol"],
    "p5_found": ["chunk_id"],
    "p6_ids": ["doc_id", "ids"],
    "p7_containers": ["target", "container", "position", "doc_id", "part", "start_token", "end_token", "n_tokens", "capacity"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered(spark, name):
    got = queries.queries()[name](spark, DATA)
    assert got.columns == COLUMNS[name]
    assert got.count() > 0


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("source_files", "chunks", "split_limits"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = sorted(con.execute(queries.oracle_sql()["p5_found"]).fetchall())
    assert sorted(map(tuple, queries.queries()["p5_found"](spark, DATA).collect())) == want


def test_every_document_is_encoded(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.queries()["p6_ids"](spark, DATA)
    assert got.count() == docs.count()
    assert got.join(docs.filter("coalesce(text, '') = ''"), "doc_id").filter("size(ids) > 0").isEmpty()
