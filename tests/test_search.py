import pytest

from brindle.operators import search

CHUNK = "chunk_id bigint, project string, path string, kind string, symbol string, signature string"
VECTOR = "vec_id bigint, embedding array<float>"


def test_null_tie_repeated_and_invalid(spark):
    chunks = spark.createDataFrame([(1, "a", "x/f.cs", None, None, None), (2, "a", "x/f.cs", "Method", "N.Find", "int Find()"), (2, "a", "x/f.cs", "Method", "N.Find", "int Find()"), (3, "a", "find/g.cs", "Method", "B", None)], CHUNK)
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (1, [float("nan"), 1.0]), (9, None)], VECTOR)
    assert [(r.chunk_id, r.rank) for r in search.vector_branch(search.candidates(chunks), vectors, [1.0, 0.0], 5).collect()] == [(2, 1), (3, 2)]
    assert [(r.chunk_id, r.band) for r in search.symbol_branch(search.candidates(chunks), "FIND", 5).collect()] == [(2, 5), (3, 1)]
    assert search.symbol_branch(chunks, "  ", 5).isEmpty()


def test_a_file_has_two_places_before_the_backfill(spark):
    chunks = spark.createDataFrame([(i, "a", "f.cs" if i < 4 else "g.cs", "Method", "S", "") for i in range(5)], CHUNK)
    fused = spark.createDataFrame([(i, 1.0 - i / 10, False, i + 1) for i in range(5)], "chunk_id bigint, score double, exempt boolean, rank int")
    assert {r.chunk_id for r in search.diversify(fused, chunks, 3).collect()} == {0, 1, 4}
    assert {r.chunk_id for r in search.diversify(fused, chunks, 4).collect()} == {0, 1, 2, 4}


def test_empty_tables(spark):
    assert search.hybrid_search(spark.createDataFrame([], CHUNK), spark.createDataFrame([], VECTOR), [1.0, 0.0], "x", 5).isEmpty()
    with pytest.raises(ValueError):
        search.hybrid_search(spark.createDataFrame([], CHUNK), spark.createDataFrame([], VECTOR), [1.0], "x", -1)
