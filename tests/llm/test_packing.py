import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, packing

TARGETS = "target string, tokenizer string, capacity int"
DOCS = "doc_id bigint, text string"


def check(spark, docs, targets):
    """Every document once and whole, unless longer than the capacity; no container beyond it."""
    rows = packing.containers(docs, targets).collect()
    sizes = {r.doc_id: r.n_tokens for r in bpe.token_counts(docs).collect()}
    for target in {r.target for r in rows}:
        own = [r for r in rows if r.target == target]
        capacity = own[0].capacity
        parts, filled = {}, {}
        for r in own:
            parts.setdefault(r.doc_id, []).append((r.start_token, r.end_token))
            filled[r.container] = filled.get(r.container, 0) + r.n_tokens
        assert set(parts) == set(sizes) and max(filled.values()) <= capacity
        for d, p in parts.items():
            p.sort()
            assert p[0][0] == 0 and p[-1][1] == sizes[d] and all(a[1] == b[0] for a, b in zip(p, p[1:], strict=False))
            assert len(p) == 1 if sizes[d] <= capacity else len(p) == -(-sizes[d] // capacity)
    return rows


def test_tables(spark):
    docs, targets = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "pack_targets"))
    check(spark, docs, targets)
    assert all(r.filled > 0.95 for r in packing.fill_rates(docs, targets).collect())


def test_small_shards_and_copies(spark, monkeypatch):
    """A third of the documents are copies; keys and copies go beyond a shard's size."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    texts = ["the tide turned at noon"] * 60 + [f"ledger {i % 7} of berth {i} holds {i * i} crates" for i in range(110)] + [None, "", "x " * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = check(spark, docs, spark.createDataFrame([("a", "byte_bpe_50k", 64), ("b", "byte_bpe_50k", 128)], TARGETS))
    assert len({r.container >> 24 for r in rows}) >= 8


def test_neighbours_share_containers(spark):
    """Documents on one subject lie together more often than chance has it."""
    words = ["tide moon harbour pier", "ledger invoice tariff quota", "pump valve pressure meter", "orchard apple harvest crate"]
    docs = spark.createDataFrame([(i, f"{words[i % 4]} {words[i % 4]} {i}") for i in range(200)], DOCS)
    rows = packing.containers(docs, spark.createDataFrame([("a", "byte_bpe_50k", 100)], TARGETS)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.container, []).append(r.doc_id % 4)
    same = sum(max(map(v.count, v)) for v in by.values()) / len(rows)
    assert same > 0.7


def test_shards():
    import numpy as np

    first, parts = packing.assign_shards(np.array([3000, 500, 900, 0, 9000, 10]), np.zeros(6))
    assert parts.tolist() == [1, 1, 1, 1, 3, 1]
    assert first.tolist()[:3] == [0, 0, 1] and first[4] == 2 and first[5] == 5


@pytest.mark.parametrize("docs, targets", [([], [("a", "byte_bpe_50k", 8)]), ([(1, "x")], []), ([(1, "x")], [("a", "byte_bpe_50k", None), ("b", "byte_bpe_50k", 0)])])
def test_nothing(spark, docs, targets):
    assert packing.containers(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)).isEmpty()


def test_repeated_and_clashing(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (2, "other text"), (None, "d")], DOCS).withColumns({"ids": F.lit(1), "shard": F.lit(2), "target": F.lit("t")})
    rows = packing.containers(docs, spark.createDataFrame([("a", "byte_bpe_50k", 8)], TARGETS)).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2]
