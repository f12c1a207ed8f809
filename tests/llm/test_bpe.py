"""Encoding against an independent encoder on the same vocabulary file, and the way back."""

import base64

import pytest
import tiktoken

from brindle.llm import bpe

# Fixed value: the pattern that the vocabulary's pre-tokens follow.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ODD = [None, "", " ", "\r\n\r\n  x", "it's they'LL 've'", "a  b 　c", "naïve café é İß", "日本語とかな 123４５", "👩‍👩‍👧‍👦🏽 x", "<|endoftext|>", "\x00\x1f\x85  ", "a" * 5000, "ab " * 3000, "'" * 50 + " " * 50, "١٢٣ ²³ Ⅷ"]


@pytest.fixture(scope="module")
def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_other_encoder(spark, encoder):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = table.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.spans(docs).collect():
        text = texts[r.doc_id] or ""
        assert list(r.ids) == encoder.encode_ordinary(text), r.doc_id
        assert list(r.ends[-1:]) == ([len(text.encode())] if text else []) and list(r.ends) == sorted(r.ends)


def test_way_back(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(docs.limit(0)).isEmpty()
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first().text is None


def test_a_span_is_its_piece(spark):
    text = "The naïve tide — turned."
    r = bpe.spans(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    v = bpe.vocabulary(bpe.read_ranks())
    cut = [0, *r.ends]
    assert b"".join(text.encode()[a:b] for a, b in zip(cut, cut[1:], strict=False)) == text.encode()
    by_id = {i: p for p, i in v.ranks.items()}
    assert [text.encode()[a:b] for a, b in zip(cut, cut[1:], strict=False)] == [by_id[i] for i in r.ids]
