"""Problem 7: documents packed into containers of fixed capacity.

Lexical retrieval packing. Documents that share their rarest tokens are put into the same shard, of bounded
size, so that what a seed can retrieve is near it however large the corpus; each shard has a BM25
inverted index over its documents' tokens, with document frequencies of the whole corpus. The longest
unused document is the seed of a container; the index returns its unused neighbours, which fill the
window greedily while they fit; what is left is closed with the longest unused document that fits.
Only documents longer than the capacity are split: into full windows and a rest.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import bpe

#: Most documents and tokens that a shard should hold (a single longer document has one to itself).
SHARD_DOCS, SHARD_TOKENS = 4_000, 1_500_000
#: Usual constants of BM25.
K1, B = 1.2, 0.75
_SCHEMA = pa.schema([
    ("target", pa.string()), ("container", pa.int64()), ("position", pa.int32()), ("doc_id", pa.int64()), ("part", pa.int32()),
    ("start_token", pa.int64()), ("end_token", pa.int64()), ("n_tokens", pa.int64()), ("capacity", pa.int64()),
])


class Index:
    """A BM25 index of a shard: postings by term and terms by document, weights worked out once."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, idf: np.ndarray, average: float):
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(offsets))
        code = doc * np.int64(len(idf)) + tokens
        code, tf = np.unique(code, return_counts=True)
        self.doc, self.term = (code // len(idf)).astype(np.int64), (code % len(idf)).astype(np.int64)
        length = np.diff(offsets)[self.doc] / max(average, 1.0)
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        order = np.argsort(self.term, kind="stable")
        self.p_doc, self.p_weight = self.doc[order].astype(np.int32), self.weight[order].astype(np.float32)
        terms, begin = np.unique(self.term[order], return_index=True)
        self.begin = np.zeros(len(idf), np.int64)
        self.count = np.zeros(len(idf), np.int64)
        self.begin[terms], self.count[terms] = begin, np.diff(np.append(begin, len(order)))
        self.n = n

    def scores(self, doc: int) -> np.ndarray:
        """BM25 scores of all documents for the terms of one."""
        terms = self.term[self.first[doc] : self.first[doc + 1]]
        lengths = self.count[terms]
        total = int(lengths.sum())
        at = np.repeat(self.begin[terms] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        return np.bincount(self.p_doc[at], self.p_weight[at], self.n)


def pack(sizes: np.ndarray, capacity: int, index: Index) -> list[list[tuple[int, int, int, int]]]:
    """Containers as lists of (document, part, start, end). Every document is in one container whole,
    or, if it is longer than the capacity, in full ones and one with the rest. Empty documents lie in
    the first container."""
    out: list[list[tuple[int, int, int, int]]] = []
    n = len(sizes)
    rest = sizes % capacity
    full = sizes // capacity
    for d in np.flatnonzero(full):
        out += ([(int(d), p, p * capacity, (p + 1) * capacity)] for p in range(int(full[d])))
    left = np.where(rest > 0, rest, 0)
    unused = left > 0
    by_size = sorted((int(left[d]), int(d)) for d in np.flatnonzero(unused))
    sizes_left = left.copy()
    while by_size:
        size, seed = by_size.pop()
        unused[seed] = False
        window, room = [seed], capacity - size
        if by_size and by_size[0][0] <= room:
            fit = np.flatnonzero(unused & (sizes_left <= room))
            score = index.scores(seed)[fit]
            near = fit[np.argsort(-score, kind="stable")[: int((score > 0).sum())]]
            taken: list[int] = []
            for d in near.tolist():
                s = int(left[d])
                if s <= room:
                    taken.append(d)
                    room -= s
                    if room < by_size[0][0]:
                        break
            # the gap: trade the last neighbour for the longest document that fits in its place
            if taken and room:
                last = taken.pop()
                room += int(left[last])
            for d in taken:
                _drop(by_size, int(left[d]), d)
                unused[d] = False
            window += taken
            while by_size and by_size[0][0] <= room:
                k = bisect_right(by_size, (room, n)) - 1
                s = by_size[k][0]
                # of the longest that fit, the one nearest to the seed
                a = bisect_right(by_size, (s - 1, n))
                k = max(range(a, k + 1), key=lambda j: _score_of(score, fit, by_size[j][1])) if k > a else k
                s, d = by_size.pop(k)
                unused[d] = False
                window.append(d)
                room -= s
        out.append([(d, int(full[d]), int(full[d]) * capacity, int(sizes[d])) for d in window])
    empty = [(int(d), 0, 0, 0) for d in np.flatnonzero(sizes == 0)]
    if empty:
        if not out:
            out.append([])
        out[0] = out[0] + empty
    return out


def _drop(by_size: list[tuple[int, int]], size: int, doc: int) -> None:
    del by_size[bisect_right(by_size, (size, doc)) - 1]


def _score_of(score: np.ndarray, fit: np.ndarray, doc: int) -> float:
    at = int(np.searchsorted(fit, doc))
    return float(score[at]) if at < len(fit) and fit[at] == doc else 0.0


def containers(documents: DataFrame, targets: DataFrame, directory: str = bpe.TOKENIZERS) -> DataFrame:
    """target, container, position, doc_id, part, start_token, end_token, n_tokens, capacity: where
    every document, or part of one, lies, for each row of ``targets`` (target, tokenizer, capacity).

    ``documents`` has doc_id and text; more columns are ignored. Null and empty texts have no tokens;
    they lie in some container and take no room. Rows that repeat a doc_id count once; a null doc_id is
    a value like others. Targets with a null or non-positive capacity are left out. Empty tables give
    no rows. Containers are numbered within a target, with gaps.
    """
    spark = documents.sparkSession
    wanted = [r for r in targets.select("target", "tokenizer", "capacity").distinct().orderBy("target").collect() if r.capacity and r.capacity > 0]
    out: DataFrame | None = None
    for tokenizer in sorted({r.tokenizer for r in wanted if r.tokenizer}):
        goals = [(r.target, int(r.capacity)) for r in wanted if r.tokenizer == tokenizer]
        one = _packed(documents, goals, tokenizer, directory)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "target string, container bigint, position int, doc_id bigint, part int, start_token bigint, end_token bigint, n_tokens bigint, capacity bigint") if out is None else out


def assign_shards(docs: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, shards) of every key from its documents and tokens: keys beside each other share a
    shard while they fit; a key that is too large has several shards to itself."""
    weight = np.maximum(docs / SHARD_DOCS, tokens / SHARD_TOKENS)
    first, parts = np.zeros(len(weight), np.int64), np.ones(len(weight), np.int64)
    at, filled = 0, 0.0
    for k in np.flatnonzero(weight > 0).tolist():
        if filled and filled + weight[k] > 1:
            at, filled = at + 1, 0.0
        first[k] = at
        if weight[k] > 1:
            parts[k] = -(-weight[k] // 1)
            at += int(parts[k])
        else:
            filled += weight[k]
    return first, parts


_ENCODED = "doc_id bigint, ids array<int>"


def _packed(documents: DataFrame, goals: list[tuple[str, int]], tokenizer: str, directory: str) -> DataFrame:
    spark = documents.sparkSession
    encoded = checkpointed(bpe.encode(documents, tokenizer, directory))
    if not encoded.groupBy("doc_id").count().filter("count > 1").isEmpty():
        encoded = checkpointed(encoded.groupBy("doc_id").agg(F.min("ids").alias("ids")))
    vocabulary = 1 + max(bpe.vocabulary(bpe.read_ranks(tokenizer, directory)).ranks.values())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, tokens, docs = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            ids = batch.column("ids")
            flat, lengths = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
            code = np.unique(np.repeat(np.arange(len(lengths)), lengths) * np.int64(vocabulary) + flat)
            df += np.bincount(code % vocabulary, minlength=vocabulary)
            tokens, docs = tokens + len(flat), docs + len(lengths)
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(have, (-1, -2))), pa.array(np.append(df[have], (tokens, docs)))], names=["token", "n"])

    # at most one row a token of the vocabulary, from all documents
    counted = {r.token: r.n for r in encoded.select("ids").mapInArrow(frequencies, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    total, tokens = counted.pop(-2, 0), counted.pop(-1, 0)
    df = np.zeros(vocabulary)
    if counted:
        df[list(counted)] = list(counted.values())
    idf = np.log1p((total - df + 0.5) / (df + 0.5))
    average = tokens / total if total else 1.0
    order = np.full(vocabulary, vocabulary, np.int64)  # the place of each token that documents share, the rarest first
    shared_tokens = np.flatnonzero(df > 1)
    order[shared_tokens[np.lexsort((shared_tokens, df[shared_tokens]))]] = np.arange(len(shared_tokens))
    shared = spark.sparkContext.broadcast((idf, average, order))  # numbers a token of the vocabulary

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The two rarest shared tokens of each document, by their places; the vocabulary's size for none."""
        order = shared.value[2]
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            place = order[ids.flatten().to_numpy()]
            k1, k2 = np.full(len(ids), len(order)), np.full(len(ids), len(order))
            for i, (a, b) in enumerate(zip(offsets - offsets[0], offsets[1:] - offsets[0], strict=False)):
                if b > a:
                    k1[i] = place[a:b].min()
                    rest = place[a:b][place[a:b] > k1[i]]
                    k2[i] = rest.min() if len(rest) else k1[i]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(np.diff(offsets).astype(np.int64)), pa.array(k1), pa.array(k2)], names=["doc_id", "ids", "n", "k1", "k2"])

    keyed = encoded.mapInArrow(keys, _ENCODED + ", n bigint, k1 bigint, k2 bigint")
    docs, sizes = np.zeros(vocabulary + 1), np.zeros(vocabulary + 1)
    for r in keyed.groupBy("k1").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).collect():  # at most a row a token
        docs[r.k1], sizes[r.k1] = r.docs, r.tokens
    first, parts = assign_shards(docs, sizes)
    by_key = spark.createDataFrame(pa.table({"k1": np.arange(vocabulary + 1), "first": first, "parts": parts}))
    # a row a token of the vocabulary; documents of a large key are spread by their second token
    placed = keyed.join(F.broadcast(by_key), "k1").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("k2"), F.col("parts")))
    # shards that are still too large (copies share all their tokens) are split by document
    weight = F.greatest(F.count("*") / F.lit(SHARD_DOCS), F.sum("n") / F.lit(SHARD_TOKENS))
    large = placed.groupBy("shard").agg(F.ceil(weight).alias("lots")).filter(F.col("lots") > 1)
    lot = F.pmod(F.xxhash64("doc_id"), F.coalesce("lots", F.lit(1)))
    placed = placed.join(large, "shard", "left").select("doc_id", "ids", "shard", lot.alias("lot"))

    def fill(table: pa.Table) -> pa.Table:
        idf, average, _ = shared.value
        table = table.combine_chunks()
        doc = table.column("doc_id").to_pylist()
        order = pa.array(np.argsort([d if d is not None else -1 for d in doc], kind="stable"))
        table = table.take(order).combine_chunks()
        ids = table.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        doc, at = table.column("doc_id").to_pylist(), (table.column("shard")[0].as_py() << 43) | (table.column("lot")[0].as_py() << 24)
        offsets = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
        offsets = offsets - offsets[0]
        index = Index(flat, offsets, idf, average)
        sizes = np.diff(offsets)
        columns: list[list] = [[] for _ in _SCHEMA]
        for target, capacity in goals:
            for c, window in enumerate(pack(sizes, capacity, index)):
                for position, (d, part, a, b) in enumerate(window):
                    for column, v in zip(columns, (target, at | c, position, doc[d], part, a, b, b - a, capacity), strict=True):
                        column.append(v)
        return pa.table([pa.array(v, f.type) for v, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return placed.groupBy("shard", "lot").applyInArrow(
        fill, "target string, container bigint, position int, doc_id bigint, part int, start_token bigint, end_token bigint, n_tokens bigint, capacity bigint"
    )


def fill_rates(documents: DataFrame, targets: DataFrame, directory: str = bpe.TOKENIZERS) -> DataFrame:
    """Per target: containers, documents, tokens and the share of all containers' room that is used."""
    c = containers(documents, targets, directory)
    return c.groupBy("target").agg(
        F.count_distinct("container").alias("containers"),
        F.count_distinct("doc_id").alias("documents"),
        F.sum("n_tokens").alias("tokens"),
        (F.sum("n_tokens") / (F.count_distinct("container") * F.max("capacity"))).alias("filled"),
    )
