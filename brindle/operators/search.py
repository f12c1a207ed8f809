"""Top-k search over chunks: vectors, symbols, their fusion and diversification.

Every branch is sorted and limited before its rows are numbered, so that no window holds more rows than
the branch's depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, literal, valid

#: Constants of the reference: least depth of a branch, RRF, path-only hits, hits of a file.
DEPTH, RRF_K, PATH_ONLY, PER_FILE = 50, 60, 20, 2
#: Bands of a symbol match, the first that holds counts.
EXACT, PREFIX, SUBSTRING, SIGNATURE, PATH = 5, 4, 3, 2, 1


def _ranked(df: DataFrame, score: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows and their rank, of each group if ``by`` is given: highest score, then smallest
    chunk_id. Either way tasks keep only k rows (a group) before the shuffle."""
    order = (F.desc(score), F.col("chunk_id"))
    if by:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= max(k, 0))
    return df.orderBy(*order).limit(max(k, 0)).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def candidates(chunks: DataFrame, kind: str | None = None, path_filter: str | None = None) -> DataFrame:
    """The chunks, once each, of a kind and with a part of their path, both without limit if null; an
    empty path filter is none."""
    own = chunks.dropDuplicates(["chunk_id"])
    if kind is not None:
        own = own.filter(F.col("kind") == kind)
    return own.filter(F.contains(F.lower("path"), F.lower(F.lit(path_filter)))) if path_filter else own


def vector_branch(chunks: DataFrame, vectors: DataFrame, query: list[float], k: int, floor: float | None = None, by: tuple[str, ...] = (), digits: int = 9) -> DataFrame:
    """chunk_id, score, rank of the k chunks of highest cosine similarity (K1, K2), at least ``floor`` if
    given (P5), of each group if ``by`` is given. Scores are rounded to ``digits``. Invalid embeddings take
    no part; a repeated row counts once."""
    q = literal(query)
    own = vectors.filter(valid("embedding", len(query))).select(F.col("vec_id").alias("chunk_id"), "embedding").dropDuplicates(["chunk_id"])
    length = math.sqrt(sum(x * x for x in query)) or 1.0
    e = F.col("embedding")
    scored = own.join(chunks.select("chunk_id", *by), "chunk_id").select(*by, "chunk_id", F.round(dot(e, q) / (F.sqrt(dot(e, e)) * length), digits).alias("score"))
    return _ranked(scored if floor is None else scored.filter(F.col("score") >= floor), "score", k, by)


def band(term: str) -> Column:
    """The band of a chunk's match with a term, literally and without regard to case; 0 if none."""
    t = F.lower(F.lit(term))
    symbol, signature = F.lower(F.coalesce("symbol", F.lit(""))), F.lower(F.coalesce("signature", F.lit("")))
    leaf = F.substring_index(symbol, ".", -1)
    directory = F.lower(F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1))
    return F.when(leaf == t, EXACT).when(F.startswith(leaf, t), PREFIX).when(F.contains(symbol, t), SUBSTRING).when(F.contains(signature, t), SIGNATURE).when(F.contains(directory, t), PATH).otherwise(0)


def symbol_branch(chunks: DataFrame, term: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, band, rank of the k best matches, of each group if ``by`` is given; of those by path alone
    the first PATH_ONLY count (K4 to K6). A blank term has none."""
    term = term.strip()
    hits = chunks.select(*by, "chunk_id", band(term).alias("band")).filter((F.col("band") > 0) & F.lit(bool(term)))
    by_path = hits.filter(F.col("band") == PATH)
    paths = _ranked(by_path, "band", PATH_ONLY, by).drop("rank") if by else by_path.orderBy("chunk_id").limit(PATH_ONLY)
    return _ranked(hits.filter(F.col("band") > PATH).unionByName(paths), "band", k, by)


def fuse(vector: DataFrame, symbol: DataFrame, depth: int, by: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, score, exempt (whether the symbol branch has it), rank: reciprocal rank fusion (K8)."""
    both = vector.select(*by, "chunk_id", "rank", F.lit(False).alias("literal")).unionByName(symbol.select(*by, "chunk_id", "rank", F.lit(True).alias("literal")))
    fused = both.groupBy(*by, "chunk_id").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 12).alias("score"), F.bool_or("literal").alias("exempt"))
    return _ranked(fused, "score", depth, by)


def diversify(fused: DataFrame, chunks: DataFrame, limit: int, per_file: int = PER_FILE, by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``limit`` rows of a ranking (of each group if ``by`` is given) with at most ``per_file``
    of a file, exempt ones aside (D2); what is deferred fills up (D1). The order stays the ranking's, in
    ``rank``. A limit of 0 or less gives none; per_file below 1 is an error."""
    if per_file < 1:
        raise ValueError("per_file must be positive")
    own = fused.join(chunks.select("chunk_id", "project", "path"), ["chunk_id", *by])
    nth = F.count_if(~F.col("exempt")).over(Window.partitionBy("project", "path").orderBy("rank"))
    marked = own.withColumn("deferred", ~F.col("exempt") & (nth > per_file))
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("deferred", "rank"))
        return marked.withColumn("__place", place).filter(F.col("__place") <= max(limit, 0)).drop("deferred", "__place")
    return marked.orderBy("deferred", "rank").limit(max(limit, 0)).drop("deferred")


def merged_search(chunks: DataFrame, vectors: DataFrame, query: list[float], term: str, limit: int, floor: float = 0.55, kind: str | None = None, path_filter: str | None = None) -> DataFrame:
    """project, chunk_id, path, score, exempt, rank: every project searched for itself, as
    ``hybrid_search`` does, and the results merged by score (in single precision, as it is given out),
    then project and chunk_id (K10, X7). All projects are one plan: windows by project."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    own, depth, by = candidates(chunks, kind, path_filter), max(DEPTH, limit), ("project",)
    fused = fuse(vector_branch(own, vectors, query, depth, floor, by), symbol_branch(own, term, depth, by), depth, by)
    hits = diversify(fused, own, limit, by=by).withColumn("score", F.col("score").cast("float"))
    order = (F.desc("score"), F.col("project"), F.col("chunk_id"))
    top = hits.select("project", "chunk_id", "path", "score", "exempt").orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hybrid_search(chunks: DataFrame, vectors: DataFrame, query: list[float], term: str, limit: int, floor: float = 0.55, kind: str | None = None, path_filter: str | None = None) -> DataFrame:
    """chunk_id, project, path, score, exempt, rank: the flagship query. Filters come before both
    branches. A negative limit is an error; empty tables give no rows."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    own, depth = candidates(chunks, kind, path_filter), max(DEPTH, limit)
    fused = fuse(vector_branch(own, vectors, query, depth, floor), symbol_branch(own, term, depth), depth)
    return diversify(fused, own, limit).select("chunk_id", "project", "path", "score", "exempt", "rank")


def first_vector(vectors: DataFrame, dimensions: int = 64) -> list[float]:
    """The valid embedding of the smallest id, which stands for an embedded query."""
    row = vectors.filter(valid("embedding", dimensions)).orderBy("vec_id").select("embedding").first()
    return list(row[0]) if row else [1.0] + [0.0] * (dimensions - 1)


#: Query vectors that a pass over the vectors holds at once; more are taken in several passes.
BATCH = 2_000


def vector_batch(vectors: DataFrame, queries: DataFrame, k: int, dimensions: int = 64, floor: float | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: K1 for many queries (query_id, embedding) at once.

    A pass over the vectors multiplies them with a block of BATCH queries in numpy; a task keeps k rows a
    query, and the k best of all tasks stay. Scores are rounded to 9 digits; of equal ones the smaller
    chunk_id comes first. Invalid embeddings take no part on either side; a repeated row counts once.
    """
    q = queries.filter(F.col("query_id").isNotNull() & valid("embedding", dimensions)).groupBy("query_id").agg(F.min("embedding").alias("embedding"))
    held = vectors.filter(F.col("vec_id").isNotNull() & valid("embedding", dimensions)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    numbered = q.orderBy("query_id").toArrow()  # the caller's queries: what one asks for, not the table
    ids, x = numbered.column("query_id").to_numpy(), _unit(numbered.column("embedding").combine_chunks(), dimensions)
    out: DataFrame | None = None
    for a in range(0, max(1, len(ids)), BATCH):
        block = held.sparkSession.sparkContext.broadcast((ids[a : a + BATCH], x[a : a + BATCH]))  # at most BATCH rows

        def best(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            names, rows = block.value
            top_s, top_i = np.zeros((len(names), 0)), np.zeros((len(names), 0), np.int64)
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                s = np.round(rows @ _unit(batch.column("embedding"), dimensions).T, 9)
                i = np.broadcast_to(batch.column("vec_id").to_numpy(), s.shape)
                s, i = np.concatenate([top_s, s], axis=1), np.concatenate([top_i, i], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                top_s, top_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            keep = np.ones(top_s.size, bool) if floor is None else top_s.ravel() >= floor
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, top_s.shape[1])[keep]), pa.array(top_i.ravel()[keep]), pa.array(top_s.ravel()[keep])], names=["query_id", "chunk_id", "score"])

        one = held.mapInArrow(best, "query_id bigint, chunk_id bigint, score double")
        out = one if out is None else out.unionByName(one)
    return _ranked(out, "score", k, ("query_id",))


def _unit(column: pa.Array, dimensions: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
