"""The core's queries, each over its whole tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, index, lookup, overlay, search, snapshots
from ..session import table
from ..sources import paths
from . import sql

Query = Callable[[SparkSession, str], DataFrame]

#: The searches' term, limit and floor.
TERM, LIMIT, FLOOR = "Index", 20, 0.1
#: Components that ``l2_normalize`` keeps.
DIMENSIONS = 32


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in tables))


def _search(part: str = "all", floor: float = FLOOR, term: str = TERM, digits: int = 9, **where: str) -> Query:
    """A search, or one of its parts, with the first valid vector as the query's."""

    def run(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
        query = search.first_vector(vectors)
        if part == "all":
            return search.hybrid_search(chunks, vectors, query, term, LIMIT, floor, **where)
        if part == "merged":
            return search.merged_search(chunks, vectors, query, term, LIMIT, floor, **where).withColumn("score", F.round(F.col("score").cast("double"), 7))
        own = search.candidates(chunks, **where)
        symbol = search.symbol_branch(own, term, search.DEPTH)
        if part == "symbol":
            return symbol
        vector = search.vector_branch(own, vectors, query, search.DEPTH, floor, digits=digits)
        if part == "vector":
            return vector
        fused = search.fuse(vector, symbol, search.DEPTH)
        if part == "fused":
            return fused
        return search.diversify(fused if part == "exempt" else fused.withColumn("exempt", F.lit(False)), own, LIMIT).select("chunk_id", "project", "path", "rank")

    return _over(run, "chunks", "index_vectors")


def _batch(vectors: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 100 against all."""
    return search.vector_batch(vectors, vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), 10)


# ---- text and chunking -------------------------------------------------------------------------
def _split_lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(T.lines("text")).alias("line_no", "line"))


def _line_range(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunking.with_text(chunks.dropDuplicates(["chunk_id"]), files).select("chunk_id", "body")


def _embed_text(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunking.with_embed_text(chunks.dropDuplicates(["chunk_id"]), files).select("chunk_id", "embed_text")


def _l2(vectors: DataFrame) -> DataFrame:
    unit = F.transform(V.l2_normalized("embedding", DIMENSIONS, strict=False), lambda x: F.round(x, 9))
    return vectors.dropDuplicates(["vec_id"]).select("vec_id", unit.alias("unit"))


def _excerpt(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return lookup.with_excerpt(chunks.dropDuplicates(["chunk_id"]), files).select("chunk_id", "excerpt")


# ---- index and overlays ------------------------------------------------------------------------
def _two(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """An operator on the listings of the last generation but one, and of the last."""
    return _over(lambda prints, headers: operator(*index.two_listings(prints, headers)), "fingerprints", "index_headers")


def _refresh(chunks: DataFrame, files: DataFrame, prints: DataFrame, headers: DataFrame) -> DataFrame:
    columns = ["project", "path", "pos_in_file", "start_line", "end_line"]
    diff = index.fingerprint_diff(*index.two_listings(prints, headers))
    fresh = chunking.line_windows(chunking.current_files(files)).select(*columns)
    return index.refreshed_chunks(chunks.dropDuplicates(["chunk_id"]).select(*columns), diff, fresh)


def _shape(chunks: DataFrame, files: DataFrame, prints: DataFrame, headers: DataFrame) -> DataFrame:
    return index.shape_changed(chunks.dropDuplicates(["chunk_id"]), _refresh(chunks, files, prints, headers))


def _compose(stored: DataFrame, current: DataFrame) -> DataFrame:
    diff = overlay.extract_diff(stored, current)
    entries = diff.filter(F.col("op") == overlay.FILE).select("project", "path", "content_hash")
    return overlay.compose(stored.select("project", "path", "content_hash"), entries, diff.filter(F.col("op") == overlay.GONE))


def _slots(headers: DataFrame) -> DataFrame:
    return overlay.evicted(headers.select("project", "generation", F.col("built_at").alias("last_used")), 5)


# ---- lookup ------------------------------------------------------------------------------------
def _ids(chunks: DataFrame) -> DataFrame:
    """Ids of all chunks as they are, with another generation, and with what is no id."""
    c = chunks.select("project", "generation", "chunk_id", "path")
    as_is = c.select(lookup.chunk_id_text("project", "generation", "chunk_id").alias("id"))
    stale = c.select(lookup.chunk_id_text("project", F.col("generation") - 1, "chunk_id").alias("id"))
    away = c.select(lookup.chunk_id_text("project", "generation", F.col("chunk_id") + 1_000_000_000).alias("id"))
    odd = c.select(lookup.chunk_id_text("path", "generation", "chunk_id").alias("id"))
    none = c.select(F.concat_ws(":", "project", "path").alias("id"))
    return as_is.unionByName(stale).unionByName(away).unionByName(odd).unionByName(none).distinct()


def _parsed(chunks: DataFrame) -> DataFrame:
    return _ids(chunks).withColumn("p", lookup.parsed_id("id")).select("id", "p.project", "p.generation", "p.ordinal")


def _lookup(chunks: DataFrame, headers: DataFrame) -> DataFrame:
    return lookup.lookup(_ids(chunks), chunks, headers)


def _last_listing(prints: DataFrame, headers: DataFrame) -> DataFrame:
    last = index.last_two(headers).select("project", F.col("current").alias("generation"))
    return index.listing(prints).join(last, ["project", "generation"]).select("project", "path", "length", "mtime")


def _stale(chunks: DataFrame, files: DataFrame, prints: DataFrame, headers: DataFrame) -> DataFrame:
    return lookup.with_stale_flag(chunks.dropDuplicates(["chunk_id"]), _last_listing(prints, headers), chunking.current_files(files)).select("chunk_id", "stale")


def _hits(chunks: DataFrame, vectors: DataFrame, files: DataFrame, prints: DataFrame, headers: DataFrame) -> DataFrame:
    top = search.hybrid_search(chunks, vectors, search.first_vector(vectors), TERM, LIMIT, FLOOR).select("chunk_id", "rank", "score")
    hits = F.broadcast(top).join(chunks.dropDuplicates(["chunk_id"]), "chunk_id")  # LIMIT rows
    flagged = lookup.with_stale_flag(lookup.with_excerpt(hits, files), _last_listing(prints, headers), chunking.current_files(files))
    return lookup.hit_json(flagged)


def queries() -> dict[str, Query]:
    """Name -> query (session, folder of the tables)."""
    return {
        "p3_found": _over(snapshots.snapshot_changes, "fingerprints", "index_headers"),
        "p3_counts": _over(snapshots.change_counts, "fingerprints", "index_headers"),
        "path_ext_filter": _over(lambda f, p: index.listing(f).join(p.select("project", "extensions"), "project").filter(paths.has_extension("path", F.col("extensions"))).select("project", "generation", "path"), "fingerprints", "projects"),
        "path_segment_exclude": _over(lambda d: d.filter(~paths.in_excluded(paths.normal_path("path"))).select("doc_id", "path"), "documents"),
        "line_range": _over(_line_range, "chunks", "source_files"),
        "line_windows": _over(lambda f: chunking.line_windows(chunking.current_files(f)), "source_files"),
        "embed_text": _over(_embed_text, "chunks", "source_files"),
        "kind_histogram": _over(chunking.kind_histogram, "chunks"),
        "strip_markup": _over(lambda d: d.select("doc_id", T.stripped("text").alias("stripped")), "documents"),
        "truncate_body": _over(lambda d: d.select("doc_id", T.truncated("text", 2000).alias("body"), T.utf16_units("text").alias("units")), "documents"),
        "split_lines": _over(_split_lines, "documents"),
        "content_hash": _over(lambda d: d.select("doc_id", T.content_hash("text").alias("content_hash")), "documents"),
        "l2_normalize": _over(_l2, "index_vectors"),
        "hits_json": _over(_hits, "chunks", "index_vectors", "source_files", "fingerprints", "index_headers"),
        "filter_kind": _over(lambda c: search.candidates(c, kind="Method").select("chunk_id", "kind", "path"), "chunks"),
        "filter_path": _over(lambda c: search.candidates(c, path_filter="SRC/").select("chunk_id", "kind", "path"), "chunks"),
        "filtered_hybrid": _search(kind="Method", path_filter="SRC"),
        "cosine_topk": _search("vector", -2.0),
        "cosine_topk_floor": _search("vector", 0.55),
        "cosine_topk_ties": _search("vector", -2.0, digits=1),
        "cosine_batch": _over(_batch, "index_vectors"),
        "symbol_match": _search("symbol"),
        "symbol_path_cap": _search("symbol", term="src"),
        "rrf_fuse": _search("fused"),
        "hybrid_search": _search(),
        "multi_project_merge": _search("merged"),
        "diversify": _search("plain"),
        "diversify_exempt": _search("exempt"),
        "diff_any_changed": _two(index.any_changed),
        "fingerprint_diff": _two(index.fingerprint_diff),
        "refreshed_listing": _two(index.refreshed_listing),
        "incremental_refresh": _over(_refresh, "chunks", "source_files", "fingerprints", "index_headers"),
        "file_chunk_counts": _over(lambda c: index.file_chunk_counts(c.dropDuplicates(["chunk_id"])), "chunks"),
        "assign_ordinals": _over(lambda c: index.assign_ordinals(c.dropDuplicates(["chunk_id"]), "pos_in_file", "chunk_id").select("project", "path", "chunk_id", "ordinal"), "chunks"),
        "shape_changed": _over(_shape, "chunks", "source_files", "fingerprints", "index_headers"),
        "overlay_compose": _two(_compose),
        "overlay_diff": _two(overlay.extract_diff),
        "overlay_content_key": _two(lambda stored, current: overlay.content_key(overlay.extract_diff(stored, current))),
        "lru_evict": _over(_slots, "index_headers"),
        "index_status": _over(index.index_status, "index_headers", "fingerprints", "chunks"),
        "parse_chunk_id": _over(_parsed, "chunks"),
        "chunk_lookup": _over(_lookup, "chunks", "index_headers"),
        "excerpt": _over(_excerpt, "chunks", "source_files"),
        "stale_flag": _over(_stale, "chunks", "source_files", "fingerprints", "index_headers"),
    }


_IDS = """i AS (SELECT DISTINCT unnest([concat_ws(':', project, generation, chunk_id), concat_ws(':', project, generation - 1, chunk_id), concat_ws(':', project, generation, chunk_id + 1000000000),
      concat_ws(':', path, generation, chunk_id), concat_ws(':', project, path)]) AS id FROM chunks),
p AS (SELECT id, regexp_matches(id, '^(?s).+:[0-9]+:[0-9]+$') AND try_cast(regexp_extract(id, '^(?s)(.+):([0-9]+):([0-9]+)$', 2) AS INT) IS NOT NULL
      AND try_cast(regexp_extract(id, '^(?s)(.+):([0-9]+):([0-9]+)$', 3) AS INT) IS NOT NULL AS ok FROM i),
y AS (SELECT id, CASE WHEN ok THEN regexp_extract(id, '^(?s)(.+):([0-9]+):([0-9]+)$', 1) END AS project, CASE WHEN ok THEN try_cast(regexp_extract(id, '^(?s)(.+):([0-9]+):([0-9]+)$', 2) AS INT) END AS generation,
      CASE WHEN ok THEN try_cast(regexp_extract(id, '^(?s)(.+):([0-9]+):([0-9]+)$', 3) AS INT) END AS ordinal FROM p)"""


def _body(end: str = "end_line") -> str:
    return f"array_to_string(({sql.lines('f.text')})[greatest(start_line, 1):{end}], chr(10))"


def _hits_sql() -> str:
    base = sql.search(TERM, LIMIT, FLOOR, last=" ").rstrip()
    obj = lambda name, value: f"'\"{name}\":' || to_json({value})"
    opt = lambda name, value: f"coalesce(',\"{name}\":' || to_json({value}), '')"
    return f"""{base},
h AS (SELECT chunk_id, rank, score FROM d ORDER BY deferred, rank LIMIT {LIMIT}),
{sql.LISTED},
{sql.FILES.replace('f AS (', 'ff AS (', 1)},
z AS (SELECT h.*, a.project, a.generation, a.path, start_line, end_line, coalesce(kind, 'Unknown') AS kind, a.symbol, a.signature, nullif(doc, '') AS doc,
      coalesce(array_to_string(({sql.lines('ff.text')})[greatest(start_line, 1):least(end_line, start_line + 4)], chr(10)), '') AS excerpt,
      CASE WHEN NOT coalesce(m.length = ff.length AND m.mtime = ff.mtime, false) THEN true END AS stale
      FROM h JOIN (SELECT DISTINCT * FROM chunks) a USING (chunk_id) LEFT JOIN ff ON ff.project = a.project AND ff.path = a.path
      LEFT JOIN g ON g.project = a.project LEFT JOIN l m ON m.project = a.project AND m.path = a.path AND m.generation = g.generation)
SELECT rank, '{{' || {obj('id', "concat_ws(':', project, generation, chunk_id)")} || ',' || {obj('project', 'project')} || ',' || {obj('path', 'path')} || ',' || {obj('start_line', 'start_line')} || ',' || {obj('end_line', 'end_line')}
  || ',' || {obj('kind', 'kind')} || {opt('symbol', 'symbol')} || {opt('signature', 'signature')} || {opt('doc', 'doc')} || {opt('excerpt', 'excerpt')} || {opt('excerpt_may_be_stale', 'stale')} || ',' || {obj('score', 'score')} || '}}' AS hit FROM z"""


def oracle_sql() -> dict[str, str]:
    """The same in SQL."""
    part = lambda last, **kw: sql.search(kw.pop("term", TERM), LIMIT, kw.pop("floor", FLOOR), last=last, **kw)
    c, two = f"WITH {sql.CHUNKS}", f"WITH {sql.LISTINGS}"
    refresh = f"WITH {sql.CHUNKS}, {sql.FILES}, {sql.WINDOWS}, {sql.LISTINGS}, {sql.REFRESHED}"
    plain = "q2 AS (SELECT f.rank, f.chunk_id, project, path, count(*) OVER (PARTITION BY project, path ORDER BY f.rank) > 2 AS later FROM f JOIN c USING (chunk_id)) SELECT chunk_id, project, path, rank FROM q2 ORDER BY later, rank LIMIT 20"
    merged = """SELECT project, chunk_id, path, round(score::FLOAT::DOUBLE, 7) AS score, exempt, row_number() OVER (ORDER BY score::FLOAT DESC, project, chunk_id) AS rank
      FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY project ORDER BY deferred, rank) <= 20) QUALIFY row_number() OVER (ORDER BY score::FLOAT DESC, project, chunk_id) <= 20"""
    return {
        "p3_found": snapshots.CHANGES_SQL,
        "p3_counts": f"SELECT project, generation, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed FROM ({snapshots.CHANGES_SQL}) GROUP BY ALL",
        "path_ext_filter": f"{two} SELECT l.project, l.generation, l.path FROM l JOIN projects USING (project) WHERE len(list_filter(extensions, lambda e: ends_with(lower(path), lower(e)))) > 0",
        "path_segment_exclude": r"SELECT doc_id, path FROM documents WHERE NOT list_has_any(string_split(lower(regexp_replace(replace(path, '\', '/'), '^(\./+)+', '')), '/'), ['bin', 'obj', '.git', 'node_modules', 'packages', 'testresults'])",
        "line_range": f"{c}, {sql.FILES} SELECT chunk_id, {_body()} AS body FROM c LEFT JOIN f USING (project, path)",
        "line_windows": f"WITH {sql.FILES}, {sql.WINDOWS} SELECT *, 'FileFragment' AS kind, format('{{}}:{{}}-{{}}', path, start_line, end_line) AS symbol, format('{{}}:{{}}-{{}}', path, start_line, end_line) AS signature, '' AS doc FROM w",
        "embed_text": f"""{c}, {sql.FILES}, b AS (SELECT c.*, {_body()} AS body FROM c LEFT JOIN f USING (project, path))
          SELECT chunk_id, 'File: ' || path || chr(10) || 'Symbol: ' || coalesce(symbol, '') || chr(10) || 'Kind: ' || coalesce(kind, 'Unknown') || chr(10)
          || CASE WHEN coalesce(kind, '') = 'FileFragment' THEN '' ELSE 'Signature: ' || coalesce(signature, '') || chr(10) || CASE WHEN coalesce(doc, '') <> '' THEN 'Doc: ' || doc || chr(10) ELSE '' END END
          || 'Code:' || chr(10) || coalesce({sql.truncated('body', 2000)}, '') AS embed_text FROM b""",
        "kind_histogram": f"{c} SELECT project, kind, count(*) AS chunks FROM c GROUP BY ALL",
        "strip_markup": f"SELECT doc_id, {sql.stripped('text')} AS stripped FROM documents",
        "truncate_body": f"SELECT doc_id, {sql.truncated('text', 2000)} AS body, (length(text) + {sql.astral('text')})::INT AS units FROM documents",
        "split_lines": f"SELECT doc_id, (i - 1)::INT AS line_no, ls[i] AS line FROM (SELECT doc_id, {sql.lines('text')} AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)",
        "content_hash": f"SELECT doc_id, sha256({sql.unified('text')}) AS content_hash FROM documents",
        "l2_normalize": f"""WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, embedding[1:{DIMENSIONS}]::DOUBLE[] AS e FROM index_vectors),
          n AS (SELECT vec_id, e, CASE WHEN len(e) = {DIMENSIONS} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN sqrt(list_dot_product(e, e)) END AS n FROM v)
          SELECT vec_id, CASE WHEN n IS NOT NULL THEN list_transform(e, lambda x: round(CASE WHEN n = 0 THEN x ELSE x / n END, 9)) END AS unit FROM n""",
        "hits_json": _hits_sql(),
        "filter_kind": f"{c} SELECT chunk_id, kind, path FROM c WHERE kind = 'Method'",
        "filter_path": f"{c} SELECT chunk_id, kind, path FROM c WHERE contains(lower(path), 'src/')",
        "filtered_hybrid": sql.search(TERM, LIMIT, FLOOR, "Method", "SRC"),
        "cosine_topk": part("SELECT chunk_id, score, rank FROM v", floor=-2.0),
        "cosine_topk_floor": part("SELECT chunk_id, score, rank FROM v", floor=0.55),
        "cosine_topk_ties": part("SELECT chunk_id, score, rank FROM v", floor=-2.0, digits=1),
        "cosine_batch": """WITH e AS (SELECT DISTINCT ON (vec_id) vec_id, embedding::DOUBLE[] AS e FROM index_vectors
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
          SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(q.e, e.e), 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, e.e), 9) DESC, e.vec_id) AS rank
          FROM e q, e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""",
        "symbol_match": part("SELECT chunk_id, band, rank FROM s"),
        "symbol_path_cap": part("SELECT chunk_id, band, rank FROM s", term="src"),
        "rrf_fuse": part("SELECT chunk_id, score, exempt, rank FROM f"),
        "hybrid_search": sql.search(TERM, LIMIT, FLOOR),
        "multi_project_merge": part(merged, by="project"),
        "diversify": part(", " + plain),
        "diversify_exempt": part("SELECT chunk_id, project, path, rank FROM d ORDER BY deferred, rank LIMIT 20"),
        "diff_any_changed": f"{two} SELECT project, bool_or(status IN ('added', 'deleted') OR stat) AS changed FROM d GROUP BY project",
        "fingerprint_diff": f"{two} SELECT project, path, status FROM d",
        "refreshed_listing": f"""{two} SELECT project, path, o.length, o.mtime, o.content_hash, status FROM d JOIN o USING (project, path) WHERE status = 'unchanged'
          UNION ALL SELECT project, path, k.length, k.mtime, k.content_hash, status FROM d JOIN k USING (project, path) WHERE status NOT IN ('unchanged', 'deleted')""",
        "incremental_refresh": f"{refresh} SELECT * FROM r",
        "file_chunk_counts": f"{c} SELECT project, path, count(*) AS chunks FROM c GROUP BY ALL",
        "assign_ordinals": f"{c} SELECT project, path, chunk_id, row_number() OVER (PARTITION BY project ORDER BY path, pos_in_file, chunk_id) - 1 AS ordinal FROM c",
        "shape_changed": f"""{refresh}, a AS (SELECT project, path, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT project, path, count(*) AS n FROM r GROUP BY ALL)
          SELECT project, bool_or(a.n IS DISTINCT FROM b.n) AS changed FROM a FULL JOIN b USING (project, path) GROUP BY project""",
        "overlay_compose": f"{two} SELECT project, path, content_hash FROM k",
        "overlay_diff": f"{two}, {sql.DIFF} SELECT * FROM x",
        "overlay_content_key": f"""{two}, {sql.DIFF}, y AS (SELECT project, sha256(op || chr(9) || path || chr(9) || coalesce(content_hash, '')) AS e FROM x)
          SELECT project, sha256(concat_ws(':', count(*), {', '.join(map(sql.entry, range(4)))})) AS content_key FROM y GROUP BY project""",
        "lru_evict": "SELECT project, generation, built_at AS last_used FROM (SELECT DISTINCT project, generation, built_at FROM index_headers) QUALIFY row_number() OVER (PARTITION BY project ORDER BY built_at DESC NULLS LAST, generation DESC) > 5",
        "index_status": f"""{two}, h AS (SELECT project, generation, built_at FROM index_headers QUALIFY row_number() OVER (PARTITION BY project ORDER BY generation DESC, built_at DESC NULLS LAST) = 1)
          SELECT h.project, h.generation, h.built_at, (SELECT count(*) FROM l WHERE l.project = h.project AND l.generation = h.generation) AS files, (SELECT count(DISTINCT chunk_id) FROM chunks c WHERE c.project = h.project) AS chunks FROM h""",
        "parse_chunk_id": f"WITH {_IDS} SELECT * FROM y",
        "chunk_lookup": f"""WITH {_IDS}, {sql.CHUNKS}, t AS (SELECT project, max(generation) AS last FROM index_headers GROUP BY project),
          s AS (SELECT id, CASE WHEN ordinal IS NULL THEN 'malformed' WHEN last IS NULL THEN 'unknown project' WHEN y.generation <> last THEN 'stale' WHEN chunk_id IS NULL THEN 'missing' ELSE 'found' END AS status, path, start_line, end_line
          FROM y LEFT JOIN t ON t.project = y.project LEFT JOIN c ON c.project = y.project AND c.chunk_id = y.ordinal)
          SELECT id, status, CASE WHEN status = 'found' THEN path END AS path, CASE WHEN status = 'found' THEN start_line END AS start_line, CASE WHEN status = 'found' THEN end_line END AS end_line FROM s""",
        "excerpt": f"{c}, {sql.FILES} SELECT chunk_id, coalesce({_body('least(end_line, start_line + 4)')}, '') AS excerpt FROM c LEFT JOIN f USING (project, path)",
        "stale_flag": f"""{c}, {sql.FILES}, {sql.LISTINGS}, m AS (SELECT l.* FROM l JOIN g ON g.project = l.project AND g.generation = l.generation)
          SELECT chunk_id, NOT coalesce(m.length = f.length AND m.mtime = f.mtime, false) AS stale FROM c LEFT JOIN m ON m.project = c.project AND m.path = c.path LEFT JOIN f ON f.project = c.project AND f.path = c.path""",
    }
