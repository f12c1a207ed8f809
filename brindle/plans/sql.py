"""The core's queries in SQL for DuckDB, for comparison."""

from __future__ import annotations

from ..operators.search import DEPTH, PATH_ONLY, PER_FILE, RRF_K

_WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def lines(text: str) -> str:
    return rf"CASE WHEN {text} = '' THEN [] ELSE string_split({unified(text)}, chr(10)) END"


def unified(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '\r\n?', chr(10), 'g'), '\n\z', '')"


def astral(text: str) -> str:
    """Characters that take two UTF-16 units."""
    return rf"length(regexp_replace({text}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g'))"


def truncated(text: str, units: int) -> str:
    return f"""CASE WHEN {astral(text)} = 0 THEN left({text}, {units}) WHEN length({text}) + {astral(text)} <= {units} THEN {text}
      ELSE left({text}, list_max(list_filter(range({units // 2}, {units} + 1), lambda p: p + {astral(f'left({text}, p)')} <= {units}))::BIGINT) END"""


def stripped(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, '<[^>]*>', ' ', 'g'), '{_WHITE}+', ' ', 'g'))"


#: f: the current row of every file.
FILES = """f AS (SELECT project, path, text, length, mtime FROM source_files WHERE project IS NOT NULL AND path IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY project, path ORDER BY ingested_at DESC NULLS LAST, text DESC NULLS LAST, length DESC NULLS LAST, mtime DESC NULLS LAST) = 1)"""
#: c: every chunk once.
CHUNKS = "c AS (SELECT DISTINCT * FROM chunks)"
#: w: the line windows of the files.
WINDOWS = f"""n AS (SELECT project, path, len({lines('text')}) AS n FROM f WHERE text IS NOT NULL),
w AS (SELECT project, path, ((g - 1) // 80)::INT AS pos_in_file, g::INT AS start_line, least(g + 99, n)::INT AS end_line
      FROM (SELECT project, path, n, unnest(generate_series(1, n, 80)) AS g FROM n) WHERE g = 1 OR g + 19 < n)"""
#: l: all listings; g: the last generation of every project and the one before it; o and k: the last but one and the last of every project that has both; d: their differences.
LISTED = r"""l AS (SELECT project, generation, regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') AS path, length, mtime, lower(content_hash) AS content_hash FROM fingerprints
      WHERE project IS NOT NULL AND generation IS NOT NULL AND path IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY project, generation, regexp_replace(replace(path, '\', '/'), '^(\./+)+', '')
        ORDER BY coalesce(delivered_at, TIMESTAMP '1970-01-01') DESC, lower(content_hash) DESC NULLS LAST, length DESC NULLS LAST, mtime DESC NULLS LAST) = 1),
g AS (SELECT project, generation, lag(generation) OVER (PARTITION BY project ORDER BY generation) AS before FROM (SELECT DISTINCT project, generation FROM index_headers)
      QUALIFY row_number() OVER (PARTITION BY project ORDER BY generation DESC) = 1)"""
LISTINGS = (
    LISTED
    + """,
o AS (SELECT l.* EXCLUDE (generation) FROM l JOIN g ON l.project = g.project AND l.generation = g.before),
k AS (SELECT l.* EXCLUDE (generation) FROM l JOIN g ON l.project = g.project AND l.generation = g.generation AND g.before IS NOT NULL),
d AS (SELECT coalesce(o.project, k.project) AS project, coalesce(o.path, k.path) AS path,
      coalesce(o.length <> k.length, true) OR coalesce(o.mtime <> k.mtime, true) AS stat,
      CASE WHEN o.path IS NULL THEN 'added' WHEN k.path IS NULL THEN 'deleted'
      WHEN NOT (coalesce(o.length <> k.length, true) OR coalesce(o.mtime <> k.mtime, true)) THEN 'unchanged'
      WHEN o.content_hash = k.content_hash THEN 'touched' ELSE 'changed' END AS status
      FROM o FULL JOIN k ON o.project = k.project AND o.path = k.path)"""
)
#: x: what the last listing changes against the one before it.
DIFF = """x AS (SELECT k.project, k.path, k.content_hash, 'F' AS op FROM k LEFT JOIN o ON o.project = k.project AND o.path = k.path
      WHERE o.path IS NULL OR o.content_hash IS DISTINCT FROM k.content_hash
      UNION ALL SELECT o.project, o.path, NULL, 'D' FROM o ANTI JOIN k ON o.project = k.project AND o.path = k.path)"""
#: r: the chunks after a refresh.
REFRESHED = """r AS (SELECT c.project, c.path, c.pos_in_file, c.start_line, c.end_line, true AS reused FROM c JOIN d USING (project, path) WHERE status IN ('unchanged', 'touched')
      UNION ALL SELECT w.project, w.path, w.pos_in_file, w.start_line, w.end_line, false FROM w JOIN d USING (project, path) WHERE status IN ('added', 'changed'))"""


def entry(i: int) -> str:
    return f"sum(('0x' || substr(e, {1 + 15 * i}, 15))::BIGINT)::HUGEINT"


def search(term: str, limit: int, floor: float, kind: str | None = None, path_filter: str | None = None, last: str = "", by: str = "", digits: int = 9) -> str:
    """A search; ``last`` is another query of its tables, ``by`` a column that it is made for each value of."""
    where = (f" AND kind = '{kind}'" if kind else "") + (f" AND contains(lower(path), lower('{path_filter}'))" if path_filter else "")
    depth, t = max(DEPTH, limit), term.strip().lower()
    part, also = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""
WITH c AS (SELECT DISTINCT chunk_id, project, path, kind, lower(coalesce(symbol, '')) AS symbol, lower(coalesce(signature, '')) AS signature FROM chunks WHERE true{where}),
e AS (SELECT DISTINCT ON (vec_id) vec_id, embedding::DOUBLE[] AS e FROM index_vectors
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT e AS q FROM e ORDER BY vec_id LIMIT 1),
v0 AS (SELECT {also}chunk_id, round(list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), {digits}) AS score FROM c JOIN e ON vec_id = chunk_id CROSS JOIN q),
v AS (SELECT *, row_number() OVER ({part}ORDER BY score DESC, chunk_id) AS rank FROM v0 WHERE score >= {floor} QUALIFY rank <= {depth}),
s0 AS (SELECT {also}chunk_id, CASE WHEN split_part(symbol, '.', -1) = '{t}' THEN 5 WHEN starts_with(split_part(symbol, '.', -1), '{t}') THEN 4 WHEN contains(symbol, '{t}') THEN 3
       WHEN contains(signature, '{t}') THEN 2 WHEN contains(lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), '{t}') THEN 1 ELSE 0 END AS band FROM c),
s1 AS (SELECT *, row_number() OVER (PARTITION BY {also}band ORDER BY chunk_id) AS n FROM s0 WHERE band > 0),
s AS (SELECT {also}chunk_id, band, row_number() OVER ({part}ORDER BY band DESC, chunk_id) AS rank FROM s1 WHERE band > 1 OR n <= {PATH_ONLY} QUALIFY rank <= {depth}),
f0 AS (SELECT {also}chunk_id, round(sum(1.0::DOUBLE / ({RRF_K} + rank)), 12) AS score, bool_or(literal) AS exempt
       FROM (SELECT {also}chunk_id, rank, false AS literal FROM v UNION ALL SELECT {also}chunk_id, rank, true FROM s) GROUP BY {also}chunk_id),
f AS (SELECT *, row_number() OVER ({part}ORDER BY score DESC, chunk_id) AS rank FROM f0 QUALIFY rank <= {depth}),
d AS (SELECT chunk_id, score, exempt, rank, project_ AS project, path, NOT exempt AND count(*) FILTER (NOT exempt) OVER (PARTITION BY project_, path ORDER BY rank) > {PER_FILE} AS deferred FROM f JOIN (SELECT chunk_id AS id, project AS project_, path FROM c) ON id = chunk_id)
""" + (last or f"SELECT chunk_id, project, path, score, exempt, rank FROM d ORDER BY deferred, rank LIMIT {limit}")
