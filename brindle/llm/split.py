"""Problem 5: oversized chunks cut into pieces at natural boundaries.

Content-defined chunking: a rolling hash over the text marks landmarks that depend on the content
around them only. A piece ends at the natural boundary nearest to the first landmark beyond its
minimum size, so an edit moves the cuts near it and no others. Natural boundaries are, from strong to
weak: blank lines, ends of blocks, other line ends; within a line that alone is too long, ends of
sentences, spaces, any place.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that the rolling hash covers.
WINDOW = 24
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: The kind whose limit holds for a null kind and for kinds without a limit of their own.
DEFAULT_KIND = "Unknown"


def landmarks(text: str, spacing: int) -> np.ndarray:
    """Offsets after which the rolling hash of the last WINDOW code points falls into one of
    ``spacing`` classes; about one in ``spacing`` offsets, and the same ones wherever the text stands."""
    n = len(text)
    if n <= WINDOW:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    power = 1
    with np.errstate(over="ignore"):
        for k in range(WINDOW):  # a polynomial of the window's code points
            h += c[WINDOW - 1 - k : n - k] * np.uint64(power)
            power = power * _BASE & _MASK
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return np.flatnonzero(h % np.uint64(spacing) == 0) + WINDOW


_BLOCK_END = re.compile(r"^\s*(?:[}\])]+[;,]?|end|pass|return\b.*|</[^>]+>)\s*$")


def _strengths(lines: list[str]) -> list[int]:
    """How natural a cut after each line is: 3 next to a blank line, 2 at a block's end, else 1."""
    out = []
    for i, line in enumerate(lines):
        after = lines[i + 1] if i + 1 < len(lines) else ""
        if not line.strip() or not after.strip():
            out.append(3)
        elif _BLOCK_END.match(line) or len(after) - len(after.lstrip()) < len(line) - len(line.lstrip()):
            out.append(2)
        else:
            out.append(1)
    return out


def pieces(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, overlap) of the pieces of a text, in code points: each is at most ``limit`` long,
    begins with up to ``overlap`` last lines of the piece before it and goes on where that one ended.
    Lines that leave no room for new text are left out.
    After a cut inside a line, the part of the line before the cut is the last line, and isn't repeated if
    it is all that the piece before has. A line feed at the end of a piece doesn't count for its length
    nor belong to its text. A text within the limit is one piece; an empty one too."""
    if limit < 1 or overlap < 0:
        raise ValueError("limit must be positive and overlap not negative")
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    lines = text.split("\n")
    ends, at = [], 0  # offset after each line, its terminator included
    for line in lines:
        at += len(line) + 1
        ends.append(at)
    ends[-1] = n
    starts = [0, *ends[:-1]]
    strength = _strengths(lines)
    marks = landmarks(text, max(8, limit // 4))
    out: list[tuple[int, int, int]] = []
    pos = 0
    while True:
        # lines before pos that are repeated; the last may be a part
        begin, repeated = pos, 0
        k = bisect_left(starts, pos)
        if out and overlap:
            floor = max(out[-1][0], 0)
            while repeated < overlap and k - repeated - 1 >= 0 and starts[k - repeated - 1] >= floor and pos - starts[k - repeated - 1] < limit:
                repeated += 1
            # after a cut inside a line the piece before must not be repeated as a whole
            while repeated and pos not in starts[k : k + 1] and starts[k - repeated] <= floor:
                repeated -= 1
            begin = starts[k - repeated] if repeated else pos
        if n - begin <= limit:
            out.append((begin, n, repeated))
            return out
        most = begin + limit
        least = pos + max(1, (most - pos) // 3)
        i = int(np.searchsorted(marks, least))
        target = int(marks[i]) if i < len(marks) and marks[i] <= most else most
        cut = _line_cut(ends, strength, least, most, target)
        if cut is None:
            cut = _line_cut(ends, strength, pos + 1, least, least)
        if cut is None or not text[pos:cut].strip():
            cut = _inner_cut(text, least, most, target)
        out.append((begin, cut, repeated))
        if cut == n:
            return out
        pos = cut


def _line_cut(ends: list[int], strength: list[int], least: int, most: int, target: int) -> int | None:
    """The line end nearest to the target; stronger ones count as nearer. The line feed after a
    piece's last line isn't part of its text, so it may lie beyond ``most``; the last line has none."""
    a, b = bisect_left(ends, least), min(bisect_right(ends, most + 1), len(ends) - 1)
    if a >= b:
        return None
    return ends[min(range(a, b), key=lambda j: (abs(ends[j] - target) / 3 ** (strength[j] - 1), j))]


_SENTENCE = re.compile(r"[.!?;:。！？；,，、)}\]>](?=\s|$|[^\x00-\x7f])|[。！？；，、]")


def _inner_cut(text: str, least: int, most: int, target: int) -> int:
    """A cut inside a line: after the sentence, or the space, nearest to the target, or at the limit;
    never between a base character and its combining marks or within a joined emoji."""
    part = text[least:most]
    for found in ([m.end() + least for m in _SENTENCE.finditer(part)], [m.end() + least for m in re.finditer(r"\s+", part)]):
        if found:
            return min(found, key=lambda x: (abs(x - target), x))
    cut = most
    while cut > least and (0x300 <= ord(text[cut]) <= 0x36F or 0xFE00 <= ord(text[cut]) <= 0xFE0F or "‍" in text[cut - 1 : cut + 1] or 0x1F3FB <= ord(text[cut]) <= 0x1F3FF):
        cut -= 1
    return cut if cut > least else most


def chunk_text(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (1-based, inclusive) of a text, clamped, joined with LF and without a final
    one. CRLF and CR count as LF."""
    unified = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n\z", "")
    lines = F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(unified, "\n", -1))
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n")


def oversized(chunks: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks whose text is longer than their kind's limit, with text, max_chars and overlap_lines.

    Of repeated rows of a chunk_id, and of a file, one counts (of a file the one ingested last). Chunks
    with a null range, of unknown files or of files with null text have no text.
    """
    small = chunks.select("chunk_id", "project", "path", "kind", "start_line", "end_line").dropDuplicates(["chunk_id"])
    at = F.coalesce(F.col("ingested_at").cast("timestamp"), F.lit(0).cast("timestamp"))
    texts = files.select("project", "path", "text", at.alias("at")).dropna(subset=["project", "path"]).groupBy("project", "path").agg(F.max_by("text", F.struct("at", F.length("text"))).alias("text"))
    rules = limits.select(F.col("kind").alias("rule"), F.col("max_chars").cast("int").alias("max_chars"), F.coalesce(F.col("overlap_lines"), F.lit(0)).cast("int").alias("overlap_lines")).dropna().dropDuplicates(["rule"])
    own = rules.select(F.col("rule").alias("kind"), F.struct("max_chars", "overlap_lines").alias("own"))
    default = rules.filter(F.col("rule") == DEFAULT_KIND).select(F.struct("max_chars", "overlap_lines").alias("default"))
    ruled = small.join(own, "kind", "left").join(default.withColumn("one", F.lit(1)), F.lit(1) == F.col("one"), "left").drop("one")
    return (
        ruled.join(texts, ["project", "path"])
        .filter(F.col("text").isNotNull())
        .select("chunk_id", "project", "path", F.greatest("start_line", F.lit(1)).alias("start_line"), chunk_text(F.col("text"), F.col("start_line"), F.col("end_line")).alias("text"), F.coalesce("own", "default").alias("rule"))
        .filter(F.length("text") > F.col("rule.max_chars"))
        .select("chunk_id", "project", "path", "start_line", "text", "rule.max_chars", "rule.overlap_lines")
    )


_SCHEMA = pa.schema([
    ("chunk_id", pa.int64()), ("project", pa.string()), ("path", pa.string()), ("piece", pa.int32()), ("pieces", pa.int32()),
    ("start_line", pa.int32()), ("start_char", pa.int32()), ("end_line", pa.int32()), ("end_char", pa.int32()),
    ("overlap_lines", pa.int32()), ("n_chars", pa.int32()), ("text", pa.string()),
])


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text = r["text"]
            breaks = [m.start() for m in re.finditer("\n", text)]
            cut = pieces(text, max(1, r["max_chars"]), max(0, r["overlap_lines"]))
            for k, (a, b, repeated) in enumerate(cut):
                shown = text[a:b].removesuffix("\n")
                b = a + len(shown)
                i, j = bisect_left(breaks, a), bisect_left(breaks, max(a, b))
                line_at = lambda x, i: x - (breaks[i - 1] + 1 if i else 0)
                rows.append({
                    "chunk_id": r["chunk_id"], "project": r["project"], "path": r["path"], "piece": k, "pieces": len(cut),
                    "start_line": r["start_line"] + i, "start_char": line_at(a, i), "end_line": r["start_line"] + j, "end_char": line_at(b, j),
                    "overlap_lines": repeated, "n_chars": len(shown), "text": shown,
                })
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def split_chunks(chunks: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every oversized chunk: chunk_id, project, path, piece (from 0), pieces, the range
    (start_line, start_char) to (end_line, end_char) in the file (lines 1-based, characters 0-based
    code points of the line, the end exclusive), overlap_lines repeated from the piece before, n_chars
    and text. A line feed at the end of a piece belongs to none.

    Chunks within their limit have no rows; nor have those without text (see ``oversized``); an empty
    table gives none. A null kind, or one without a limit, counts as 'Unknown'; if that has no limit
    either, the chunk isn't cut.
    """
    big = oversized(chunks, files, limits)
    return big.mapInArrow(
        _split_batches,
        "chunk_id bigint, project string, path string, piece int, pieces int, start_line int, start_char int, end_line int, end_char int, overlap_lines int, n_chars int, text string",
    )


def found(chunks: DataFrame, files: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id of the chunks that are cut."""
    return split_chunks(chunks, files, limits).filter(F.col("piece") == 0).select("chunk_id")


FOUND_SQL = r"""
WITH f AS (SELECT project, path, arg_max(text, ingested_at) AS text FROM source_files WHERE text IS NOT NULL GROUP BY ALL),
l AS (SELECT project, path, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\z', ''), chr(10)) END AS lines FROM f),
c AS (SELECT DISTINCT chunk_id, project, path, coalesce(kind, 'Unknown') AS kind, start_line, end_line FROM chunks)
SELECT c.chunk_id FROM c JOIN l USING (project, path) JOIN split_limits s ON s.kind = c.kind
WHERE length(array_to_string(lines[greatest(c.start_line, 1):c.end_line], chr(10))) > s.max_chars
"""
