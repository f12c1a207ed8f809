"""Chunks by id, their excerpts, and whether these may be stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunking import with_text
from .index import KEY

#: Fixed value: lines of an excerpt.
EXCERPT_LINES = 5
FOUND, MISSING, STALE, NO_PROJECT, MALFORMED = "found", "missing", "stale", "unknown project", "malformed"
_ID = r"(?s)^(.+):([0-9]+):([0-9]+)$"


def chunk_id_text(project: Column | str, generation: Column | str, ordinal: Column | str) -> Column:
    """project:generation:ordinal."""
    return F.concat_ws(":", project, F.col(generation).cast("string") if isinstance(generation, str) else generation.cast("string"), F.col(ordinal).cast("string") if isinstance(ordinal, str) else ordinal.cast("string"))


def parsed_id(text: Column | str) -> Column:
    """Struct of project, generation, ordinal, read from the right: both numbers are digits within 32
    bits, and the project may contain colons. Null where a text is no id."""
    number = lambda i: F.regexp_extract(text, _ID, i).try_cast("int")
    whole = F.regexp_like(text, F.lit(_ID)) & number(2).isNotNull() & number(3).isNotNull()
    return F.when(whole, F.struct(F.regexp_extract(text, _ID, 1).alias("project"), number(2).alias("generation"), number(3).alias("ordinal")))


def lookup(ids: DataFrame, chunks: DataFrame, headers: DataFrame) -> DataFrame:
    """Id, status, path, start_line, end_line of every distinct id: ``found``; ``missing`` if the
    ordinal (a chunk_id) isn't in the project; ``stale`` if the generation isn't the project's last,
    whatever the ordinal; ``unknown project``; ``malformed``. Null ids are malformed."""
    own = ids.select("id").distinct().withColumn("p", parsed_id("id"))
    asked = own.select("id", "p.project", F.col("p.generation").alias("asked"), F.col("p.ordinal").cast("bigint").alias("chunk_id"))
    last = headers.groupBy("project").agg(F.max("generation").alias("generation"))
    there = chunks.dropDuplicates(["chunk_id"]).select("project", "chunk_id", "path", "start_line", "end_line", F.lit(True).alias("there"))
    joined = asked.join(last, "project", "left").join(there, ["project", "chunk_id"], "left")
    status = F.when(F.col("chunk_id").isNull(), MALFORMED).when(F.col("generation").isNull(), NO_PROJECT).when(F.col("asked") != F.col("generation"), STALE).when(F.col("there").isNull(), MISSING).otherwise(FOUND)
    shown = lambda c: F.when(F.col("status") == FOUND, F.col(c)).alias(c)
    return joined.withColumn("status", status).select("id", "status", shown("path"), shown("start_line"), shown("end_line"))


def with_excerpt(chunks: DataFrame, files: DataFrame, most: int = EXCERPT_LINES) -> DataFrame:
    """The chunks with ``excerpt``, their first lines (at most ``most``); empty where the file
    can't be read."""
    end = F.least(F.col("end_line"), F.col("start_line") + (most - 1))
    cut = chunks.withColumns({"__end": F.col("end_line"), "end_line": end})
    return with_text(cut, files).withColumns({"excerpt": F.coalesce("body", F.lit("")), "end_line": F.col("__end")}).drop("body", "__end")


def with_stale_flag(chunks: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """The chunks with ``stale``: whether their file's fingerprint or stat is missing, or length or
    mtime differ. ``stored`` and ``current`` are project, path, length, mtime."""
    side = lambda df, s: df.select(*KEY, F.col("length").alias(f"__{s}_length"), F.col("mtime").alias(f"__{s}_mtime"))
    same = (F.col("__a_length") == F.col("__b_length")) & (F.col("__a_mtime") == F.col("__b_mtime"))
    joined = chunks.join(side(stored, "a"), KEY, "left").join(side(current, "b"), KEY, "left")
    return joined.withColumn("stale", ~F.coalesce(same, F.lit(False))).drop(*(f"__{s}_{c}" for s in "ab" for c in ("length", "mtime")))


def hit_json(hits: DataFrame) -> DataFrame:
    """Rank, hit: each hit as a JSON object; an empty doc and a flag that isn't set are left
    out. ``hits`` has rank, project, generation, chunk_id, path, start_line, end_line, kind, symbol,
    signature, doc, excerpt, stale, score."""
    fields = F.struct(
        chunk_id_text("project", "generation", "chunk_id").alias("id"), "project", "path", "start_line", "end_line", F.coalesce("kind", F.lit("Unknown")).alias("kind"),
        "symbol", "signature", F.nullif("doc", F.lit("")).alias("doc"), "excerpt", F.when(F.col("stale"), True).alias("excerpt_may_be_stale"), "score",
    )
    return hits.select("rank", F.to_json(fields).alias("hit"))
