"""Index maintenance as set algebra on (project, path, length, mtime, content_hash) listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import normal_path

KEY = ["project", "path"]
#: What became of a file: stat equal; stat differs, content equal; content differs; new; gone.
UNCHANGED, TOUCHED, CHANGED, ADDED, DELETED = "unchanged", "touched", "changed", "added", "deleted"


def listing(fingerprints: DataFrame) -> DataFrame:
    """project, generation, path, length, mtime, content_hash: full listings with normal paths and
    lower-case hashes. Of several rows of a path in a generation the one delivered last stands, at the
    same time the greatest. Rows without project, generation or path belong to none."""
    own = fingerprints.select("project", "generation", normal_path("path").alias("path"), "length", "mtime", F.lower("content_hash").alias("content_hash"), "delivered_at").dropna(subset=["project", "generation", "path"])
    delivered = F.coalesce(F.col("delivered_at").cast("timestamp"), F.lit(0).cast("timestamp"))
    row = F.struct("length", "mtime", "content_hash")
    return own.groupBy("project", "generation", "path").agg(F.max_by(row, F.struct(delivered, "content_hash", "length", "mtime")).alias("row")).select("project", "generation", "path", "row.*")


def last_two(headers: DataFrame) -> DataFrame:
    """project, stored, current: the last generation of each project and the one before it, null if there
    is none. A row a project."""
    g = headers.select("project", "generation").dropna().groupBy("project").agg(F.slice(F.sort_array(F.collect_set("generation"), False), 1, 2).alias("g"))
    return g.select("project", F.get("g", F.lit(1)).alias("stored"), F.get("g", F.lit(0)).alias("current"))


def two_listings(fingerprints: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listings of the last generation but one, and of the last, of each project that has both."""
    rows, pair = listing(fingerprints), last_two(headers).dropna()
    return tuple(rows.join(pair.select("project", F.col(which).alias("generation")), ["project", "generation"]).drop("generation") for which in ("stored", "current"))


def _differs(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) != F.col(b), F.lit(True))


def _both(stored: DataFrame, current: DataFrame) -> DataFrame:
    side = lambda df, s: df.select(*KEY, *(F.col(c).alias(f"{s}_{c}") for c in ("length", "mtime", "content_hash")), F.lit(True).alias(f"in_{s}"))
    return side(stored, "old").join(side(current, "new"), KEY, "full_outer")




def fingerprint_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Project, path, status of every file of either listing. A file whose stat is equal
    is ``unchanged`` without a look at its content; one whose hash is equal (I4) is ``touched``. An
    unknown length, mtime or hash is equal to nothing. A path has one row in a listing."""
    stat = _differs("old_length", "new_length") | _differs("old_mtime", "new_mtime")
    status = (
        F.when(F.col("in_old").isNull(), ADDED)
        .when(F.col("in_new").isNull(), DELETED)
        .when(~stat, UNCHANGED)
        .when(~_differs("old_content_hash", "new_content_hash"), TOUCHED)
        .otherwise(CHANGED)
    )
    return _both(stored, current).select(*KEY, status.alias("status"))


def any_changed(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Project, changed: whether a file is new or gone or its stat differs. A project without files in
    both listings has no row."""
    stat = _differs("old_length", "new_length") | _differs("old_mtime", "new_mtime")
    odd = F.col("in_old").isNull() | F.col("in_new").isNull() | stat
    return _both(stored, current).groupBy("project").agg(F.bool_or(odd).alias("changed"))


def refreshed_listing(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The listing after a refresh and how each row came about: an ``unchanged`` file keeps its stored
    row, a ``touched`` one keeps its content under the new stat, others are as found now."""
    diff = fingerprint_diff(stored, current).filter(F.col("status") != DELETED)
    kept = diff.filter(F.col("status") == UNCHANGED).join(stored, KEY)
    fresh = diff.filter(F.col("status") != UNCHANGED).join(current, KEY)
    return kept.unionByName(fresh).select(*KEY, "length", "mtime", "content_hash", "status")


def refreshed_chunks(chunks: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunks after a refresh. Those of ``unchanged`` and ``touched`` files are kept (reused is
    true), those of other files are dropped, and the rows of ``fresh`` (same columns; chunks of new and
    changed files only are looked at) take their place."""
    of = lambda *status: diff.filter(F.col("status").isin(*status)).select(*KEY)
    kept = chunks.join(of(UNCHANGED, TOUCHED), KEY, "left_semi").withColumn("reused", F.lit(True))
    made = fresh.join(of(ADDED, CHANGED), KEY, "left_semi").withColumn("reused", F.lit(False))
    return kept.unionByName(made)


def file_chunk_counts(chunks: DataFrame) -> DataFrame:
    """Project, path, chunks: how many chunks each file has."""
    return chunks.groupBy(*KEY).agg(F.count("*").alias("chunks"))


def assign_ordinals(chunks: DataFrame, *order: str) -> DataFrame:
    """I8: the chunks with ``ordinal``, from 0 by project: by path, and in a file by ``order``. In two
    levels: the places of a file's chunks among themselves, and the running sum of the files' counts, so
    that no task sorts a project's chunks; a project's sum runs over a row a file."""
    counts = file_chunk_counts(chunks)
    upto = Window.partitionBy("project").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*KEY, F.coalesce(F.sum("chunks").over(upto), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) - 1
    return chunks.withColumn("__place", place).join(base, KEY).withColumn("ordinal", F.col("__base") + F.col("__place")).drop("__base", "__place")


def shape_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Project, changed: whether the files or their numbers of chunks differ, so that ordinals of
    before mean something else now."""
    a = file_chunk_counts(before).withColumnRenamed("chunks", "a")
    b = file_chunk_counts(after).withColumnRenamed("chunks", "b")
    return a.join(b, KEY, "full_outer").groupBy("project").agg(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def index_status(headers: DataFrame, fingerprints: DataFrame, chunks: DataFrame) -> DataFrame:
    """Project, generation, built_at, files, chunks of each project's last generation; 0 where there
    are none. A chunk_id counts once."""
    row = F.max_by("built_at", F.struct("generation", "built_at"))
    last = headers.dropna(subset=["project", "generation"]).groupBy("project").agg(F.max("generation").alias("generation"), row.alias("built_at"))
    files = listing(fingerprints).groupBy("project", "generation").agg(F.count("*").alias("files"))
    own = chunks.groupBy("project").agg(F.count_distinct("chunk_id").alias("chunks"))
    joined = last.join(files, ["project", "generation"], "left").join(own, ["project"], "left")
    return joined.select("project", "generation", "built_at", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
