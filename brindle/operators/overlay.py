"""Overlays: what a recurring state of a tree changes against its base, kept and composed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import KEY

FILE, GONE = "F", "D"


def extract_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """Project, path, content_hash, op: ``F`` for files that the base lacks or has with another
    content, ``D`` for files that are gone (hash null). Null hashes are equal to each other only."""
    now = current.select(*KEY, "content_hash")
    old = base.select(*KEY, F.col("content_hash").alias("__old"), F.lit(True).alias("__there"))
    changed = now.join(old, KEY, "left").filter(F.col("__there").isNull() | ~F.col("content_hash").eqNullSafe(F.col("__old"))).select(*KEY, "content_hash", F.lit(FILE).alias("op"))
    gone = base.select(*KEY).join(current, KEY, "left_anti").select(*KEY, F.lit(None).cast("string").alias("content_hash"), F.lit(GONE).alias("op"))
    return changed.unionByName(gone)


def compose(base: DataFrame, overlay: DataFrame, deleted: DataFrame) -> DataFrame:
    """The base's rows without those of deleted and of overlaid paths, and the overlay's. Any table
    with project and path composes so: listings, chunks. Listings are composed for themselves, so a file
    without chunks keeps its row."""
    masked = overlay.select(*KEY).unionByName(deleted.select(*KEY)).distinct()
    return base.join(masked, KEY, "left_anti").unionByName(overlay)


def content_key(diff: DataFrame) -> DataFrame:
    """Project, content_key of a diff: equal for equal sets of entries, whatever their order. Sums of
    the entries' hashes stand for the set, so that they add up before the shuffle and no task has all
    entries of a project; the key is a hash of the sums and the number."""
    entry = F.sha2(F.concat_ws("\t", "op", "path", F.coalesce("content_hash", F.lit(""))), 256)
    part = lambda i: F.conv(F.substring(entry, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = diff.select("project", "path", "op", "content_hash").distinct().groupBy("project").agg(F.count("*").alias("n"), *(F.sum(part(i)).alias(f"s{i}") for i in range(4)))
    return sums.select("project", F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3"))), 256).alias("content_key"))


def evicted(slots: DataFrame, keep: int = 8) -> DataFrame:
    """Project, generation, last_used of the slots (same columns) beyond the ``keep`` used last; of
    equal times the greater generation counts as later. A null time is the earliest."""
    if keep < 0:
        raise ValueError("keep must not be negative")
    nth = F.row_number().over(Window.partitionBy("project").orderBy(F.col("last_used").desc_nulls_last(), F.desc("generation")))
    return slots.select("project", "generation", "last_used").distinct().withColumn("__n", nth).filter(F.col("__n") > keep).drop("__n")
