"""Problem 3: what changed between consecutive full snapshots.

Rows are reduced to compact records (two 64-bit hashes of the key, the snapshot's place in its
project, delivery time, hash of the content hash) that are shuffled by key and ordered by a bucket of
it. In each bucket numpy sorts the records; set differences of consecutive snapshots are searches in
the sorted array. Only the differing keys are joined with the table again for their full values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import normal_path

#: Buckets that each shuffle partition is processed in; the rows of one are in memory at a time.
BUCKETS = 64
CHANGES = ("added", "removed", "changed")
_COLUMNS = ("bucket", "k1", "k2", "place", "last", "delivered", "value")


def _places(headers: DataFrame) -> DataFrame:
    """project, generation, place (1, 2, ... by generation) and last, the number of generations."""
    seen = headers.select("project", "generation").dropna().distinct()
    w = Window.partitionBy("project")
    return seen.select("project", "generation", F.row_number().over(w.orderBy("generation")).alias("place"), F.count("*").over(w).cast("int").alias("last"))


def _differences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Changes of one bucket, rows being its records by column: (index of a record of the key, place
    of the change, change, place of the snapshot that has the record)."""
    k1, k2, place, last, delivered, value = rows
    order = np.lexsort((value, delivered, place, k2, k1))
    k1, k2, place, last, value = k1[order], k2[order], place[order], last[order], value[order]
    new_key = np.ones(len(k1), bool)
    new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    keep = np.ones(len(k1), bool)  # the row delivered last of a key in a snapshot
    keep[:-1] = new_key[1:] | (place[1:] != place[:-1])
    key = np.cumsum(new_key)[keep]
    index, place, last, value = order[keep], place[keep], last[keep], value[keep]
    span = np.int64(place.max(initial=0) + 2)
    code = key * span + place
    n = len(code)

    def present(wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(code, wanted)
        return (at < n) & (code[np.minimum(at, n - 1)] == wanted)

    before = present(code - 1)
    added = ~before & (place > 1)
    removed = ~present(code + 1) & (place < last)
    # the last content known before each record, since the path was added
    known = value != 0
    here = np.arange(n)
    run = np.maximum.accumulate(np.where(before, 0, here))
    seen = np.maximum.accumulate(np.where(known, here, -1))
    prior = np.concatenate(([-1], seen[:-1]))
    changed = before & known & (prior >= run) & (value != value[np.maximum(prior, 0)])
    at = np.concatenate([np.flatnonzero(x) for x in (added, removed, changed)])
    what = np.repeat(np.arange(3), [added.sum(), removed.sum(), changed.sum()])
    return index[at], place[at] + (what == 1), what, place[at]


def _bucket_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records come ordered by bucket; a bucket is processed once the next begins."""
    parts: list[np.ndarray] = []
    current = None

    def flush() -> Iterator[pa.RecordBatch]:
        if parts:
            rows = np.concatenate(parts, axis=1)
            parts.clear()
            index, place, what, at = _differences(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0][index]), pa.array(rows[1][index]), pa.array(at.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(np.array(CHANGES, object)[what], pa.string())],
                names=["k1", "k2", "place", "change_place", "change"],
            )

    for batch in batches:
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _COLUMNS[1:]])
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            if a == b:
                continue
            if bucket[a] != current:
                yield from flush()
                current = bucket[a]
            parts.append(rows[:, a:b])
    yield from flush()


def snapshot_changes(fingerprints: DataFrame, headers: DataFrame) -> DataFrame:
    """project, generation, path, change: what is ``added``, ``removed`` or ``changed`` in a snapshot
    compared with the project's previous generation in ``headers``.

    Of several rows of a path in a generation the one delivered last stands (null times count as
    earliest; at the same time, any one but always the same). Hashes compare without regard to case; a
    null hash is a file that could not be read and is no change by itself: contents compare with the
    last hash known since the path was added. A generation of ``headers`` without rows is an empty
    snapshot. Rows of generations that ``headers`` doesn't have, and rows with a null project,
    generation or path, belong to no snapshot. Empty tables give no rows.
    """
    path = normal_path("path")
    rows = fingerprints.select("project", "generation", path.alias("path"), "content_hash", "delivered_at").dropna(subset=["project", "generation", "path"])
    keyed = rows.withColumns({"k1": F.xxhash64("project", "path"), "k2": F.xxhash64("path", F.lit(7), "project")})
    placed = keyed.join(_places(headers), ["project", "generation"])
    known = F.xxhash64(F.lower("content_hash"))
    records = placed.select(
        F.pmod(F.shiftright("k2", 7), F.lit(BUCKETS)).cast("int").alias("bucket"),
        "k1", "k2", "place", "last",
        F.coalesce(F.unix_micros(F.col("delivered_at").cast("timestamp")), F.lit(-(2**62))).alias("delivered"),
        F.when(F.col("content_hash").isNull(), 0).when(known == 0, 1).otherwise(known).alias("value"),
    )
    changes = (
        records.repartition("k1")
        .sortWithinPartitions("bucket")
        .mapInArrow(_bucket_changes, "k1 bigint, k2 bigint, place int, change_place int, change string")
    )
    full = placed.select("k1", "k2", "place", "project", "path")
    generations = _places(headers).select("project", F.col("place").alias("change_place"), F.col("generation").alias("generation"))
    return (
        changes.join(full, ["k1", "k2", "place"])
        .dropDuplicates(["k1", "k2", "change_place"])
        .join(generations, ["project", "change_place"])
        .select("project", "generation", "path", "change")
    )


def change_counts(fingerprints: DataFrame, headers: DataFrame) -> DataFrame:
    """added, removed and changed paths per project and generation that has any."""
    changes = snapshot_changes(fingerprints, headers)
    return changes.groupBy("project", "generation").agg(*(F.count_if(F.col("change") == c).alias(c) for c in CHANGES))


#: The same changes in SQL, for comparison.
CHANGES_SQL = r"""
WITH g AS (SELECT project, generation, row_number() OVER (PARTITION BY project ORDER BY generation) AS place
           FROM (SELECT DISTINCT project, generation FROM index_headers)),
f AS (SELECT project, generation, regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') AS path, lower(content_hash) AS h, delivered_at
      FROM fingerprints WHERE path IS NOT NULL),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, generation, path ORDER BY delivered_at DESC NULLS LAST, h DESC NULLS LAST) AS n FROM f) WHERE n = 1),
p AS (SELECT r.project, r.path, r.h, g.place FROM r JOIN g USING (project, generation)),
q AS (SELECT *, coalesce(lag(place) OVER w <> place - 1, true) AS fresh, coalesce(lead(place) OVER w <> place + 1, true) AS ends
      FROM p WINDOW w AS (PARTITION BY project, path ORDER BY place)),
s AS (SELECT *, sum(fresh::int) OVER (PARTITION BY project, path ORDER BY place) AS run FROM q),
t AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY project, path, run ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM s),
c AS (SELECT project, path, place, 'added' AS change FROM t WHERE fresh AND place > 1
      UNION ALL SELECT project, path, place + 1, 'removed' FROM t WHERE ends
      UNION ALL SELECT project, path, place, 'changed' FROM t WHERE NOT fresh AND h <> known)
SELECT c.project, g.generation, c.path, c.change FROM c JOIN g ON c.project = g.project AND c.place = g.place
"""
