"""Files of a source tree.

The driver walks directories (names and stats only); texts are read by the tasks, so the tree must be at the
same place on every executor, as a shared folder is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import EXCLUDED, EXTENSIONS

#: Fixed value: how deep a walk goes.
DEPTH = 128
#: Paths that one task reads.
PER_TASK = 2_000


class OutsideRoot(ValueError):
    """A path that leads out of its tree."""


def walk(root: str, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = EXCLUDED) -> Iterator[tuple[str, int, float]]:
    """(path, length, mtime) of the indexed files below a root, in no order; paths have ``/``. Symbolic
    links aren't followed, unreadable directories are skipped, directories other than the root that hold
    ``.git`` are repositories of their own and left out, and so is what lies deeper than DEPTH."""
    ends, out = tuple(e.lower() for e in extensions), frozenset(e.lower() for e in excluded)
    todo = [("", 0)] if ends else []
    while todo:
        at, depth = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, at)))
        except OSError:
            continue
        if at and any(e.name == ".git" for e in entries):
            continue
        for e in entries:
            path = f"{at}/{e.name}" if at else e.name
            try:
                if e.is_symlink() or e.name.lower() in out:
                    continue
                if e.is_dir(follow_symlinks=False):
                    if depth < DEPTH:
                        todo.append((path, depth + 1))
                elif e.is_file(follow_symlinks=False) and e.name.lower().endswith(ends):
                    s = e.stat(follow_symlinks=False)
                    yield path, s.st_size, s.st_mtime
            except OSError:
                continue


def resolve(root: str, path: str) -> str:
    """A file's place; an error if it or a link on the way leads out of the root."""
    top = os.path.realpath(root)
    full = os.path.realpath(os.path.join(top, path))
    if os.path.isabs(path) or os.path.commonpath([top, full]) != top or full == top:
        raise OutsideRoot(path)
    return full


def read_text(root: str, path: str) -> str | None:
    """A file's text as UTF-8 (or UTF-16, by its byte order mark), the mark left out; bytes that are
    none become U+FFFD. None if it can't be read (X4)."""
    try:
        with open(resolve(root, path), "rb") as f:
            data = f.read()
    except OSError:
        return None
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(encoding, "replace")
    return data.decode("utf-8", "replace")


_STATS = "project string, path string, length bigint, mtime timestamp"


def stats(spark: SparkSession, project: str, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Project, path, length, mtime of the files of a tree. An unknown root has none."""
    found = sorted(walk(root, extensions))
    table = pa.table(
        [pa.array([project] * len(found)), pa.array([p for p, _, _ in found], pa.string()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([datetime.fromtimestamp(m, UTC) for _, _, m in found], pa.timestamp("us", "UTC"))],
        names=["project", "path", "length", "mtime"],
    )
    return spark.createDataFrame(table, _STATS).repartition(max(1, -(-len(found) // PER_TASK))) if len(found) > PER_TASK else spark.createDataFrame(table, _STATS)


def with_texts(files: DataFrame, root: str) -> DataFrame:
    """The files (project, path, length, mtime) with their text, read by the tasks; null where a file
    can't be read or leads out of the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path in batch.column("path").to_pylist():
                try:
                    texts.append(read_text(root, path))
                except OutsideRoot:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("project", "path", "length", "mtime")), pa.array(texts, pa.string())], names=["project", "path", "length", "mtime", "text"])

    return files.select("project", "path", "length", "mtime").mapInArrow(run, _STATS + ", text string")


def in_memory(spark: SparkSession, project: str, texts: dict[str, str]) -> DataFrame:
    """A tree that a test holds in memory."""
    rows = [(project, p, len(t.encode()), t) for p, t in sorted(texts.items())]
    return spark.createDataFrame(rows, "project string, path string, length bigint, text string").select("project", "path", "length", F.lit(0).cast("timestamp").alias("mtime"), "text")
