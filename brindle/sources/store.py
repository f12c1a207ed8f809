"""The index on disk.

A snapshot is a folder of Parquet tables; it stands once a head, a small JSON file with a rising number, names
it. Heads are written aside and renamed, so a reader sees a whole snapshot or the one before it. All files go
through Hadoop's file systems, as on a cluster.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the reference's index begins with and its version.
MAGIC, SCHEMA_VERSION = "CIDXMAN1", 2
CHUNKS = "project string, path string, pos_in_file int, start_line int, end_line int, kind string, symbol string, signature string, doc string, embedding array<float>, ordinal bigint"
FILES = "project string, path string, length bigint, mtime timestamp, content_hash string"
#: Heads that are kept; older snapshots are deleted.
KEEP = 2


class Corrupt(RuntimeError):
    """A stored index that can't be used."""


@dataclass(frozen=True)
class Header:
    model: str
    dimensions: int
    chunk_count: int = 0
    generation: int = 0
    built_at: str = ""
    checksum: int = 0
    folder: str = ""
    magic: str = MAGIC
    schema_version: int = SCHEMA_VERSION

    def compatible(self, model: str, dimensions: int) -> bool:
        """I10."""
        return (self.magic, self.schema_version, self.model, self.dimensions) == (MAGIC, SCHEMA_VERSION, model, dimensions)


@dataclass(frozen=True)
class Snapshot:
    header: Header
    chunks: DataFrame
    files: DataFrame


class Folder:
    """A folder in any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(at).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, under: str) -> list[str]:
        p = self._path(f"{self.at}/{under}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.at}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All of it or nothing; an error if the file is there."""
        aside, to = self._path(f"{self.at}/_aside/{uuid.uuid4().hex}"), self._path(f"{self.at}/{name}")
        stream = self._fs.create(aside)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.mkdirs(to.getParent())
        if self._fs.exists(to) or not self._fs.rename(aside, to):
            self._fs.delete(aside, False)
            raise FileExistsError(name)

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(f"{self.at}/{name}" if name else self.at), True)

    def size(self) -> int:
        p = self._path(self.at)
        return self._fs.getContentSummary(p).getLength() if self._fs.exists(p) else 0


def _checksum(chunks: DataFrame) -> tuple[int, int, int]:
    """Rows, rows whose embedding hasn't the common length, and a sum over ordinals and embeddings."""
    r = chunks.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.sum(F.pmod(F.xxhash64("ordinal", "embedding"), F.lit(2**31))).alias("s")).first()
    return r.n, -1 if r.n and r.a != r.b else (r.a or 0), r.s or 0


class IndexStore:
    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.folder = spark, Folder(spark, at)

    def _heads(self) -> list[str]:
        return [n for n in self.folder.names("heads") if n.endswith(".json")]

    def save(self, snapshot: Snapshot) -> Snapshot:
        """Writes the tables, checks them (S13), then the head. Gives the snapshot as stored."""
        name = f"data/{uuid.uuid4().hex}"
        at = f"{self.folder.at}/{name}"
        if snapshot.header.dimensions < 1:
            raise ValueError("dimensions must be positive")
        snapshot.chunks.select(*(c.split()[0] for c in CHUNKS.split(", "))).write.parquet(f"{at}/chunks")
        snapshot.files.select(*(c.split()[0] for c in FILES.split(", "))).write.parquet(f"{at}/files")
        n, size, checksum = _checksum(self.spark.read.schema(CHUNKS).parquet(f"{at}/chunks"))
        if n and size != snapshot.header.dimensions:
            self.folder.delete(name)
            raise ValueError(f"embeddings must have {snapshot.header.dimensions} components")
        header = replace(snapshot.header, chunk_count=n, checksum=checksum, folder=name)
        heads = self._heads()
        number = int(heads[-1].removesuffix(".json")) + 1 if heads else 0
        self.folder.write(f"heads/{number:012d}.json", json.dumps(asdict(header)))
        for old in heads[: max(0, len(heads) + 1 - KEEP)]:
            try:
                gone = json.loads(self.folder.read(f"heads/{old}")).get("folder")
            except ValueError:
                gone = None
            self.folder.delete(f"heads/{old}")
            if gone and gone != name:
                self.folder.delete(gone)
        return self._tables(header)

    def _tables(self, header: Header) -> Snapshot:
        at = f"{self.folder.at}/{header.folder}"
        return Snapshot(header, self.spark.read.schema(CHUNKS).parquet(f"{at}/chunks"), self.spark.read.schema(FILES).parquet(f"{at}/files"))

    def header(self) -> Header | None:
        """The head that stands, None if there is none; an error if it can't be read."""
        heads = self._heads()
        if not heads:
            return None
        try:
            doc: dict[str, Any] = json.loads(self.folder.read(f"heads/{heads[-1]}"))
            header = Header(**doc)
        except (ValueError, TypeError) as e:
            raise Corrupt(f"the head can't be read: {e}") from e
        if header.magic != MAGIC or not isinstance(header.dimensions, int) or header.dimensions < 1 or not header.folder:
            raise Corrupt("the head is no index's")
        return header

    def load(self, verify: bool = True) -> Snapshot | None:
        """The snapshot that stands, None if there is none. With ``verify`` its tables are held
        against the head: rows, components, checksum, and fields that must not be null."""
        header = self.header()
        if header is None:
            return None
        try:
            snapshot = self._tables(header)
            if verify:
                if _checksum(snapshot.chunks) != (header.chunk_count, header.dimensions if header.chunk_count else 0, header.checksum):
                    raise Corrupt("the chunks aren't those of the head")
                required = [F.col(c).isNull() for c in ("path", "kind", "symbol", "signature", "doc", "embedding", "ordinal")]
                if not snapshot.chunks.filter(F.greatest(*required)).isEmpty() or not snapshot.files.filter(F.col("path").isNull()).isEmpty():
                    raise Corrupt("a field that must not be null is")
            return snapshot
        except Corrupt:
            raise
        except Exception as e:  # what Spark raises for missing or broken files
            raise Corrupt(f"the index can't be read: {type(e).__name__}") from e

    def delete(self) -> None:
        """S15."""
        self.folder.delete()

    def size_bytes(self) -> int:
        """S15."""
        return self.folder.size()


class Registry:
    """The overlays' slots as JSON documents with rising numbers; one that can't be read is an empty
    registry."""

    EMPTY: dict[str, Any] = {"slots": [], "active": None, "next": 0}

    def __init__(self, folder: Folder):
        self.folder = folder

    def load(self) -> dict[str, Any]:
        names = self.folder.names("registry")
        try:
            doc = json.loads(self.folder.read(f"registry/{names[-1]}")) if names else {}
            return self.EMPTY | doc if isinstance(doc.get("slots", []), list) else dict(self.EMPTY)
        except (ValueError, AttributeError):
            return dict(self.EMPTY)

    def save(self, doc: dict[str, Any]) -> None:
        names = self.folder.names("registry")
        number = int(names[-1].removesuffix(".json")) + 1 if names else 0
        self.folder.write(f"registry/{number:012d}.json", json.dumps(doc))
        for old in names:
            self.folder.delete(f"registry/{old}")
