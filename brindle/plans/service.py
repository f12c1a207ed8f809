"""I1 to I21 and X2 to X8 put together: a project's index, built, refreshed and searched."""

from __future__ import annotations

import struct
import threading
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, lookup, overlay, search
from ..operators.csharp import chunk_files
from ..sources import tree
from ..sources.embedding import Embedder, EmbeddingUnavailable, HashEmbedder, HttpEmbedder, embed_query, with_embeddings
from ..sources.store import Corrupt, Folder, Header, IndexStore, Registry, Snapshot
from .config import Config, Project

KEY = index.KEY


class ServiceError(RuntimeError):
    """What a caller is told as an error."""


class UnknownProject(ServiceError):
    pass


class StaleId(ServiceError):
    pass


@dataclass
class Result:
    """Hits (rank, project, generation, chunk_id, ...) and whether something was missing."""

    hits: list[dict]
    degraded: bool = False
    warnings: list[str] = field(default_factory=list)


def _now() -> str:
    return datetime.now(UTC).isoformat()


class Index:
    """The index of one project. Builds and refreshes of one object run one after another."""

    def __init__(self, spark: SparkSession, project: Project, config: Config, embedder: Embedder):
        self.spark, self.project, self.config, self.embedder = spark, project, config, embedder
        at = config.cache_of(project)
        self.store = IndexStore(spark, f"{at}/base")
        self.slots, self.registry, self.stage = Folder(spark, f"{at}/slots"), Registry(Folder(spark, at)), Folder(spark, f"{at}/stage")
        self.gate, self.current = threading.RLock(), None

    # -- building -------------------------------------------------------------------------------
    def _found(self) -> DataFrame:
        return tree.stats(self.spark, self.project.id, self.project.root, self.project.extensions)

    def _made(self, files: DataFrame, at: str | None = None) -> DataFrame:
        """Chunks with embeddings of files (project, path, text), written to a folder and read from it, so
        that each text is embedded once, however often the rows are used and whichever executors are lost."""
        at = at or f"{self.stage.at}/{uuid.uuid4().hex}"
        with_embeddings(chunk_files(files), self.embedder, self.config.dimensions).write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def _save(self, chunks: DataFrame, files: DataFrame, generation: int) -> Snapshot:
        ordered = index.assign_ordinals(chunks.drop("ordinal"), "pos_in_file")
        return self.store.save(Snapshot(Header(self.config.model, self.config.dimensions, generation=generation, built_at=_now()), ordered, files))

    def rebuild(self) -> Snapshot:
        """Everything anew; all overlays are dropped. generation is the stored one's + 1, else 0."""
        with self.gate:
            try:
                old = self.store.header()
            except Corrupt:
                self.store.delete()
                old = None
            files = tree.with_texts(self._found(), self.project.root).withColumn("content_hash", T.content_hash("text")).persist()
            try:
                self.current = self._save(self._made(files), files, old.generation + 1 if old else 0)
            finally:
                files.unpersist()
                self.stage.delete()
            self.slots.delete()
            self.registry.save(dict(Registry.EMPTY))
            return self.current

    def refresh(self) -> Snapshot:
        """I2 to I5, I16 to I19. What is stored is taken, or built where there is none, it is broken (I11) or
        of another model (I10). If no stat differs it stays. Texts are read of files whose stat differs. Fewer
        than overlay_files changed files are folded into the index; more go to a slot by their content key,
        which is used again whenever the tree returns to that state."""
        with self.gate:
            if self.current is None:
                try:
                    self.current = self._composed(self.store.load())
                except Corrupt:
                    self.store.delete()
            old = self.current
            if old is None or not old.header.compatible(self.config.model, self.config.dimensions):
                return self.rebuild()
            found = self._found()
            stored = old.files.select(*KEY, "length", "mtime", F.col("content_hash").alias("old_hash"))
            both = found.join(stored.withColumnsRenamed({"length": "old_length", "mtime": "old_mtime"}), KEY, "full_outer")
            differs = ~(F.col("length").eqNullSafe(F.col("old_length")) & F.col("mtime").eqNullSafe(F.col("old_mtime")))
            if both.filter(differs).isEmpty():
                return old
            probe = both.filter(differs & F.col("length").isNotNull()).select(*KEY, "length", "mtime")
            read = tree.with_texts(probe, self.project.root).withColumn("content_hash", T.content_hash("text")).persist()
            try:
                now = found.join(read.select(*KEY, F.col("content_hash").alias("new_hash"), F.lit(True).alias("read")), KEY, "left").join(stored.select(*KEY, "old_hash"), KEY, "left")
                listing = now.select(*KEY, "length", "mtime", F.when(F.col("read"), F.col("new_hash")).otherwise(F.col("old_hash")).alias("content_hash")).persist()
                diff = index.fingerprint_diff(old.files, listing).persist()
                changed = diff.filter(F.col("status").isin(index.ADDED, index.CHANGED, index.DELETED)).count()
                if self.config.overlays and changed >= self.config.overlay_files:
                    self.current = self._diverged(old, listing)
                else:
                    fresh = self._made(read.join(diff.filter(F.col("status").isin(index.ADDED, index.CHANGED)), KEY, "left_semi"))
                    chunks = index.refreshed_chunks(old.chunks.drop("ordinal"), diff, fresh).drop("reused")
                    self.current = self._fold(old, chunks, listing)
                listing.unpersist()
                diff.unpersist()
            finally:
                read.unpersist()
                self.stage.delete()
            return self.current

    def _fold(self, old: Snapshot, chunks: DataFrame, listing: DataFrame) -> Snapshot:
        """The generation rises if a file's number of chunks changed, as ordinals then do. A slot
        that was active becomes part of the base."""
        chunks = chunks.persist()
        try:
            moved = not index.shape_changed(old.chunks, chunks).filter("changed").isEmpty()
            self._activate(None)
            return self._save(chunks, listing, old.header.generation + int(moved))
        finally:
            chunks.unpersist()

    # -- overlays -------------------------------------------------------------------------------
    def _activate(self, slot: str | None) -> None:
        doc = self.registry.load()
        for s in doc["slots"]:
            if s["id"] == slot:
                s["last_used"] = _now()
        if doc["active"] != slot or slot:
            self.registry.save(doc | {"active": slot})

    def _slot_table(self, slot: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.slots.at}/{slot}/{name}")

    def _composed(self, base: Snapshot | None) -> Snapshot | None:
        """The base under the active slot (I13). Listings and chunks are composed each for itself."""
        doc = self.registry.load()
        slot = next((s for s in doc["slots"] if s["id"] == doc["active"]), None)
        if base is None or slot is None:
            return base
        gone = self._slot_table(slot["id"], "gone")
        files = self._slot_table(slot["id"], "files")
        masked = gone.unionByName(files.select(*KEY))
        chunks = overlay.compose(base.chunks.drop("ordinal"), self._slot_table(slot["id"], "chunks").select(*(c for c in base.chunks.columns if c != "ordinal")), masked)
        header = Header(base.header.model, base.header.dimensions, generation=slot["generation"], built_at=slot["created"], folder=base.header.folder)
        return Snapshot(header, index.assign_ordinals(chunks, "pos_in_file"), overlay.compose(base.files, files, gone))

    def _diverged(self, old: Snapshot, listing: DataFrame) -> Snapshot:
        """The slot of this state of the tree, found by content key or made and stored; the slots that
        were used least lately are dropped."""
        base = self.store.load(verify=False)
        diff = overlay.extract_diff(base.files, listing).persist()
        doc = self.registry.load()
        row = overlay.content_key(diff).first()
        key = row.content_key if row else ""
        if not key:  # the tree is the base's again
            self._activate(None)
            diff.unpersist()
            return base
        slot = next((s for s in doc["slots"] if s["key"] == key), None)
        if slot is None:
            slot = {"id": f"{doc['next']:06d}", "key": key, "created": _now(), "generation": max([old.header.generation, *(s["generation"] for s in doc["slots"])]) + 1}
            files = listing.join(diff.filter(F.col("op") == overlay.FILE), KEY, "left_semi")
            at = f"{self.slots.at}/{slot['id']}"
            self._made(tree.with_texts(files, self.project.root), f"{at}/chunks")
            files.write.mode("overwrite").parquet(f"{at}/files")
            diff.filter(F.col("op") == overlay.GONE).select(*KEY).write.mode("overwrite").parquet(f"{at}/gone")
            doc["next"] += 1
            doc["slots"].append(slot)
        slot["last_used"] = _now()
        kept = sorted(doc["slots"], key=lambda s: s["last_used"], reverse=True)[: self.config.max_overlays]
        out = [s for s in doc["slots"] if s not in kept]
        self.registry.save(doc | {"slots": kept, "active": slot["id"]})
        for s in out:
            self.slots.delete(s["id"])
        diff.unpersist()
        return self._composed(base)

    # -- reading --------------------------------------------------------------------------------
    def ready(self) -> tuple[Snapshot, list[str]]:
        """The refreshed snapshot, or the last good one and a warning."""
        try:
            return self.refresh(), []
        except Exception as e:
            if self.current is None:
                raise ServiceError(f"the index can't be built: {e}") from e
            return self.current, [f"The index could not be refreshed and may be stale: {type(e).__name__}: {e}"]

    def search(self, query: str, limit: int = 5, kind: str | None = None, path_filter: str | None = None) -> Result:
        """The flagship for one project, with excerpts and stale flags. Blank queries and negative limits are
        errors before anything is refreshed; a limit of 0 gives no hits."""
        if not query or not query.strip():
            raise ServiceError("the query must not be blank")
        if limit < 0:
            raise ServiceError("the limit must not be negative")
        snapshot, warnings = self.ready()
        if limit == 0:
            return Result([], bool(warnings), warnings)
        chunks = snapshot.chunks.withColumn("chunk_id", F.col("ordinal"))
        own, depth = search.candidates(chunks, kind, path_filter), max(search.DEPTH, limit)
        symbol = search.symbol_branch(own, query, depth)
        try:
            vector = embed_query(query, self.embedder, self.config.dimensions, self.config.query_prefix)
            vectors = own.select(F.col("chunk_id").alias("vec_id"), "embedding")
            branch = search.vector_branch(own, vectors, vector, depth, self.config.floor)
        except EmbeddingUnavailable as e:
            warnings = [*warnings, f"Embeddings are unavailable, results are by symbol only: {e}"]
            branch = symbol.select("chunk_id", F.lit(0.0).alias("score"), "rank").limit(0)
        top = search.diversify(search.fuse(branch, symbol, depth), own, limit)
        hits = F.broadcast(top.select("chunk_id", "rank", "score")).join(chunks.drop("embedding"), "chunk_id")  # at most limit rows
        stats = hits.select(*KEY).distinct().join(self._found(), KEY)
        shown = tree.with_texts(stats, self.project.root).withColumn("ingested_at", F.lit(0).cast("timestamp"))
        flagged = lookup.with_stale_flag(lookup.with_excerpt(hits, shown), snapshot.files, stats).withColumn("generation", F.lit(snapshot.header.generation))
        return Result([r.asDict() for r in flagged.orderBy("rank").collect()], bool(warnings), warnings)

    def chunk(self, generation: int, ordinal: int) -> dict | None:
        """A chunk with its whole text; an error for an id of another generation, None for one
        that isn't there."""
        snapshot, _ = self.ready()
        if generation != snapshot.header.generation:
            raise StaleId(f"the id is of generation {generation}, the index of {snapshot.header.generation}: search again")
        own = snapshot.chunks.filter(F.col("ordinal") == ordinal).drop("embedding").withColumnRenamed("ordinal", "chunk_id")
        row = own.first()
        if row is None:
            return None
        try:
            text = tree.read_text(self.project.root, row.path)
        except tree.OutsideRoot:
            text = None
        lines = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n") if text else []
        stats = own.select(*KEY).join(self._found(), KEY)
        stale = lookup.with_stale_flag(own, snapshot.files, stats).select("stale").first().stale
        return row.asDict() | {"generation": generation, "excerpt": "\n".join(lines[row.start_line - 1 : row.end_line]), "stale": stale}

    def status(self) -> dict:
        """Refreshed, without falling back."""
        s = self.refresh()
        return {"project": self.project.id, "generation": s.header.generation, "files": s.files.count(), "chunks": s.chunks.count(), "model": s.header.model, "dimensions": s.header.dimensions, "built_at": s.header.built_at, "bytes": self.store.size_bytes() + self.slots.size()}


class Engine:
    """All configured projects. One that fails doesn't break the others."""

    def __init__(self, spark: SparkSession, config: Config, embedder: Embedder | None = None):
        self.config = config.validate()
        embedder = embedder or (HttpEmbedder(config.endpoint, config.model) if config.endpoint else HashEmbedder(config.dimensions))
        self.indexes = {p.id: Index(spark, p, config, embedder) for p in config.projects}

    def of(self, project: str) -> Index:
        if project not in self.indexes:
            raise UnknownProject(f"unknown project {project!r}; configured: {', '.join(sorted(self.indexes)) or 'none'}")
        return self.indexes[project]

    def search(self, query: str, limit: int = 5, kind: str | None = None, path_filter: str | None = None, project: str | None = None) -> Result:
        """One project, or all of them merged by score (in single precision), project and chunk."""
        if project is not None:
            return self.of(project).search(query, limit, kind, path_filter)
        hits, warnings, degraded = [], [], False
        for name, own in self.indexes.items():
            try:
                r = own.search(query, limit, kind, path_filter)
            except Exception as e:
                warnings.append(f"{name}: {e}")
                continue
            hits += r.hits
            degraded |= r.degraded
            warnings += [f"{name}: {w}" for w in r.warnings]
        single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
        hits.sort(key=lambda h: (-single(h["score"]), h["project"], h["chunk_id"]))
        return Result(hits[:limit], degraded, warnings)
