"""Embeddings of texts by a service, in batches, checked and normalised."""

from __future__ import annotations

import hashlib
import json
import math
import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: texts a request.
BATCH = 16
#: Texts -> vectors; what a service or a test's stand-in offers. It runs in the tasks, so it must be picklable.
Embedder = Callable[[list[str]], list[list[float]]]


class EmbeddingUnavailable(RuntimeError):
    """The service can't be reached or answers what can't be used."""


@dataclass(frozen=True)
class HttpEmbedder:
    """A service that takes POST {endpoint}/api/embed with model and input and gives embeddings."""

    endpoint: str
    model: str
    timeout: float = 120.0
    tries: int = 3

    def __post_init__(self) -> None:
        """X12."""
        u = urlparse(self.endpoint)
        if u.scheme not in ("http", "https") or not u.netloc:
            raise ValueError("the endpoint must be an absolute address")
        if not self.model.strip():
            raise ValueError("the model must not be blank")

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self.endpoint.rstrip("/") + "/api/embed", body, {"Content-Type": "application/json"})
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)["embeddings"]
            except (OSError, ValueError, KeyError) as e:
                if n + 1 == self.tries:
                    raise EmbeddingUnavailable(f"the embedding service failed: {e}") from e
                time.sleep(0.5 * 2**n)
        raise EmbeddingUnavailable("no try is allowed")


@dataclass(frozen=True)
class HashEmbedder:
    """A stand-in without a service: a text's words decide the vector."""

    dimensions: int = 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        out = [0.0] * self.dimensions
        for word in text.lower().split():
            r = random.Random(hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest())
            out = [x + r.gauss(0, 1) for x in out]
        return out


def normalised(vector: list[float], dimensions: int) -> list[float]:
    """The first components at length one; a zero vector stays; others that can't be scaled are errors."""
    if vector is None or len(vector) < dimensions:
        raise EmbeddingUnavailable(f"a vector has {0 if vector is None else len(vector)} components, not {dimensions}")
    cut = [float(x) for x in vector[:dimensions]]
    if not all(map(math.isfinite, cut)):
        raise EmbeddingUnavailable("a vector isn't finite")
    if not any(cut):
        return cut
    length = math.sqrt(sum(x * x for x in cut))
    if not 0 < length < math.inf:
        raise EmbeddingUnavailable("a vector's length can't be expressed")
    return [x / length for x in cut]


def embed(texts: list[str], embedder: Embedder, dimensions: int) -> list[list[float]]:
    """In batches of BATCH; each answer must have a vector for each text."""
    out: list[list[float]] = []
    for a in range(0, len(texts), BATCH):
        some = texts[a : a + BATCH]
        got = embedder(some)
        if got is None or len(got) != len(some):
            raise EmbeddingUnavailable(f"{0 if got is None else len(got)} vectors for {len(some)} texts")
        out += [normalised(v, dimensions) for v in got]
    return out


def embed_query(text: str, embedder: Embedder, dimensions: int, prefix: str | None = None) -> list[float]:
    """A query is embedded behind its prefix, word for word; passages never are."""
    return embed([(prefix or "") + text], embedder, dimensions)[0]


def with_embeddings(chunks: DataFrame, embedder: Embedder, dimensions: int) -> DataFrame:
    """The chunks with ``embedding`` in place of ``embed_text``, by Arrow batches in the tasks."""
    kept = [f for f in chunks.schema.fields if f.name != "embed_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embed([t or "" for t in batch.column("embed_text").to_pylist()], embedder, dimensions)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(vectors, pa.list_(pa.float32()))], names=[*(f.name for f in kept), "embedding"])

    return chunks.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", embedding array<float>")
