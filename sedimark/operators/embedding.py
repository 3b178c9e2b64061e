"""Embedding of chunks: providers, checks, and embedding only what isn't there yet."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from contextlib import nullcontext
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.errors import DimensionMismatch, EmbedError
from sedimark.operators.queueing import RateLimiter

# Dimensions of known models, by provider.
DEFAULT_DIMENSIONS = {"ollama": 768, "openai": 1536, "anthropic": 768, "gemini": 768}
MODEL_DIMENSIONS = {"text-embedding-3-large": 3072, "text-embedding-3-small": 1536, "text-embedding-ada-002": 1536, "gemini-embedding-001": 3072, "text-embedding-004": 768, "nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384}
#: Answers that say "not now": out of time, in conflict, too early, too many requests, and every fault of the server.
PASSING = {408, 409, 425, 429}


class Embedder(Protocol):
    """Texts to vectors of one dimension. Instances are sent to executors, so they hold no connection."""

    dimension: int
    model: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed feature hashing of words: the same vectors everywhere, without a network."""

    dimension: int = 64
    model: str = "hashing"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimension)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                v[(h >> 1) % self.dimension] += 1.0 if h & 1 else -1.0
            out.append(unit(v).tolist())
        return out

    def __call__(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


@dataclass(frozen=True)
class FixedEmbedder:
    """One direction for every text and nothing for blank ones: for tests of what surrounds an embedder."""

    dimension: int = 4
    model: str = "fixed"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[2.0] + [0.0] * (self.dimension - 1) if t.strip() else [0.0] * self.dimension for t in texts]

    def __call__(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


@dataclass(frozen=True)
class HttpEmbedder:
    """A provider with an HTTP interface; ``kind`` names its wire format."""

    kind: str
    model: str
    dimension: int
    url: str
    key: str | None = None
    timeout: float = 30.0

    def _post(self, path: str, body: dict, headers: dict[str, str]):
        request = urllib.request.Request(self.url.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)
        except (OSError, ValueError) as e:
            raise EmbedError(f"{self.kind}: {e}") from e

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        match self.kind:
            case "ollama":
                found = self._post("/api/embed", {"model": self.model, "input": texts}, {})["embeddings"]
            case "gemini":
                requests = [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}} for t in texts]
                found = [e["values"] for e in self._post(f"/models/{self.model}:batchEmbedContents", {"requests": requests}, {"x-goog-api-key": self.key or ""})["embeddings"]]
            case "openai" | "anthropic":
                auth = {"Authorization": f"Bearer {self.key}"} if self.kind == "openai" else {"x-api-key": self.key or ""}
                rows = self._post("/embeddings", {"model": self.model, "input": texts}, auth)["data"]
                found = [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]
            case _:
                raise EmbedError(f"no such provider: {self.kind}")
        return checked(found, len(texts), self.dimension)

    def __call__(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


def checked(vectors: list[list[float]], count: int, dimension: int) -> list[list[float]]:
    """The vectors at unit length; a wrong number or length is an error, nothing is cut."""
    if len(vectors) != count:
        raise EmbedError(f"{len(vectors)} vectors for {count} texts")
    for v in vectors:
        if len(v) != dimension:
            raise DimensionMismatch(f"{len(v)} instead of {dimension}")
    return [unit(np.asarray(v, float)).tolist() for v in vectors]


def resolve_dimension(provider: str, model: str, asked: int | None = None, configured: int | None = None) -> int:
    return asked or configured or MODEL_DIMENSIONS.get(model) or DEFAULT_DIMENSIONS.get(provider, 768)


def create_embedder(provider: str, model: str, url: str | None = None, key: str | None = None, dimension: int | None = None) -> Embedder:
    provider = provider.lower()
    size = resolve_dimension(provider, model, dimension)
    if provider == "hashing":
        return HashingEmbedder(dimension or 64)
    urls = {"ollama": "http://localhost:11434", "openai": "https://api.openai.com/v1", "anthropic": "https://api.anthropic.com/v1", "gemini": "https://generativelanguage.googleapis.com/v1beta"}
    if provider not in urls:
        raise EmbedError(f"no such provider: {provider}")
    key = key or os.environ.get(f"{provider.upper()}_API_KEY")
    if provider != "ollama" and not key:
        raise EmbedError(f"{provider} needs a key")
    return HttpEmbedder(provider, model, size, url or urls[provider], key)


@dataclass(frozen=True)
class RetryPolicy:
    """Retries of errors that may pass, each after twice the time."""

    retries: int = 3
    first_seconds: float = 0.1
    most_seconds: float = 30.0

    def delay(self, n: int) -> float:
        return min(self.most_seconds, self.first_seconds * 2**n)

    @staticmethod
    def is_transient(error: BaseException | None) -> bool:
        """Whether the error, or what caused it, is one of the network or an answer that may be another next time."""
        while error is not None:
            if isinstance(error, urllib.error.HTTPError):
                return error.code in PASSING or error.code >= 500
            if isinstance(error, (TimeoutError, ConnectionError, urllib.error.URLError)):
                return True
            error = error.__cause__
        return False

    def call(self, f, *args):
        for n in range(self.retries + 1):
            try:
                return f(*args)
            except Exception as e:
                if n == self.retries or not self.is_transient(e):
                    raise
                time.sleep(self.delay(n))


def missing(chunks: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Chunks whose (content hash, model) isn't stored; ``chunks`` has ``content``."""
    known = stored.where(F.col("model") == model).select("content_hash").distinct()
    return chunks.withColumn("content_hash", F.sha2("content", 256)).join(known, "content_hash", "left_anti")


def embed_texts(chunks: DataFrame, embedder: Embedder, batch: int = 10, retry: RetryPolicy = RetryPolicy(), per_minute: int | None = None) -> DataFrame:
    """(content_hash, embedding, model, dimension, error): each distinct content once, in batches; a failed batch has errors and the rest goes on.

    ``per_minute`` is the number of batches that a task may send in a minute.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = RateLimiter(per_minute) if per_minute else nullcontext()
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                vectors, error = [None] * part.num_rows, None
                try:
                    with limiter:
                        vectors = checked(retry.call(embedder.embed_batch, part.column(1).to_pylist()), part.num_rows, embedder.dimension)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array([embedder.model] * n), pa.array([embedder.dimension] * n, pa.int64()), pa.array([error] * n, pa.string())], names=["content_hash", "embedding", "model", "dimension", "error"])

    distinct = chunks.where(F.col("content").isNotNull()).groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.first("content").alias("content"))
    return distinct.mapInArrow(run, "content_hash string, embedding array<float>, model string, dimension long, error string")


def index_chunks(chunks: DataFrame, stored: DataFrame, embedder: Embedder, reindex: bool = False, batch: int = 10) -> DataFrame:
    """Every chunk with ``embedding`` and ``status``: skipped (its content is stored), embedded or failed."""
    hashed = chunks.where(F.col("content").isNotNull()).drop("embedding", "model", "dimension", "content_hash").withColumn("content_hash", F.sha2("content", 256))
    known = stored.where((F.col("model") == embedder.model) & F.col("embedding").isNotNull()).groupBy("content_hash").agg(F.first("embedding").alias("old"))
    met = hashed.join(known.limit(0) if reindex else known, "content_hash", "left")
    new = embed_texts(met.where(F.col("old").isNull()), embedder, batch)
    full = met.join(new.select("content_hash", "embedding", "error"), "content_hash", "left")
    status = F.when(F.col("old").isNotNull(), "skipped").when(F.col("embedding").isNotNull(), "embedded").otherwise("failed")
    return full.withColumns({"status": status, "embedding": F.coalesce("old", "embedding"), "model": F.lit(embedder.model), "dimension": F.lit(embedder.dimension).cast("long")}).drop("old")


def index_report(indexed: DataFrame) -> DataFrame:
    """One row: total, embedded, skipped, failed."""
    return indexed.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("embedded", "skipped", "failed")])
