"""Configuration: defaults, files (global, then local over it), environment, presets by machine size."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EmbeddingConfig:
    provider: str = "hashing"
    model: str = "hashing"
    url: str | None = None
    dimension: int | None = None
    batch: int = 10


@dataclass(frozen=True)
class ChunkingConfig:
    min_tokens: int = 100
    max_tokens: int = 800
    overlap_sentences: int = 1
    include_images: bool = False
    rows_per_chunk: int = 50


@dataclass(frozen=True)
class StorageConfig:
    path: str = ".sedimark"
    read_only: bool = False


@dataclass(frozen=True)
class QueryConfig:
    top_k: int = 10
    mode: str = "Auto"
    context_chunks: int = 3


@dataclass(frozen=True)
class RuntimeConfig:
    mode: str = "auto"


@dataclass(frozen=True)
class Config:
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)
    query: QueryConfig = field(default_factory=QueryConfig)
    runtime: RuntimeConfig = field(default_factory=RuntimeConfig)


def expanded(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` by the environment; a name that isn't set stays."""
    env = dict(os.environ) if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), text)


def merged(base: Config, *layers: dict) -> Config:
    """Later layers win; unknown names are an error."""
    for layer in layers:
        for section, values in layer.items():
            if section not in {f.name for f in fields(base)}:
                raise ValueError(f"no such section: {section}")
            own = getattr(base, section)
            assert is_dataclass(own)
            base = replace(base, **{section: replace(own, **values)})
    return base


def load(global_path: str | None = None, local_path: str | None = None, env: dict[str, str] | None = None) -> Config:
    layers = []
    for p in (global_path, local_path):
        if p and os.path.exists(p):
            with open(p) as f:
                layers.append(json.loads(expanded(f.read(), env)))
    return merged(Config(), *layers)


def shown(config: Config) -> str:
    return json.dumps(asdict(config), indent=2)


# Tasks for each core, and bytes a scan task reads.
PRESETS = {"embedded": (1, 32 << 20), "desktop": (1, 128 << 20), "server": (3, 128 << 20)}


def runtime_mode(mode: str, cores: int) -> str:
    if mode != "auto":
        return mode
    return "embedded" if cores <= 2 else "server" if cores >= 16 else "desktop"


def apply_runtime(spark: SparkSession, mode: str = "auto") -> dict[str, str]:
    """Session settings for the machines at hand."""
    cores = spark.sparkContext.defaultParallelism
    factor, size = PRESETS[runtime_mode(mode, cores)]
    settings = {"spark.sql.shuffle.partitions": str(max(1, cores * factor)), "spark.sql.files.maxPartitionBytes": str(size), "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    return settings
