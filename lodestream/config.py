"""Strict configuration: unknown keys and values out of range fail at once.

Section and field names and their defaults are fixed values: the public contract of a configuration file.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_type_hints


def _choice(value: str, allowed: tuple[str, ...], name: str) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")


@dataclass(frozen=True)
class Chunker:
    type: str = "structure"
    max_tokens: int = 400
    overlap: int = 60

    def __post_init__(self) -> None:
        _choice(self.type, ("fixed", "structure"), "chunker.type")
        if self.overlap >= self.max_tokens:
            raise ValueError("overlap must be smaller than max_tokens")


@dataclass(frozen=True)
class Embedder:
    model: str = "hashed-ngrams"


@dataclass(frozen=True)
class Retrieval:
    dense: bool = True
    dense_k: int = 50
    sparse: bool = True
    sparse_k: int = 50
    fusion: str = "rrf"
    rrf_k: int = 60
    alpha: float = 0.5
    rerank: bool = True
    rerank_candidates: int = 30
    rerank_threshold: float | None = None
    rerank_threshold_mode: str = "gate"
    k_final: int = 6
    mmr: bool = False
    mmr_lambda: float = 0.7
    small_to_big: bool = False
    small_to_big_max_tokens: int = 1200
    reorder: bool = False
    current_only: bool = True

    def __post_init__(self) -> None:
        _choice(self.fusion, ("rrf", "weighted"), "retrieval.fusion")
        _choice(self.rerank_threshold_mode, ("gate", "filter"), "retrieval.rerank_threshold_mode")


@dataclass(frozen=True)
class Routing:
    router: str = "rules"
    model: str = "router"
    fallback: str | None = None

    def __post_init__(self) -> None:
        _choice(self.router, ("none", "rules", "model"), "routing.router")


@dataclass(frozen=True)
class Data:
    sql_max_repairs: int = 2
    sql_timeout_s: float = 5.0
    max_rows: int = 1000


@dataclass(frozen=True)
class Pipeline:
    name: str
    chunker: Chunker = field(default_factory=Chunker)
    embedder: Embedder = field(default_factory=Embedder)
    retrieval: Retrieval = field(default_factory=Retrieval)
    routing: Routing = field(default_factory=Routing)
    data: Data = field(default_factory=Data)

    @property
    def chunk_set(self) -> str:
        return f"{self.chunker.type}-{self.chunker.max_tokens}-{self.chunker.overlap}"

    @property
    def collection(self) -> str:
        """Chunk set and embedder together: another model gets a collection of its own."""
        return f"{self.chunk_set}__{self.embedder.model.rpartition('/')[2].lower()}"


def build(cls: type, values: dict[str, Any] | None) -> Any:
    """An instance of a configuration class from plain values."""
    values, kinds = dict(values or {}), get_type_hints(cls)
    if unknown := sorted(set(values) - set(kinds)):
        raise ValueError(f"unknown key in {cls.__name__}: {', '.join(unknown)}")
    for k, v in values.items():
        if dataclasses.is_dataclass(kinds[k]):
            values[k] = build(kinds[k], v)
    return cls(**values)


def load(path: str | Path) -> Pipeline:
    import yaml

    return build(Pipeline, yaml.safe_load(Path(path).read_text(encoding="utf-8")))
