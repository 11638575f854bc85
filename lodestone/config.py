"""Parameters of the service, from the environment where they are set there."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Settings:
    """What the question-answering loop goes by. Without `embeddings` the local search goes by terms alone, without
    `rerank` its hits stay in the order of their weighted scores."""

    pool: int = 50
    candidates: int = 20
    k: int = 10
    threshold: float = 0.7
    min_score: float = 0.3
    embeddings: bool = True
    rerank: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.k <= self.candidates <= 2 * self.pool:
            raise ValueError("k, candidates and pool have to grow in this order")


def _read(text: str, kind: Any) -> Any:
    if kind in (bool, "bool"):
        if text.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{text!r} is neither true nor false")
        return text.lower() in ("true", "1")
    return {"int": int, "float": float}[kind if isinstance(kind, str) else kind.__name__](text)


def from_env(env: Mapping[str, str] = os.environ, prefix: str = "LODESTONE_") -> Settings:
    """The settings whose names, in capitals after the prefix, the environment has; the others as they are."""
    return Settings(**{f.name: _read(env[name], f.type) for f in fields(Settings) if (name := prefix + f.name.upper()) in env})
