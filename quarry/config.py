"""Settings of the engine. Defaults are fixed values that results depend on."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass, fields

EPOCH = dt.datetime(1970, 1, 1)
SECRET_PARTS = ("key", "secret", "password", "token", "dsn")


@dataclass(frozen=True)
class ChunkSettings:
    target_tokens: int = 256
    max_tokens: int = 384
    overlap_tokens: int = 48
    parent_tokens: int = 1024
    version: str = "v1"
    model: str = "hash"
    dimensions: int = 1024
    model_max: int | None = None
    split_long: bool = True

    def clamped(self) -> ChunkSettings:
        """Limits cut to the model's own; the target never exceeds the most."""
        if self.target_tokens > self.max_tokens:
            raise ValueError("target_tokens exceeds max_tokens")
        if self.model_max and self.max_tokens > self.model_max:
            return ChunkSettings(min(self.target_tokens, self.model_max), self.model_max, self.overlap_tokens, self.parent_tokens, self.version, self.model, self.dimensions, self.model_max, self.split_long)
        return self


@dataclass(frozen=True)
class RetrievalSettings:
    rrf_k: int = 60
    dense_top_k: int = 50
    sparse_top_k: int = 50
    fused_top_k: int = 60
    channel_head: int = 10
    final_top_k: int = 5
    max_context_chars: int = 12000
    expand_siblings: bool = False
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if self.rrf_k <= 0:
            raise ValueError("rrf_k has to be positive")


@dataclass(frozen=True)
class QueueSettings:
    lease_seconds: int = 900
    max_attempts: int = 3
    batch_size: int = 4


def from_environment(kind: type, prefix: str = "QUARRY_"):
    """Settings of a kind with values from environment variables; empty text means unset."""
    found = {}
    for f in fields(kind):
        raw = os.environ.get(prefix + f.name.upper(), "")
        if raw != "":
            base = f.default
            found[f.name] = raw.lower() in ("1", "true", "yes") if isinstance(base, bool) else type(base)(raw) if base is not None else int(raw)
    return kind(**found)


def redacted(values: dict) -> dict:
    """A copy for logs, with secrets by key name hidden."""
    return {k: redacted(v) if isinstance(v, dict) else "***" if any(p in k.lower() for p in SECRET_PARTS) else v for k, v in values.items()}
