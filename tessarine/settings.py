"""Settings from the environment, typed; what cannot be read is the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

# What stands for true and for false.
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 500
    chunk_overlap: int = 50
    top_k: int = 4
    probe_factor: int = 4
    hyq_questions: int = 3
    summary_words: int = 40
    embedding_dim: int = 64
    keyword_weight: float = 1.2
    hybrid: bool = True
    collection: str = "chunks"


def _read(raw: str, default):
    text = raw.strip()
    if isinstance(default, bool):
        return True if text.lower() in TRUE else False if text.lower() in FALSE else default
    if isinstance(default, str):
        return text or default
    try:
        return type(default)(text)
    except ValueError:
        return default


def from_environment(env: Mapping[str, str] = os.environ, prefix: str = "TESSARINE_") -> Settings:
    """Each field from the variable of its name in capitals behind the prefix."""
    given = {f.name: _read(env[key], f.default) for f in fields(Settings) if (key := prefix + f.name.upper()) in env}
    return Settings(**given)
