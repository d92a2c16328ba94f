"""Engine settings: one frozen object, passed explicitly."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from .errors import ConfigError


@dataclass(frozen=True)
class EngineConfig:
    max_chunk_chars: int = 2000
    chunk_overlap: int = 200
    min_chunk_chars: int = 120
    min_record_chars: int = 10
    child_chunk_chars: int = 300
    embedding_dimensions: int = 1536
    embed_batch_size: int = 64
    context_prefix_chars: int = 160
    search_child_k: int = 30
    search_parent_k: int = 5
    fact_limit: int = 40
    store_partitions: int = 64

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        """``KG_<FIELD>`` variables override the defaults."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f"KG_{f.name.upper()}", "").strip()
            if raw:
                try:
                    found[f.name] = int(raw) if f.type == "int" else raw.lower() in ("1", "true", "yes")
                except ValueError:
                    raise ConfigError(f"KG_{f.name.upper()} is not a number: {raw!r}") from None
        return cls(**found)


def required(name: str, env: dict[str, str] | None = None) -> str:
    """A setting that must be there; values that look like placeholders count as missing."""
    value = (os.environ if env is None else env).get(name, "").strip()
    if not value or value.startswith("change-me") or value.endswith("..."):
        raise ConfigError(f"Missing config: {name}")
    return value
