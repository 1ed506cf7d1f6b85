"""Settings from environment variables, with defaults for what is unset or can't be read."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    segment_max_bytes: int = 104_857_600
    merge_trigger_ratio: float = 0.3
    checkpoint_ops: int = 1000
    cache_ttl_seconds: int = 300
    compression_algorithm: str = "zlib"
    compression_level: int = 1
    compression_min_size: int = 1024


def load(env: Mapping[str, str] | None = None, prefix: str = "SILTLOG_") -> Settings:
    """Numbers may be followed by other characters; a value that doesn't begin with one gives the default."""
    env, found = os.environ if env is None else env, {}
    for f in fields(Settings):
        raw = env.get(prefix + f.name.upper())
        if raw is None:
            continue
        kind = type(f.default)
        if kind is str:
            found[f.name] = raw
        elif m := re.match(r"[+-]?\d+" if kind is int else r"[+-]?\d+(\.\d+)?", raw):
            found[f.name] = kind(m[0])
    return Settings(**found)
