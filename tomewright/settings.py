"""Settings: defaults, a TOML file with a local overlay beside it, and the ranges that are allowed."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class ChunkSettings:
    """Lengths in characters, pauses in milliseconds."""

    max_chars: int = 400
    sentence_ms: int = 300
    paragraph_ms: int = 400
    section_ms: int = 1200
    beat_ms: int = 600
    title_ms: int = 800
    orphan_chars: int = 20

    def __post_init__(self) -> None:
        if not 50 <= self.max_chars <= 600:
            raise ValueError("max_chars must be from 50 to 600")
        for f in fields(self):
            if f.name.endswith("_ms") and not 0 <= getattr(self, f.name) <= 10_000:
                raise ValueError(f"{f.name} must be from 0 to 10000")


def overlay(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Tables merge key by key, at any depth; other values and lists are replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = overlay(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_toml(path: str) -> dict[str, Any]:
    """The file at ``path`` under its overlay ``NAME.local.EXT``, if there is one."""
    p = Path(path)
    data = tomllib.loads(p.read_text())
    local = p.with_name(f"{p.stem}.local{p.suffix}")
    return overlay(data, tomllib.loads(local.read_text())) if local.exists() else data


def chunk_settings(data: dict[str, Any]) -> ChunkSettings:
    """The ``[chunk]`` table; unknown keys are an error."""
    table = data.get("chunk", {})
    unknown = set(table) - {f.name for f in fields(ChunkSettings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(ChunkSettings(), **table)


def output_path(given: str | None, env: str | None, configured: str, title_file: str) -> str:
    """Where the finished book goes: a path given, else the environment's folder, else the configured one; empty counts as unset."""
    return given or str(Path(env or configured) / f"{title_file}.m4b")


def check_adapt_mode(mode: str, model: str) -> None:
    """Only ``api`` can run by itself, and only with a model; anything else is an error."""
    if mode != "api":
        raise ValueError(f"adapt mode {mode!r} is not run here; only 'api' is")
    if not model:
        raise ValueError("adapt mode 'api' needs a model")
