"""Configuration: YAML files laid over each other, placeholders, and typed settings.

Runs on the driver without Spark.  Unknown keys are errors, except in the chunk
and retrieval settings, which are stored with a knowledge base and may be newer.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml

from tessera.operators.chunk import Fixed, Layered


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class ModelConfig:
    name: str
    model: str
    base_url: str = ""
    api_key: str = ""
    batch_size: int = 32
    timeout_secs: int = 60
    max_retries: int = 3
    retry_delay_ms: int = 1000
    temperature: float = 0.2
    max_tokens: int = 512
    concurrency: int = 4


@dataclass(frozen=True)
class IndexConfig:
    kind: str = "hnsw"
    m: int = 16
    ef_construction: int = 64
    ef_search: int = 40


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 5
    expand: bool = False
    expand_depth: int = 2


@dataclass(frozen=True)
class WorkerConfig:
    worker_count: int = 2
    poll_secs: int = 30
    retry_secs: int = 5


@dataclass(frozen=True)
class AppConfig:
    store: str = "kb-store"
    embed: str = ""
    chunk: Layered | Fixed = field(default_factory=Layered)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    worker: WorkerConfig = field(default_factory=WorkerConfig)
    query_mode: str | None = None
    embedders: tuple[ModelConfig, ...] = ()
    llms: tuple[ModelConfig, ...] = ()
    rerankers: tuple[ModelConfig, ...] = ()

    def named(self, kind: str, name: str | None = None) -> ModelConfig:
        """The model of a name; without a name the only one that there is."""
        some = getattr(self, kind)
        if name is None:
            if len(some) != 1:
                raise ConfigError(f"name one of {kind}: {', '.join(sorted(m.name for m in some)) or 'none'}")
            return some[0]
        for m in some:
            if m.name == name:
                return m
        raise ConfigError(f"{kind} has no {name!r}; there are: {', '.join(sorted(m.name for m in some)) or 'none'}")

    def by_model(self, kind: str, model: str) -> ModelConfig:
        some = [m for m in getattr(self, kind) if m.model == model]
        if len(some) != 1:
            raise ConfigError(f"{kind} has {len(some)} entries of the model {model!r}")
        return some[0]


_PLACEHOLDER = re.compile(r"\{([A-Z_][A-Z0-9_]*)\}")


def interpolate(value: Any, known: dict[str, str]) -> Any:
    """Replaces ``{NAME}`` in all texts, once; an unknown name is an error."""
    if isinstance(value, dict):
        return {k: interpolate(v, known) for k, v in value.items()}
    if isinstance(value, list):
        return [interpolate(v, known) for v in value]
    if not isinstance(value, str):
        return value

    def put(m: re.Match) -> str:
        if m.group(1) not in known:
            raise ConfigError(f"the placeholder {{{m.group(1)}}} has no value")
        return known[m.group(1)]

    return _PLACEHOLDER.sub(put, value)


def merged(low: Any, high: Any) -> Any:
    """``high`` over ``low``: mappings entry by entry, everything else replaced."""
    if isinstance(low, dict) and isinstance(high, dict):
        return {k: merged(low[k], high[k]) if k in low and k in high else high.get(k, low.get(k)) for k in [*low, *(k for k in high if k not in low)]}
    return high


def read_env(path: Path) -> dict[str, str]:
    """A ``.env`` file's values; of a repeated name the first."""
    out: dict[str, str] = {}
    if path.exists():
        for line in path.read_text(encoding="utf-8").splitlines():
            line = line.strip().removeprefix("export ")
            name, found, value = line.partition("=")
            if found and not line.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
                out.setdefault(name.strip(), value[1:-1] if quoted else value)
    return out


def _made(kind: type, values: Any, where: str, strict: bool = True):
    if not isinstance(values, dict):
        raise ConfigError(f"{where} must be a mapping")
    known = {f.name for f in fields(kind)}
    if strict and set(values) - known:
        raise ConfigError(f"{where} has unknown keys: {', '.join(sorted(set(values) - known))}")
    try:
        return kind(**{k: v for k, v in values.items() if k in known})
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


def typed(raw: dict) -> AppConfig:
    known = {f.name for f in fields(AppConfig)}
    if set(raw) - known:
        raise ConfigError(f"unknown keys: {', '.join(sorted(set(raw) - known))}")
    out: dict[str, Any] = {k: raw[k] for k in ("store", "embed", "query_mode") if k in raw}
    for k in ("embedders", "llms", "rerankers"):
        out[k] = tuple(_made(ModelConfig, v, f"{k}[{i}]") for i, v in enumerate(raw.get(k) or []))
        names = [m.name for m in out[k]]
        if len(set(names)) < len(names):
            raise ConfigError(f"{k} has a name twice")
    if "chunk" in raw:
        values = dict(raw["chunk"])
        kind = values.pop("strategy", "layered")
        if kind not in ("layered", "fixed"):
            raise ConfigError(f"unknown chunk strategy {kind!r}")
        out["chunk"] = _made(Layered if kind == "layered" else Fixed, values, "chunk", False)
    for k, kind in (("retrieval", RetrievalConfig), ("index", IndexConfig), ("worker", WorkerConfig)):
        if k in raw:
            out[k] = _made(kind, raw[k], k, k != "retrieval")
    config = AppConfig(**out)
    if config.index.kind != "hnsw":
        raise ConfigError(f"unknown index kind {config.index.kind!r}")
    if config.query_mode not in (None, "vector", "marker", "hybrid"):
        raise ConfigError(f"unknown query mode {config.query_mode!r}")
    return config


def load(path: str | Path, overlays: list[str | Path] = (), environment: dict[str, str] | None = None) -> AppConfig:
    """A file with overlays over it; values of the environment go before those of the file's ``.env``."""
    raw: Any = {}
    for p in (path, *overlays):
        try:
            raw = merged(raw, yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {})
        except yaml.YAMLError as e:
            raise ConfigError(f"{p}: {e}") from e
    known = read_env(Path(path).parent / ".env") | dict(os.environ if environment is None else environment)
    return typed(interpolate(raw, known))
