"""Settings as frozen dataclasses: defaults, environment, JSON files and presets (always fresh copies)."""

from __future__ import annotations

import dataclasses
import json
import os
import typing
from dataclasses import dataclass

from pagestrata.errors import ConfigError


def _within(name: str, value, low, high) -> None:
    if value is not None and not low <= value <= high:
        raise ConfigError(f"{name} must be within {low}..{high}", value=value)


def _coerce(kind, raw: str):
    text = str(kind)
    if "list" in text:
        items = json.loads(raw) if raw.strip().startswith("[") else [x.strip() for x in raw.split(",") if x.strip()]
        return tuple(int(x) if "int" in text else x for x in items)
    if "bool" in text:
        return raw.strip().lower() in ("1", "true", "yes", "on")
    if "int" in text:
        return int(raw)
    return float(raw) if "float" in text else raw


class _Settings:
    @classmethod
    def from_env(cls, **given):
        """Defaults, overlaid by environment variables with the class's prefix, overlaid by ``given``."""
        found = {}
        kinds = typing.get_type_hints(cls)
        for f in dataclasses.fields(cls):
            raw = os.environ.get(f"{cls.PREFIX}{f.name.upper()}")
            if raw is not None:
                found[f.name] = _coerce(kinds[f.name], raw)
        return cls(**(found | given))

    def with_(self, **changes):
        """A copy with other values; unknown names are ignored."""
        names = {f.name for f in dataclasses.fields(self)}
        return dataclasses.replace(self, **{k: v for k, v in changes.items() if k in names and v is not None})

    def as_dict(self) -> dict:
        return dataclasses.asdict(self)


@dataclass(frozen=True)
class PipelineConfig(_Settings):
    """Settings of ingest: models by name, chunk size, routing, collection."""

    PREFIX: typing.ClassVar[str] = "RAG_"
    html_pruner_model: str = "basic"
    embedding_model: str = "hashed-ngrams"
    max_chunk_size: int = 512
    prefer_basic_cleaning: bool = False
    cyrillic_detection_threshold: float = 0.2
    collection_name: str = "html_documents"
    persist_directory: str = "./collections"
    log_level: str = "INFO"
    log_file: str | None = None
    log_rotation: str = "10 MB"
    batch_size: int = 32
    num_workers: int = 4
    enable_metrics: bool = True
    device: str | None = None

    def __post_init__(self):
        _within("max_chunk_size", self.max_chunk_size, 50, 2048)
        _within("cyrillic_detection_threshold", self.cyrillic_detection_threshold, 0, 1)
        _within("batch_size", self.batch_size, 1, 256)
        _within("num_workers", self.num_workers, 1, 32)


@dataclass(frozen=True)
class SnapshotConfig(_Settings):
    """Settings of snapshot directories: pairing, routing and filters."""

    PREFIX: typing.ClassVar[str] = "WAYBACK_"
    require_metadata: bool = False
    force_basic_cleaning: bool = True
    min_content_length: int = 100
    domain_filters: list[str] | tuple[str, ...] = ()
    year_filters: list[int] | tuple[int, ...] = ()


@dataclass(frozen=True)
class SearchConfig(_Settings):
    """Settings of search."""

    PREFIX: typing.ClassVar[str] = "SEARCH_"
    default_n_results: int = 10
    similarity_threshold: float = 0.0
    enable_metadata_filter: bool = True

    def __post_init__(self):
        _within("default_n_results", self.default_n_results, 1, 100)
        _within("similarity_threshold", self.similarity_threshold, -1, 1)


# What each preset changes.
PRESETS: dict[str, dict] = {
    "ukrainian": {"prefer_basic_cleaning": True, "cyrillic_detection_threshold": 0.1, "collection_name": "ukrainian_documents"},
    "english": {"prefer_basic_cleaning": False, "cyrillic_detection_threshold": 0.5, "collection_name": "english_documents"},
    "wayback": {"prefer_basic_cleaning": True, "cyrillic_detection_threshold": 0.1, "collection_name": "wayback_documents"},
    "performance": {"batch_size": 64, "num_workers": 8, "max_chunk_size": 1024},
}


def preset(name: str) -> PipelineConfig:
    """A fresh copy of a preset."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    return PipelineConfig(**PRESETS[name])


def load_config(path: str | None = None) -> PipelineConfig:
    """Settings of a JSON file if it exists, else of the environment."""
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return PipelineConfig().with_(**json.load(f))
    return PipelineConfig.from_env()


def save_config(config: PipelineConfig, path: str) -> None:
    """Write settings as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config.as_dict(), f, ensure_ascii=False, indent=2)


def choose_config(preset_name: str | None = None, path: str | None = None, **changes) -> PipelineConfig:
    """Preset before file before defaults, then ``changes``."""
    base = preset(preset_name) if preset_name else load_config(path) if path else PipelineConfig()
    return base.with_(**changes)
