"""pagestrata: archived web pages as Spark tables - sources, operators, plans and streams."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_WHERE = {
    "Pipeline": "plans.pipeline", "Collection": "operators.collection", "HashedNgrams": "operators.embed", "Embedder": "operators.embed", "Pruner": "operators.prune",
    "PipelineConfig": "config", "SnapshotConfig": "config", "SearchConfig": "config", "choose_config": "config", "preset": "config", "Metrics": "plans.metrics", "Profiler": "plans.metrics", "PageError": "errors",
}
__all__ = ["get_info", *_WHERE]


def __getattr__(name: str):
    """The public names, loaded when they are first used."""
    if name in _WHERE:
        return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def get_info() -> dict:
    """Name, version, public names and registered models."""
    from pagestrata.operators.embed import EMBEDDERS
    from pagestrata.operators.prune import PRUNERS

    return {"name": __name__, "version": __version__, "exports": sorted(_WHERE), "embedders": sorted(EMBEDDERS), "pruners": sorted(PRUNERS)}
