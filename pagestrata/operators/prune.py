"""Pruners: what cleans the pages of the ai route before their blocks are extracted."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.errors import ModelError

# Fixed value: pages beyond this many characters are cleaned by the basic rules whatever their route.
LONGEST = 4096


class Pruner(Protocol):
    """Reduces html pages to their content, a batch at a time; must be picklable."""

    def prune(self, pages: list[str]) -> list[str]: ...


PRUNERS: dict[str, type | None] = {"basic": None}


def pruner_of(name: str) -> Pruner | None:
    """A registered pruner by its name in the settings; null for the basic rules alone."""
    if name not in PRUNERS:
        raise ModelError("unknown pruner", name=name)
    made = PRUNERS[name]
    return made() if made else None


def pruned(html: Column, route: Column, pruner: Pruner | None, longest: int = LONGEST) -> Column:
    """The html to extract blocks from: pages of the ai route, up to ``longest`` characters, as the pruner leaves them.

    All other pages, and batches in which the pruner fails, stay as they are; the basic rules apply to all afterwards.
    """
    if pruner is None:
        return html

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            pages = batch.to_pylist()
            at = [i for i, p in enumerate(pages) if p is not None]
            try:
                got = pruner.prune([pages[i] for i in at]) if at else []
            except Exception:  # a model that fails must not lose pages
                got = [pages[i] for i in at]
            for i, x in zip(at, got):
                pages[i] = x
            yield pa.array(pages, pa.string())

    return F.coalesce(run(F.when((route == "ai") & (F.length(html) <= longest), html)), html)
