"""Embedders: a protocol, a deterministic default (hashed character n-grams), and the column that applies one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.errors import ModelError


class Embedder(Protocol):
    """Maps texts to unit vectors of one dimension; must be picklable."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...

    def info(self) -> dict: ...


@dataclass
class HashedNgrams:
    """Signed counts of hashed character n-grams within words, scaled to unit length; blank texts give a zero vector."""

    dim: int = 256
    low: int = 3
    high: int = 4

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for start in range(0, len(texts), 2000):
            part = [" " + "".join(f"<{w}> " for w in (t or "").lower().split()) for t in texts[start : start + 2000]]
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            rows = np.repeat(np.arange(len(part)), [len(p) for p in part])
            blank = np.concatenate([[0], np.cumsum(codes == 32)])
            total = np.zeros(len(part) * self.dim)
            for n in range(self.low, self.high + 1):
                m = len(codes) - n + 1
                if m <= 0:
                    continue
                at = np.flatnonzero(blank[n : n + m] == blank[:m])  # windows within one word
                h = np.full(len(at), n, dtype=np.uint32)
                for k in range(n):
                    h = (h ^ codes[at + k]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                sign = np.where(h & np.uint32(0x80000000), 1.0, -1.0)
                total += np.bincount(rows[at] * self.dim + (h % np.uint32(self.dim)).astype(np.int64), sign, len(total))
            out[start : start + len(part)] = total.reshape(-1, self.dim)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    def info(self) -> dict:
        return {"model_name": "hashed-ngrams", "embedding_dimension": self.dim, "device": "cpu", "max_seq_length": None}


EMBEDDERS: dict[str, type] = {"hashed-ngrams": HashedNgrams}


def embedder_of(name: str) -> Embedder:
    """A registered embedder by its name in the settings."""
    if name not in EMBEDDERS:
        raise ModelError("unknown embedder", name=name)
    return EMBEDDERS[name]()


def embed_column(text: Column, embedder: Embedder) -> Column:
    """Vectors of a text column; the embedder is loaded once per worker, batches are Arrow batches."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = np.ascontiguousarray(embedder.encode([t or "" for t in texts.to_pylist()]), dtype=np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * got.shape[1], pa.int32()), pa.array(got.ravel()))

    return run(text)
