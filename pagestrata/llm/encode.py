"""Encoding of the corpus with a public byte-level BPE vocabulary (problem 8).

Method: contiguous rank array. A text is cut into words by the vocabulary's pattern; every distinct
word is encoded once per worker. A word is held as the list of its parts and, beside it, the list of
the ranks of neighbouring parts; the least rank is found by a scan, the boundary there deleted from
both lists, and the two ranks beside it looked up afresh. Words longer than ``LONG`` bytes, for which
scanning is quadratic, go through a heap with the same order of merges.

The vocabulary (a file of base64 token and rank per line, at most a few MB) is read on the driver and
broadcast; its path is a parameter. The plan is one narrow Arrow stage without shuffle.

Cases: null text gives null, empty text an empty array; control characters, mixed line ends and
characters outside the basic plane are bytes like any other; the strings of special tokens are text.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 192
_NONE = 1 << 31


class Vocabulary:
    """Ranks of single bytes, and of the join of two tokens by their ranks."""

    def __init__(self, lines: list[bytes]):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        if len(ranks) >= 1 << 16:
            raise ValueError("a vocabulary of 65 536 tokens or more needs wider pair keys")
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 16 | b] = rank


def merge_short(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Token ids of a short word by a contiguous array of ranks; of equal ranks the leftmost is joined first."""
    byte, get = vocabulary.byte, vocabulary.pairs.get
    parts = [byte[b] for b in word]
    ranks = [get(a << 16 | b, _NONE) for a, b in zip(parts, parts[1:])]
    while ranks:
        least = min(ranks)
        if least == _NONE:
            break
        i = ranks.index(least)
        parts[i] = least
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] << 16 | least, _NONE)
        if i < len(ranks):
            ranks[i] = get(least << 16 | parts[i + 1], _NONE)
    return parts


def merge_long(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Token ids of a long word: a heap of (rank, place) instead of scans; least rank first, then leftmost."""
    ids = [vocabulary.byte[b] for b in word]
    n, pairs = len(ids), vocabulary.pairs
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 16 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or pairs.get(ids[i] << 16 | ids[j]) != r:
            continue
        ids[i], ids[j] = r, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            if (x := pairs.get(r << 16 | ids[after[i]])) is not None:
                heapq.heappush(heap, (x, i))
        if before[i] >= 0 and (x := pairs.get(ids[before[i]] << 16 | r)) is not None:
            heapq.heappush(heap, (x, before[i]))
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes lists of texts; encoded words are kept in one flat array, started afresh beyond ``room`` words."""

    def __init__(self, vocabulary: Vocabulary, room: int = 300_000):
        self.vocabulary, self.room, self.find = vocabulary, room, regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used, self.starts, self.counts = np.empty(1 << 20, np.int32), 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def learn(self, words: list[str]) -> None:
        got = [(merge_short if len(raw) <= LONG else merge_long)(raw, self.vocabulary) for raw in (w.encode("utf-8", "surrogatepass") for w in words)]
        base, need = len(self.place), self.used + sum(map(len, got))
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while base + len(words) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        for k, (w, ids) in enumerate(zip(words, got)):
            self.place[w] = base + k
            self.starts[base + k], self.counts[base + k] = self.used, len(ids)
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.find(t) if t else () for t in texts]
        if len(self.place) > self.room:
            self.clear()
        place = self.place
        new = {w for ws in found for w in ws if w not in place}
        if new:
            self.learn(sorted(new))
        sizes = np.array([len(ws) for ws in found], dtype=np.int64)
        return np.fromiter((place[w] for ws in found for w in ws), dtype=np.int64, count=int(sizes.sum())), sizes

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list array of token ids: null for null, empty for empty."""
        at, sizes = self._places(texts)
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - counts), counts)] if total else np.empty(0, np.int32)
        per_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        null = np.array([t is None for t in texts] + [False])
        offsets = pa.array(per_text.astype(np.int32), mask=null if null.any() else None)
        return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text, 0 for null."""
        at, sizes = self._places(texts)
        total = np.concatenate([[0], np.cumsum(self.counts[at])])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return total[edges[1:]] - total[edges[:-1]]


def load(path: str = DEFAULT_PATH) -> list[bytes]:
    """The lines of a vocabulary file; refuses files beyond 16 MB, as they are broadcast."""
    with open(path, "rb") as f:
        data = f.read((16 << 20) + 1)
    if len(data) > 16 << 20:
        raise ValueError(f"{path} is larger than a broadcast vocabulary may be")
    return data.split(b"\n")


def _chunks(batch, budget: int = 2_000_000, rows: int = 400):
    """Slices of a batch whose texts hold at most about ``budget`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and (total + s > budget or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """(id, ids) of every document: token ids without special tokens."""
    lines = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches):
        encoder = Encoder(Vocabulary(lines.value))
        for batch in batches:
            for part in _chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], names=[id_col, "ids"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def token_lengths(docs: DataFrame, keep: list[str], text_col: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """The columns ``keep`` of every document and ``n_tokens`` (0 for null and empty texts)."""
    lines = docs.sparkSession.sparkContext.broadcast(load(path))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        encoder = Encoder(Vocabulary(lines.value))
        for batch in batches:
            for part in _chunks(batch):
                n = encoder.lengths(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(i) for i in range(2, part.num_columns)), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    cols = [F.col(keep[0]), F.col(text_col).cast("string").alias("_t"), *(F.col(c) for c in keep[1:])]
    return docs.select(*cols).mapInArrow(run, f"{kinds}, n_tokens bigint")
