"""Near-duplicate records: exact set-similarity join on word shingles (problem 2).

Method: prefix-filtered inverted lists with set-relation skipping. Sets are ordered by ascending
document frequency of their shingles; a pair at Jaccard >= t must share a shingle within a short
prefix. Inverted lists are sorted by set size and position and cut into blocks with the least and greatest
size, position and rest of their sets; a pair of blocks whose bounds allow no similar pair is skipped
whole, without a look at its sets (index level). In verification the answer of a set is derived from the
computed answer of a highly similar set: only the few shingles in which the two differ are looked up
(answer level). Equal sets are one class from the start and never meet each other in a list.

Scale. Shingle sets are computed once and written to the shared folder. Document frequencies move as
packed numpy blobs by hash range, never as exploded rows. Shingles in more than ``hot_share`` of the
sets (site furniture) are not shuffled at all: they stand last in the order, their number is bounded by
average set size / hot_share. A set can have a partner only if a share t of its shingles occurs in
other sets; the others leave after the first round trip. Lists of more than ``tile`` sets are cut into
tiles that meet pairwise. Every filter is exact: the result is that of comparing all pairs, up to hash
collisions. :func:`near_duplicate_groups` gives one row per record instead of pairs: sets that a first pass
has linked through a leader are one group, and blocks within one group are skipped as well, so a large
family of variants costs no more than its records.

Classes of at most ``expand`` members give all their pairs; of larger classes every member is paired
with the smallest id of the class, which stands for the class in its links to other classes.

Cases: null, empty and short texts (fewer than the least number of shingles) have no pairs; repeated
deliveries are one record; empty tables give no rows; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.html_scan import visible_text, words
from pagestrata.session import stored

_CUT = np.uint64(16)  # in lists a shingle is the first 48 bits of its hash
_HOME = "home int, kind int, sigs binary, a binary, b binary, c binary"
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Shingler:
    """Distinct k-word shingles as sorted 64-bit hashes; word hashes are kept in a bounded cache."""

    def __init__(self, k: int, salt: int):
        self.k, self.salt, self.cache = k, salt, {}

    def __call__(self, text: str | None, least: int) -> np.ndarray | None:
        found = words(text)
        if len(found) < least + self.k - 1:
            return None
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        codes = []
        for w in found:
            c = cache.get(w)
            if c is None:
                c = cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), self.salt)
            codes.append(c)
        w = np.array(codes, dtype=np.uint64)
        n = len(w) - self.k + 1
        h = np.full(n, 0x27D4EB2F165667C5, dtype=np.uint64)
        for j in range(self.k):
            h = (h ^ w[j : j + n]) * _K[j % len(_K)]
            h ^= h >> np.uint64(31)
        h = np.unique(h)
        return h if len(h) >= least else None


def shingle_sets(docs: DataFrame, kind: str, least: int, k: int = 3, prepare: Callable[[str | None], str | None] | None = None, salt: int = 1) -> DataFrame:
    """(kind, id, sig, n, tokens) of every document (id, text) with at least ``least`` distinct shingles."""

    def run(batches):
        shingler = Shingler(k, salt)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                ids, sigs, ns, blobs = [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py()
                    h = shingler(prepare(text) if prepare else text, least)
                    if h is not None:
                        raw = h.tobytes()
                        ids.append(key)
                        sigs.append(xxhash.xxh64_intdigest(raw) - (1 << 63))
                        ns.append(len(h))
                        blobs.append(raw)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(sigs, pa.int64()), pa.array(ns, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "id", "sig", "n", "tokens"])

    return docs.select("id", "text").mapInArrow(run, "kind string, id bigint, sig bigint, n int, tokens binary")


def _need(n: np.ndarray, t: float) -> np.ndarray:
    """Least number of shared shingles of a set of n at similarity t."""
    return np.ceil(n * t - 1e-9).astype(np.int64)


def hot_shingles(sets: DataFrame, total: int, hot_share: float, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) found in about ``hot_share`` of the sets or more, at least in ``floor``.

    A shingle that frequent is so within at least one task; tasks report only those, so the driver gets a
    table bounded by the average set size / hot_share.
    """
    share = max(hot_share, floor / max(total, 1))

    def run(batches):
        keys, counts, n = np.empty(0, np.uint64), np.empty(0, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            got, c = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint64), return_counts=True)
            merged, inverse = np.unique(np.concatenate([keys, got]), return_inverse=True)
            keys, counts = merged, np.bincount(inverse, np.concatenate([counts, c]), len(merged)).astype(np.int64)
        if n:
            hot = counts >= max(2, share * n)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hot].view(np.int64)), pa.array(counts[hot])], names=["token", "c"])

    rows = sets.select("tokens").mapInArrow(run, "token bigint, c bigint").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= share * total / 2).toArrow()
    keys = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("c").to_numpy()[order].astype(np.int64)


def _is_hot(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(tokens), dtype=bool)
    return hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array, and its end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _pack(x: np.ndarray, low: int | None = None) -> bytes:
    """An array as compressed planes of bytes; ``low`` keeps only so many low bytes of each value."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize)[:, :low]
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpack(raw: bytes, kind, low: int | None = None) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(low or width, -1).T
    out = np.zeros((len(planes), width), dtype=np.uint8)
    out[:, : planes.shape[1]] = planes
    return out.view(kind).ravel()


def _grade(df: np.ndarray) -> np.ndarray:
    """Document frequency in one byte, eight steps to a doubling."""
    return np.minimum(255, np.floor(8 * np.log2(df))).astype(np.uint8)


def _most(grade: np.ndarray) -> np.ndarray:
    """The greatest frequency of a grade."""
    return np.ceil(2.0 ** ((grade.astype(np.float64) + 1) / 8)).astype(np.int64)


def _slices(batch, tokens: int = 1_000_000):
    """Slices of a batch (sig, n, tokens) with about so many tokens each."""
    total = np.cumsum(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + tokens)))
        yield batch.slice(start, end - start)
        start = end


def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch (sig, n, tokens), each signature once: signatures, sizes, all tokens, owner of each token."""
    sig, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
    n = batch.column(1).to_numpy(zero_copy_only=False)[first]
    blobs = batch.column(2)
    tokens = np.frombuffer(b"".join(blobs[int(i)].as_py() for i in first), dtype=np.uint64)
    return sig, n, tokens, np.repeat(np.arange(len(sig)), n)


def prefix_postings(sets: DataFrame, t: float, hot: np.ndarray, hot_counts: np.ndarray, buckets: int) -> DataFrame:
    """(token, sig, n, pos, df): the inverted lists of prefix shingles, of sets that can have a partner."""
    hot_rank = np.empty(len(hot), dtype=np.int64)
    hot_rank[np.lexsort((hot, hot_counts))] = np.arange(len(hot))

    def spread(batches):
        for batch in batches:
            for part in _slices(batch):
                sig, _, tokens, owner = _flat(part)
                cold = ~_is_hot(tokens, hot)
                tokens, owner = tokens[cold], owner[cold]
                order = np.argsort(tokens)
                tokens, owner = tokens[order] >> _CUT, owner[order]
                bucket = ((tokens >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                edges = _edges(bucket)
                rows = []
                for a, b in zip(edges, edges[1:]):
                    used, local = np.unique(owner[a:b], return_inverse=True)
                    rows.append((int(bucket[a]), _pack(tokens[a:b], 6), _pack(local.astype(np.uint16 if len(used) <= 65536 else np.uint32)), len(used) <= 65536, sig[used].tobytes()))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.binary())], names=["bucket", "tokens", "owners", "short", "sigs"])

    def count(table: pa.Table) -> pa.Table:
        tokens, sigs = [], []
        for t, o, short, s in zip(*(table.column(c).to_pylist() for c in ("tokens", "owners", "short", "sigs"))):
            tokens.append(_unpack(t, np.uint64, 6))
            sigs.append(np.frombuffer(s, dtype=np.int64)[_unpack(o, np.uint16 if short else np.uint32)])
        tokens, sigs = np.concatenate(tokens), np.concatenate(sigs)
        order = np.lexsort((sigs, tokens))
        tokens, sigs = tokens[order], sigs[order]
        if len(tokens):  # equal sets seen by several tasks
            fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (sigs[1:] != sigs[:-1])])
            tokens, sigs = tokens[fresh], sigs[fresh]
        starts = _edges(tokens)
        df = np.repeat(np.diff(starts), np.diff(starts))
        shared = df >= 2
        tokens, sigs, grade = tokens[shared], sigs[shared], _grade(df[shared])
        home = (sigs.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((sigs, home))
        home, tokens, sigs, grade = home[order], tokens[order], sigs[order], grade[order]
        edges = _edges(home)
        out = {c: [] for c in ("sigs", "a", "b", "c")}
        for a, b in zip(edges, edges[1:]):
            ends = _edges(sigs[a:b])
            out["sigs"].append(sigs[a:b][ends[:-1]].tobytes())
            out["a"].append(_pack(np.diff(ends).astype(np.uint32)))
            out["b"].append(_pack(tokens[a:b], 6))
            out["c"].append(_pack(grade[a:b]))
        n = len(edges) - 1
        return pa.table({"home": pa.array(home[edges[:-1]], pa.int32()), "kind": pa.array([2] * n, pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    def heads(batches):
        """Of each set its size and number of hot shingles; where these alone reach the least overlap, the first of them."""
        for batch in batches:
            for part in _slices(batch):
                sig, n, tokens, owner = _flat(part)
                is_hot = _is_hot(tokens, hot)
                h = np.bincount(owner[is_hot], minlength=len(sig))
                spare = h - _need(n, t) + 1
                home = (sig.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(n)])
                order = np.argsort(home, kind="stable")
                edges = _edges(home[order])
                rows = []
                for a, b in zip(edges, edges[1:]):
                    at = order[a:b]
                    rows.append((int(home[at[0]]), 0, sig[at].tobytes(), _pack(n[at].astype(np.uint32)), _pack(h[at].astype(np.uint32)), None))
                for i in np.flatnonzero(spare > 0):
                    own = tokens[starts[i] : starts[i + 1]][is_hot[starts[i] : starts[i + 1]]]
                    rank = hot_rank[np.searchsorted(hot, own)]
                    rows.append((int(home[i]), 1, sig[i : i + 1].tobytes(), None, None, own[np.argsort(rank)][: spare[i]].tobytes()))
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["home", "kind", "sigs", "a", "b", "c"])

    def prefixes(table: pa.Table) -> pa.Table:
        sigs, sizes, hots, at, tokens, grades, more = [], [], [], [], [], [], {}
        tails = []
        for kind, s, a, b, c in zip(*(table.column(x).to_pylist() for x in ("kind", "sigs", "a", "b", "c"))):
            if kind == 0:
                sigs.append(np.frombuffer(s, dtype=np.int64))
                sizes.append(_unpack(a, np.uint32))
                hots.append(_unpack(b, np.uint32))
            elif kind == 1:
                more[np.frombuffer(s, dtype=np.int64)[0]] = np.frombuffer(c, dtype=np.uint64)
            else:
                tails.append((s, a, b, c))
        sig, first = np.unique(np.concatenate(sigs), return_index=True)
        n, h = (np.concatenate(x)[first].astype(np.int64) for x in (sizes, hots))
        for s, a, b, c in tails:
            at.append(np.repeat(np.searchsorted(sig, np.frombuffer(s, dtype=np.int64)), _unpack(a, np.uint32)))
            tokens.append(_unpack(b, np.uint64, 6))
            grades.append(_unpack(c, np.uint8))
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        at, tokens, grades = join(at, np.int64), join(tokens, np.uint64), join(grades, np.uint8)
        order = np.lexsort((tokens, grades, at))
        at, tokens, grades = at[order], tokens[order], grades[order]
        cold = np.bincount(at, minlength=len(sig))
        rank = np.arange(len(at)) - np.concatenate([[0], np.cumsum(cold)])[at] if len(at) else at
        unique = n - cold - h
        reach = cold + h - _need(n, t) + 1
        keep = rank < reach[at] if len(at) else np.zeros(0, bool)
        at, tokens, df, pos = at[keep], tokens[keep], _most(grades[keep]), (unique[at] + rank)[keep] if len(at) else rank
        out = [(at, tokens, df, pos)]
        for s, own in more.items():
            i = int(np.searchsorted(sig, s))
            out.append((np.full(len(own), i), own >> _CUT, hot_counts[np.searchsorted(hot, own)], unique[i] + cold[i] + np.arange(len(own))))
        at, tokens, df, pos = (np.concatenate(x) for x in zip(*out))
        return pa.table({"token": tokens.astype(np.int64), "sig": sig[at], "n": n[at].astype(np.int32), "pos": pos.astype(np.int32), "df": df.astype(np.int64)})

    narrow = sets.select("sig", "n", "tokens")
    shared = narrow.mapInArrow(spread, "bucket int, tokens binary, owners binary, short boolean, sigs binary").repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(count, _HOME)
    header = narrow.mapInArrow(heads, _HOME)
    return shared.unionAll(header).repartitionById(buckets, F.col("home")).groupBy("home").applyInArrow(prefixes, "token bigint, sig bigint, n int, pos int, df bigint")


def block_pairs(n: np.ndarray, pos: np.ndarray, t: float, group: np.ndarray | None = None, block: int = 16, at_once: int = 2048):
    """Pairs (left, right) of one inverted list that pass the size and position bounds, in parts, each with the number of pairs it looked at.

    The list is sorted by narrow size class and relative position. Its blocks are compared by their extremes first; a pair of blocks
    is opened only where a pair of sets in it could pass. With ``group`` pairs within one group are left out, and blocks of
    one group are skipped.
    """
    order = np.lexsort((n, pos / np.maximum(n, 1), np.floor(np.log(np.maximum(n, 1)) / -np.log(t) * 6)))
    n, pos, group = n[order], pos[order], group[order] if group is not None else None
    starts = np.arange(0, len(n), block)
    least, most = (lambda x: np.minimum.reduceat(x, starts)), (lambda x: np.maximum.reduceat(x, starts))
    rest = n - pos
    low_n, high_n, high_rest = least(n), most(n), most(rest)
    i, j = np.triu_indices(len(starts))
    need = np.ceil(t / (1 + t) * (low_n[i] + low_n[j]) - 1e-9)
    go = (low_n[j] * t <= high_n[i] + 1e-9) & (low_n[i] * t <= high_n[j] + 1e-9) & (np.minimum(high_rest[i], high_rest[j]) >= need)
    if group is not None:
        low_g, high_g = least(group), most(group)
        go &= (low_g[i] != high_g[i]) | (low_g[j] != high_g[j]) | (low_g[i] != low_g[j])
    i, j = i[go], j[go]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(block), np.arange(block), indexing="ij"))
    for k in range(0, len(i), at_once):
        x, y = (starts[i[k : k + at_once], None] + a).ravel(), (starts[j[k : k + at_once], None] + b).ravel()
        inside = (x < y) & (y < len(n))
        x, y = x[inside], y[inside]
        looked = len(x)
        hit = _passes(n[x], pos[x], n[y], pos[y], t)
        if group is not None:
            hit &= group[x] != group[y]
        yield order[x[hit]], order[y[hit]], looked


def _passes(na: np.ndarray, pa_: np.ndarray, nb: np.ndarray, pb: np.ndarray, t: float) -> np.ndarray:
    """Whether sets of these sizes whose first common shingle stands at these positions can be similar: what they share stands there or behind."""
    return (np.maximum(na, nb) * t <= np.minimum(na, nb) + 1e-9) & (np.minimum(na - pa_, nb - pb) >= np.ceil(t / (1 + t) * (na + nb) - 1e-9))


def candidates(postings: DataFrame, t: float, tile: int = 16384, parts: int | None = None, long: int = 128) -> DataFrame:
    """(sa, sb): distinct pairs of signatures that meet in a list and pass its length and position bounds.

    Postings may have a column ``group``: then only pairs of different groups. ``parts`` is the number of shuffle partitions.
    """
    tiles = F.greatest(F.lit(1), F.ceil(F.col("df") / tile)).cast("int")
    own = F.pmod(F.xxhash64("sig"), tiles).cast("int")
    cut = postings.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    grouped = "group" in postings.columns
    cut = cut.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig", "n", "pos", (F.col("group") if grouped else F.col("sig")).alias("group"))

    def pack(sa, sb, pa_, pb, na, nb):
        swap = sa > sb
        pick = lambda x, y: pa.array(np.where(swap, y, x).astype(np.int64))
        return pa.RecordBatch.from_arrays([pick(sa, sb), pick(sb, sa), pa.array(np.ones(len(sa), np.int64)), pick(pa_, pb), pick(pb, pa_), pick(na, nb), pick(nb, na)], names=["sa", "sb", "met", "pa", "pb", "na", "nb"])

    def meet(batches):
        carry = None
        done = False
        batches = iter(batches)
        while not done:
            batch = next(batches, None)
            done = batch is None
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(8)] if not done else [np.empty(0, np.int64)] * 8
            if carry is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(carry, cols)]
            token, i, j, own, sig, n, pos, group = cols
            if not len(token):
                continue
            run = np.concatenate([[0], np.cumsum((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])
            end = len(run) if done else int(np.searchsorted(run, run[-1]))  # the last list may go on
            carry = None if done else [c[end:] for c in cols]
            run, own, sig, n, pos, group, diagonal = run[:end], own[:end], sig[:end], n[:end].astype(np.int64), pos[:end].astype(np.int64), group[:end], (i == j)[:end]
            edges = _edges(run)
            sizes = np.diff(edges)
            fine = lambda x, y: (sig[x] != sig[y]) & (diagonal[x] | (own[x] != own[y]))  # noqa: B023, E731
            active, d = np.flatnonzero(np.repeat(sizes < long, sizes)), 1
            while len(active):  # short lists all at once, by distance within the list
                active = active[active + d < end]
                other = active + d
                go = (run[other] == run[active]) & (n[other] * t <= n[active] + 1e-9)  # sorted by size: what fails here is skipped for good
                active, other = active[go], other[go]
                hit = _passes(n[active], pos[active], n[other], pos[other], t) & fine(active, other)
                if grouped:
                    hit &= group[active] != group[other]
                x, y = active[hit], other[hit]
                if len(x):
                    yield pack(sig[x], sig[y], pos[x], pos[y], n[x], n[y])
                d += 1
            for k in np.flatnonzero(sizes >= long):
                a, b = edges[k], edges[k + 1]
                for x, y, _ in block_pairs(n[a:b], pos[a:b], t, group[a:b] if grouped else None):
                    x, y = x + a, y + a
                    keep = fine(x, y)
                    x, y = x[keep], y[keep]
                    if len(x):
                        yield pack(sig[x], sig[y], pos[x], pos[y], n[x], n[y])

    keys = [F.col("token"), F.col("i"), F.col("j")]
    lists = (cut.repartition(parts, *keys) if parts else cut.repartition(*keys)).sortWithinPartitions("token", "i", "j", "n", "pos")
    pairs = lists.mapInArrow(meet, "sa bigint, sb bigint, met bigint, pa bigint, pb bigint, na bigint, nb bigint").groupBy("sa", "sb").agg(F.sum("met").alias("met"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    # Pairs pass in the lists of their first common shingles, so all up to the last one met are counted; what can follow is bounded by the shorter rest.
    least = F.ceil(F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - 1e-9)
    return pairs.filter(F.col("met") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb")) >= least).select("sa", "sb")


def verified(pairs: DataFrame, sets: DataFrame, t: float, small: int = 1_000_000) -> DataFrame:
    """(sa, sb, similarity) of the pairs at similarity t or more, from the whole sets."""
    sides = pairs.select(F.col("sa").alias("sig")).union(pairs.select(F.col("sb").alias("sig"))).distinct()
    if sides.count() <= small:  # 16 bytes each; beyond that the join shuffles
        sides = F.broadcast(sides)
    wanted = sets.select("sig", "tokens").join(sides, "sig", "left_semi").dropDuplicates(["sig"])
    both = pairs.join(wanted.select(F.col("sig").alias("sa"), F.col("tokens").alias("ta")), "sa").join(wanted.select(F.col("sig").alias("sb"), F.col("tokens").alias("tb")), "sb")

    def run(batches):
        """Rows come sorted by sb: the answers of one set for sb serve the sets that differ from it in a few shingles."""
        leaders: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        arrays: dict[int, np.ndarray] = {}
        answers: dict[int, int] = {}
        last_b, last_a, current = None, None, None
        for batch in batches:
            sa, sb = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out = np.zeros(batch.num_rows)
            for k in range(batch.num_rows):
                a, b = int(sa[k]), int(sb[k])
                if len(arrays) > 4000:
                    arrays.clear()
                    leaders.clear()
                    answers = {}
                if b != last_b:
                    last_b, answers, last_a = b, {}, None
                    current = np.frombuffer(batch.column(3)[k].as_py(), dtype=np.uint64)
                x = arrays.get(a)
                if x is None:
                    x = arrays[a] = np.frombuffer(batch.column(2)[k].as_py(), dtype=np.uint64)
                    if last_a is not None and last_a in arrays:
                        near = arrays[last_a]
                        more, less = np.setdiff1d(x, near, True), np.setdiff1d(near, x, True)
                        if len(more) + len(less) < len(x) // 4:
                            leaders[a] = (last_a, more, less)
                lead = leaders.get(a)
                if lead and lead[0] in answers:
                    overlap = answers[lead[0]] + int(_is_hot(lead[1], current).sum()) - int(_is_hot(lead[2], current).sum())
                else:
                    overlap = int(_is_hot(x, current).sum())
                answers[a] = overlap
                last_a = a
                out[k] = overlap / (len(x) + len(current) - overlap)
            good = pa.array(out >= t - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good), pa.array(out).filter(good)], names=["sa", "sb", "similarity"])

    return both.select("sa", "sb", "ta", "tb").sortWithinPartitions("sb", "sa").mapInArrow(run, "sa bigint, sb bigint, similarity double")


def list_postings(sets: DataFrame, t: float, hot_share: float = 0.001, hot_floor: int = 64, tokens_per_bucket: int = 1_000_000) -> tuple[DataFrame, int]:
    """The inverted lists of :func:`prefix_postings` and the number of partitions that keeps tasks small."""
    size = sets.agg(F.count("*"), F.sum("n")).first()
    total, tokens = size[0], size[1] or 0
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-tokens // tokens_per_bucket))
    return prefix_postings(sets, t, *hot_shingles(sets, total, hot_share, hot_floor), buckets), buckets


def similar_classes(sets: DataFrame, t: float = 0.7, **options) -> DataFrame:
    """(sa, sb, similarity): all pairs of different shingle sets at similarity t or more."""
    postings, parts = list_postings(sets, t, **options)
    return verified(stored(candidates(postings, t, parts=parts), "near-dup-candidates"), sets, t)


def class_members(sets: DataFrame) -> DataFrame:
    """(kind, sig, id): every record with its class, repeated deliveries once."""
    return sets.select("kind", "sig", "id").distinct()


def near_duplicates(sets: DataFrame, t: float = 0.7, expand: int = 64, **options) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b: pairs of records at similarity t or more; see the module on large classes."""
    links = stored(similar_classes(sets, t, **options), "near-dup-links")
    members = class_members(sets)
    sizes = members.groupBy("kind", "sig").agg(F.count("*").alias("c"), F.min("id").alias("rep"))
    linked = links.select(F.col("sa").alias("sig")).union(links.select(F.col("sb").alias("sig"))).distinct()
    flagged = sizes.join(linked.withColumn("linked", F.lit(True)), "sig", "left").filter("c > 1 OR linked")
    small = members.join(flagged.filter(F.col("c") <= expand).select("kind", "sig"), ["kind", "sig"], "left_semi").groupBy("kind", "sig").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    large = flagged.filter(F.col("c") > expand)
    groups = stored(small.unionByName(large.select("kind", "sig", F.array("rep").alias("ids"))), "near-dup-groups")
    within = groups.filter(F.size("ids") > 1).select("kind", F.explode("ids").alias("id_a"), "ids").select("kind", "id_a", F.explode("ids").alias("id_b"))
    star = members.join(large.select("kind", "sig", "rep"), ["kind", "sig"]).select("kind", F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    a, b = groups.select("kind", F.col("sig").alias("sa"), F.col("ids").alias("ia")), groups.select(F.col("sig").alias("sb"), F.col("ids").alias("ib"))
    across = links.join(a, "sa").join(b, "sb").select("kind", F.explode("ia").alias("x"), "ib").select("kind", "x", F.explode("ib").alias("y")).select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return within.unionAll(star).unionAll(across).filter("id_a < id_b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(sig, label): the least signature of the connected component of every signature in edges (sa, sb).

    Labels pass to neighbours and jump to the label of their label, so a component of any shape takes about log(size) rounds;
    each round is a table in the shared folder.
    """
    both = stored(edges.select("sa", "sb").union(edges.select(F.col("sb").alias("sa"), F.col("sa").alias("sb"))).distinct(), "near-dup-edges")
    labels = stored(both.groupBy("sa").agg(F.least(F.first("sa"), F.min("sb")).alias("label")).withColumnRenamed("sa", "sig"), "near-dup-labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("sig", "sb"), "sb").groupBy("sa").agg(F.min("label").alias("near"))
        best = labels.join(near.withColumnRenamed("sa", "sig"), "sig").select("sig", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("sig").alias("best"), F.col("label").alias("far"))
        after = stored(best.join(jump, "best", "left").select("sig", F.least("best", F.coalesce("far", "best")).alias("label"), (F.col("label") != F.least("best", F.coalesce("far", "best"))).alias("moved")), "near-dup-labels")
        moved = after.filter("moved").limit(1).count()
        labels = after.drop("moved")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def near_duplicate_groups(sets: DataFrame, t: float = 0.8, **options) -> DataFrame:
    """(kind, id, group_id, group_size): every record of ``sets`` with the least id of its group of records linked at similarity t or more.

    Each set is compared with the first set of its size class in each of its lists; what is linked so is one group. Then
    all lists are searched for pairs of different groups only, so no pair within a family has to be formed.
    """
    postings, parts = list_postings(sets, t, **options)
    postings = stored(postings, "near-dup-postings")
    size_class = F.floor(F.log("n") / F.lit(float(np.log(1 / t)))).cast("int")
    classed = postings.select("token", size_class.alias("class"), "sig")
    leaders = classed.groupBy("token", "class").agg(F.min("sig").alias("leader"), F.count("*").alias("c")).filter("c > 1")
    first = classed.join(leaders, ["token", "class"]).filter("sig != leader").select(F.least("sig", "leader").alias("sa"), F.greatest("sig", "leader").alias("sb")).distinct()
    links = stored(verified(stored(first, "near-dup-leaders"), sets, t), "near-dup-links")
    labels = components(links)
    grouped = postings.join(labels, "sig", "left").withColumn("group", F.coalesce("label", "sig")).drop("label")
    across = verified(stored(candidates(grouped, t, parts=parts), "near-dup-candidates"), sets, t)
    joined = links.select("sa", "sb").unionAll(across.select("sa", "sb"))
    labels = components(joined)
    members = stored(class_members(sets).join(labels, "sig", "left").select("kind", "id", F.coalesce("label", "sig").alias("label")), "near-dup-members")
    sizes = members.groupBy("kind", "label").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return members.join(sizes, ["kind", "label"]).select("kind", "id", "group_id", "group_size")


def page_sets(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 150, k: int = 3) -> DataFrame:
    """Shingle sets of the visible text of html pages."""
    return shingle_sets(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("text")), "page", least, k, visible_text, salt=2)


def block_sets(blocks: DataFrame, id_col: str = "block_id", text_col: str = "text", least: int = 20, k: int = 3) -> DataFrame:
    """Shingle sets of text blocks."""
    return shingle_sets(blocks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "block", least, k, salt=1)
