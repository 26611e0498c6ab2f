"""The k most similar vectors of every vector (problem 5).

Method: randomly rotated one-bit codes. Vectors are normalised, equal ones form a class, classes are
put into cells of a k-means codebook (fitted on at most ``sample`` vectors, by least hash; every vector
is indexed). Within a cell each residual is padded to ``bits`` dimensions, rotated at random and kept as its
packed sign bits with two correction scalars; a query, quantised to 4 bits per dimension, estimates inner products by popcounts.
The error bound of the estimate decides which vectors are reranked exactly: all whose upper bound
reaches the k-th best lower bound.

How many cells a query visits is measured, not set: for ``trials`` vectors, by least hash, the true
neighbours among all vectors are found by brute force in one pass, and the ranks of their cells give the
least number of cells that holds ``target`` of them. Where vectors have no clusters that number is large;
then larger cells are tried and the cheapest plan is taken, up to one that visits every cell.

Scale: cells hold about ``cell_size`` classes. Beyond ``fine`` cells a second codebook of residuals, shared
by all first-level cells, splits each, so up to ``fine`` squared cells need only two small codebooks. A cell
is cut into tiles of vectors and of queries, so no task gets an unbounded cell; a query travels to the
cells it visits, and results are cut to k per tile before they meet. A class shows its k+1 smallest ids
only - no answer needs more - so a group of copies, however large, costs one vector, and every copy still
gets its own answer.

Sound vectors: ``dim`` finite values, not all zero. Others (null, short, long, NaN) have no rows and
are nobody's neighbour. Ties go to the smaller id. Repeated deliveries (same id) count once. Fewer
than k others give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagestrata.session import stored

_EPS = 2.2


def sound(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", dim: int = 64) -> DataFrame:
    """(id, v, k1, k2): records with a sound vector and two hashes of it."""
    v = F.col(vec_col)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    got = vectors.select(F.col(id_col).alias("id"), v.cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return got.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(17), F.col("v"))})


def _unit(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(x: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """K-means by Lloyd's rounds from a seeded start; empty cells keep their old centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        half = (centres**2).sum(axis=1) / 2
        own = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)])
        sums, count = np.zeros_like(centres), np.bincount(own, minlength=len(centres))[:, None]
        np.add.at(sums, own, x)
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres).astype(np.float32)
    return centres


class Codebook:
    """Cells around the sums of a coarse centre and, beyond ``fine`` cells, a residual centre."""

    def __init__(self, sample: np.ndarray, cells: int, fine: int = 1024, seed: int = 11):
        x = sample.astype(np.float32)
        self.coarse = _fit(x, min(cells, fine), seed)
        self.rest = np.zeros((1, x.shape[1]), np.float32)
        if cells > fine:
            own = np.concatenate([np.argmax(x[i : i + 4096] @ self.coarse.T - (self.coarse**2).sum(axis=1) / 2, axis=1) for i in range(0, len(x), 4096)])
            self.rest = _fit(x - self.coarse[own], min(fine, -(-cells // len(self.coarse))), seed + 1)
        self.cells = len(self.coarse) * len(self.rest)
        self.cross = self.coarse @ self.rest.T

    def centre(self, cell: int) -> np.ndarray:
        return self.coarse[cell // len(self.rest)] + self.rest[cell % len(self.rest)]

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m nearest cells of every vector, nearest first; with two levels among those of the 32 nearest coarse centres at least."""
        a = (self.coarse**2).sum(axis=1) / 2 - x @ self.coarse.T
        n = len(self.rest)
        if n == 1:
            return _least(a, m)
        top = _least(a, min(len(self.coarse), max(32, -(-2 * m // n))))
        b = (self.rest**2).sum(axis=1) / 2 - x @ self.rest.T
        score = np.take_along_axis(a, top, 1)[:, :, None] + b[:, None, :] + self.cross[top]
        got = _least(score.reshape(len(x), -1), m)
        return np.take_along_axis(top, got // n, 1) * n + got % n


def _least(score: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m least scores of every row, in order."""
    m = min(m, score.shape[1])
    at = np.argpartition(score, m - 1, axis=1)[:, :m] if m < score.shape[1] else np.broadcast_to(np.arange(m), score.shape)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(score, at, 1), axis=1, kind="stable"), 1)


def rotation(dim: int, bits: int | None = None, seed: int = 5) -> np.ndarray:
    """A random rotation of ``dim`` dimensions, padded with zeros to ``bits``: (dim, bits)."""
    size = max(dim, bits or dim)
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r))).astype(np.float32)[:dim]


class Codes:
    """One-bit codes of base vectors around a centre, packed to 64-bit words; more bits than dimensions make the bounds tighter."""

    def __init__(self, base: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        residual = base.astype(np.float32) - centre
        self.length = np.maximum(np.linalg.norm(residual, axis=1), 1e-12)
        o = (residual / self.length[:, None]) @ turn
        self.dim = o.shape[1]
        words = -(-self.dim // 64)
        bits = np.zeros((len(o), words * 64), dtype=bool)
        bits[:, : self.dim] = o > 0
        self.words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        self.ones = bits.sum(axis=1).astype(np.float32)
        self.fit = np.abs(o).sum(axis=1) / np.sqrt(self.dim)  # inner product of a residual with its code
        self.error = _EPS * np.sqrt(np.maximum(1 - self.fit**2, 0)) / np.maximum(self.fit, 1e-6) / np.sqrt(max(1, self.dim - 1))

    def bounds(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the cosine of every (query, base) pair."""
        residual = queries.astype(np.float32) - centre
        length = np.maximum(np.linalg.norm(residual, axis=1), 1e-12)
        q = (residual / length[:, None]) @ turn
        low = q.min(axis=1, keepdims=True)
        step = np.maximum((q.max(axis=1, keepdims=True) - low) / 15, 1e-12)
        grid = np.rint((q - low) / step).astype(np.uint8)
        planes = []
        for b in range(4):
            bits = np.zeros((len(q), self.words.shape[1] * 64), dtype=bool)
            bits[:, : self.dim] = (grid >> b) & 1
            planes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
        dots = np.zeros((len(q), len(self.words)), dtype=np.uint16 if self.dim <= 2048 else np.uint32)
        for b, plane in enumerate(planes):
            ones = np.zeros_like(dots)
            for w in range(self.words.shape[1]):
                ones += np.bitwise_count(plane[:, w, None] & self.words[None, :, w])
            dots += ones << dots.dtype.type(b)
        dots = dots.astype(np.float32)
        signed = 2 * (step * dots + low * self.ones[None, :]) - (step[:, 0] * grid.sum(axis=1) + low[:, 0] * self.dim)[:, None]
        estimate = signed / np.sqrt(self.dim) / self.fit[None, :]
        error = self.error[None, :] + step * 0.5 / self.fit[None, :]
        reach = length[:, None] * self.length[None, :]
        middle = 1 - (length[:, None] ** 2 + self.length[None, :] ** 2) / 2 + reach * estimate
        return middle - reach * error, middle + reach * error


def true_neighbours(classes: DataFrame, trials: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trial, vector, cosine) of the k nearest other classes of each trial, by brute force over all classes."""
    queries, at = _unit(trials.column("v").combine_chunks()), {c: i for i, c in enumerate(trials.column("c").to_pylist())}

    def run(batches):
        best, vectors = np.full((len(queries), k), -9.0), np.zeros((len(queries), k, queries.shape[1]), np.float32)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = _unit(part.column(1))
                s = queries @ x.T
                for j, c in enumerate(part.column(0).to_pylist()):
                    if c in at:
                        s[at[c], j] = -9
                both = np.concatenate([best, s], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                old = top < k
                vectors = np.where(old[:, :, None], np.take_along_axis(vectors, np.minimum(top, k - 1)[:, :, None], 1), x[np.maximum(top - k, 0)])
                best = np.take_along_axis(both, top, 1)
        q, j = np.nonzero(best > -9)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(list(vectors[q, j]), pa.list_(pa.float32())), pa.array(best[q, j])], names=["q", "v", "cosine"])

    ranked = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine")))
    rows = classes.select("c", "v").mapInArrow(run, "q int, v array<float>, cosine double").withColumn("r", ranked).filter(F.col("r") <= k).select("q", "v", "cosine").toArrow()
    return rows.column("q").to_numpy(), _unit(rows.column("v").combine_chunks()) if len(rows) else np.zeros((0, queries.shape[1])), rows.column("cosine").to_numpy()


def visits(book: Codebook, queries: np.ndarray, near: np.ndarray, target: float, least: int = 4) -> int:
    """The least number of nearest cells of the queries that holds ``target`` of their neighbours, and not less than ``least``: trials see rare misses badly."""
    if not len(queries):
        return min(book.cells, least)
    own = book.nearest(near.astype(np.float32), 1)[:, 0]
    order = book.nearest(queries.astype(np.float32), book.cells if len(book.rest) == 1 else 4096)
    found = order == own[:, None]
    rank = np.where(found.any(axis=1), found.argmax(axis=1) + 1, book.cells)
    return min(book.cells, max(least, int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(target * len(rank))) - 1)])))


def plan_cells(classes: DataFrame, n: int, k: int, floor: float, dim: int, cell_size: int, sample: int, trials: int, target: float, fine: int) -> tuple[Codebook, int]:
    """The codebook and the number of cells a query visits, by the least cost that reaches the target."""
    drawn = classes.orderBy(F.xxhash64("k1", F.lit(3)), "c").select("c", "v").limit(sample).toArrow()
    if n == 0:
        return Codebook(np.zeros((1, dim)), 1), 1
    x = _unit(drawn.column("v").combine_chunks())
    if n <= 2 * cell_size:
        return Codebook(x, 1), 1
    q, near, cosine = true_neighbours(classes, drawn.slice(0, trials), k)
    fine_pairs = cosine >= floor
    q, near = q[fine_pairs], near[fine_pairs]
    best = None
    for size in (cell_size, 4 * cell_size, 16 * cell_size):
        book = Codebook(x, max(1, n // size), fine)
        m = visits(book, x[q], near, target)
        cost = m * (size + 500.0)  # a visit moves a vector, about the cost of 500 estimates
        if best is None or cost < best[0]:
            best = (cost, book, m)
        if m <= 8 or book.cells == 1:
            break
    return best[1], best[2]


def most_similar(
    vectors: DataFrame, k: int = 5, min_cosine: float | None = None, id_col: str = "id", vec_col: str = "embedding", dim: int = 64, cell_size: int = 500, tile: int = 4000, sample: int = 20_000,
    trials: int = 400, target: float = 0.98, fine: int = 1024, bits: int = 256, exact: bool = False,
) -> DataFrame:
    """(id, neighbour, cosine, rank): for every sound record its k most similar others, rank from 1.

    ``min_cosine`` drops neighbours below it (ranks of the rest stay the same); ``exact`` visits every cell.
    """
    records = sound(vectors, id_col, vec_col, dim)
    id_type = records.schema["id"].dataType.simpleString()
    members = records.select("id", "k1", "k2").distinct()
    first = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    shown = members.withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = stored(records.groupBy("k1", "k2").agg(F.first("v").alias("v")).join(shown, ["k1", "k2"]).withColumn("c", F.element_at("ids", 1)).select("c", "v", "ids", "k1", "k2"), "knn-classes")
    floor = -2.0 if min_cosine is None else min_cosine
    book, m = plan_cells(classes, classes.count(), k, floor, dim, cell_size, sample, trials, target, fine)
    m = book.cells if exact else m
    turn = rotation(dim, bits)

    def count(batches):
        base, asked = np.zeros(book.cells, np.int64), np.zeros(book.cells, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                near = book.nearest(_unit(batch.column(0).slice(start, 4096)).astype(np.float32), m)
                base += np.bincount(near[:, 0], minlength=book.cells)
                asked += np.bincount(near.ravel(), minlength=book.cells)
        at = np.flatnonzero(asked)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(base[at]), pa.array(asked[at])], names=["cell", "base", "asked"])

    sizes = classes.select("v").mapInArrow(count, "cell int, base bigint, asked bigint").groupBy("cell").agg(F.sum("base").alias("base"), F.sum("asked").alias("asked")).toArrow()  # a row per cell
    tiles, turns = np.ones(book.cells, np.int64), np.ones(book.cells, np.int64)
    tiles[sizes.column("cell").to_numpy()] = np.maximum(1, -(-sizes.column("base").to_numpy() // tile))
    turns[sizes.column("cell").to_numpy()] = np.maximum(1, -(-sizes.column("asked").to_numpy() // (4 * tile)))

    def place(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                near = book.nearest(_unit(part.column(1)).astype(np.float32), m)
                draw = part.column(2).to_numpy().view(np.uint64) >> np.uint64(8)
                rows = []  # (row, cell, tile, turn, base)
                at, cell = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                mine = (draw[at] // np.uint64(4096) % turns[cell].astype(np.uint64)).astype(np.int64)
                for t in range(int(tiles[cell].max())):  # a query meets all tiles of its cell
                    go = tiles[cell] > t
                    rows.append((at[go], cell[go], np.full(go.sum(), t), mine[go], np.zeros(go.sum(), bool)))
                own = near[:, 0]
                tile_of = (draw % tiles[own].astype(np.uint64)).astype(np.int64)
                for t in range(int(turns[own].max())):  # a vector meets all turns of its queries
                    go = np.flatnonzero(turns[own] > t)
                    rows.append((go, own[go], tile_of[go], np.full(len(go), t), np.ones(len(go), bool)))
                at, cell, t, u, base = (np.concatenate(z) for z in zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array(t.astype(np.int32)), pa.array(u.astype(np.int32)), pa.array(base)], names=["c", "v", "cell", "tile", "turn", "base"])

    placed = classes.select("c", "v", "k1").mapInArrow(place, f"c {id_type}, v array<float>, cell int, tile int, turn int, base boolean")
    arrow_id = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()

    def search(table: pa.Table) -> pa.Table:
        centre = book.centre(table.column("cell")[0].as_py())
        names = np.array(table.column("c").to_pylist(), dtype=object)
        x = _unit(table.column("v").combine_chunks())
        is_base = table.column("base").to_numpy(zero_copy_only=False)
        base, ask = np.flatnonzero(is_base), np.flatnonzero(~is_base)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(base) and len(ask):
            base = base[np.argsort(names[base])]
            place_of = {c: i for i, c in enumerate(names[base])}
            codes = Codes(x[base], centre, turn)
            for start in range(0, len(ask), 64):
                part = ask[start : start + 64]
                low, high = codes.bounds(x[part], centre, turn)
                for i, c in enumerate(names[part]):
                    j = place_of.get(c)
                    if j is not None:
                        low[i, j] = high[i, j] = -9
                # The likeliest k are reranked first: their k-th cosine is the bar for all others' upper bounds.
                rows, bar = np.arange(len(part))[:, None], np.full(len(part), max(floor, -3.0))
                if low.shape[1] > k:
                    likely = np.argpartition(-(low + high), k - 1, axis=1)[:, :k]
                    sure = np.einsum("ij,ikj->ik", x[part], x[base[likely]])
                    bar = np.maximum(bar, np.where(high[rows, likely] > -9, sure, -3).min(axis=1))
                qi, bi = np.nonzero(high >= bar[:, None] - 1e-6)
                if not len(qi):
                    continue
                cosine = np.einsum("ij,ij->i", x[part[qi]], x[base[bi]])
                fine = cosine >= floor - 1e-12
                qi, bi, cosine = qi[fine], bi[fine], cosine[fine]
                order = np.lexsort((bi, -cosine, qi))
                qi, bi, cosine = qi[order], bi[order], cosine[order]
                rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
                top = rank < k
                out.append((names[part[qi[top]]], names[base[bi[top]]], cosine[top]))
        q, b, s = (np.concatenate([o[i] for o in out]) if out else [] for i in range(3))
        return pa.table({"c": pa.array(list(q), arrow_id), "near": pa.array(list(b), arrow_id), "cosine": pa.array(s, pa.float64())})

    found = placed.groupBy("cell", "tile", "turn").applyInArrow(search, f"c {id_type}, near {id_type}, cosine double")
    ranked = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cosine"), "near"))
    best = found.withColumn("r", ranked).filter(F.col("r") <= k)
    # From classes to records: own copies first (cosine 1), then the shown members of the near classes.
    shown_of = classes.select("c", "ids")
    near = best.join(shown_of.select(F.col("c").alias("near"), F.col("ids").alias("others")), "near").groupBy("c").agg(F.collect_list(F.struct("cosine", "others")).alias("near"))
    offers = classes.select("c", "ids", "k1", "k2").join(near, "c", "left")
    flat = F.expr("flatten(transform(coalesce(near, array()), x -> transform(x.others, y -> struct(-x.cosine AS d, y AS id))))")
    offers = offers.withColumn("offer", F.slice(F.array_sort(F.concat(F.transform("ids", lambda y: F.struct(F.lit(-1.0000001).alias("d"), y.alias("id"))), flat)), 1, k + 1 + k)).select("k1", "k2", "offer")
    each = members.join(offers, ["k1", "k2"]).withColumn("offer", F.slice(F.filter("offer", lambda x: x.id != F.col("id")), 1, k))
    rows = each.select("id", F.posexplode("offer").alias("p", "o"))
    return rows.select("id", F.col("o.id").alias("neighbour"), F.least(-F.col("o.d"), F.lit(1.0)).alias("cosine"), (F.col("p") + 1).alias("rank"))


def similar_pairs(vectors: DataFrame, k: int = 5, min_cosine: float = 0.9, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs at ``min_cosine`` or more where one is among the k most similar of the other.

    Vectors that similar mostly share a cell, so nearly all of them are aimed at.
    """
    got = most_similar(vectors, k, min_cosine, **({"target": 0.999} | options)).filter(F.col("cosine") >= min_cosine)
    return got.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
