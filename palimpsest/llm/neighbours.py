"""Most similar vectors for every vector: score-aware quantisation, four-bit table scans, exact reranking.

Vectors are put in cells of a coarse quantiser of two levels: up to MAX_CELLS centroids, and from a million vectors on up
to FINE centroids of what remains, so that a cell keeps about CELL rows up to some hundred million vectors. What remains
then is coded in sixteen four-bit codes whose codebooks and codes weigh the error along the vector (which changes inner
products most) more than the error across it. A query scans the codes of its nearest cells by table look-ups; whatever may
be among its nearest, given the measured error of the codes, is ranked again by exact cosines.

Only centroids and codebooks are fitted on a bounded sample (SAMPLE rows); every row is indexed. How many cells a query
scans is settled by brute force: the true neighbours of about TRIED vectors, found by one pass over all rows, lie in the
cells scanned for GOAL of them, at any size; the same pairs tell the error of the codes where it counts. Cells whose border
is farther than a neighbour can be are never scanned. With ``exact`` every cell within reach of that border rule is
scanned and every pair in it is ranked by its exact cosine.

Neighbouring cells, about NEAR_CELLS of them, make a group, and a vector is shuffled once to each group that holds one of
its cells, with the list of them: the nearest cells of a vector mostly lie together.

Copies of one vector are searched once and expanded at the end, so a vector held by a third of all rows makes no hot task.
A group with more than BLOCK rows, or asked by more than BLOCK, is split into blocks on that side: every task's share is
bounded and no row is left out.

Defined results: vectors that are null, of another length, all zero or with a null or non-finite number take no part;
of an identifier that comes with several vectors the one with the least hash counts; null identifiers take no part; equal cosines go
by the lower identifier; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.util import discard, materialize

SAMPLE, CELL, MAX_CELLS, FINE, NEAR_CELLS, BLOCK = 32_768, 256, 4_096, 256, 8, 16_384
#: Vectors whose neighbours are found by brute force, share of these that the scanned cells must hold, cells scanned where there are none.
TRIED, GOAL, PROBES = 256, 0.995, 4
SUBSPACES, CENTRES = 16, 16
#: Most rows (of three short columns, under 100 bytes each) of a broadcast.
FEW = 500_000
#: Inner products from here on count in fitting; sets how much heavier the parallel error weighs: (d - 1) t^2 / (1 - t^2).
AIM = 0.4


def usable(vectors: DataFrame, identifier: str, vector: str, dim: int) -> DataFrame:
    """id, vec, h1, h2 of the rows that take part; repeated rows are still in."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.4e38)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(identifier).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(identifier).alias("id"), v.cast("array<float>").alias("vec"))
    return rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _nearest(x: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    out = []
    half = (centroids * centroids).sum(1) / 2
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ centroids.T - half
        if k == 1:
            out.append(s.argmax(1)[:, None])
            continue
        top = np.argpartition(-s, min(k, s.shape[1]) - 1, 1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(s), 1))
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), int)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids by five rounds of Lloyd's algorithm."""
    out = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(5):
        near = _nearest(x, out, 1)[:, 0]
        count = np.bincount(near, minlength=len(out))
        total, held = np.zeros(out.shape, np.float64), np.flatnonzero(count)
        total[held] = np.add.reduceat(x[np.argsort(near, kind="stable")].astype(np.float64), (np.cumsum(count) - count)[held])
        out = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], out).astype(np.float32)
    return out


class Codec:
    """Centroids of both levels, codebooks, and the error that the codes leave in an inner product. A cell is coarse * len(fine) + fine."""

    def __init__(self, sample: np.ndarray, n_cells: int, n_fine: int = 1, aim: float = AIM, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        x = _unit(sample).astype(np.float32)
        self.dim, self.sub = x.shape[1], x.shape[1] // SUBSPACES
        self.weight = np.float32(max((self.dim - 1) * aim**2 / (1 - aim**2), 1.0) - 1)
        self.centroids = _centres(x, n_cells, rng)
        near = _nearest(x, self.centroids, 1)[:, 0]
        rest = x - self.centroids[near]
        self.fine = _centres(rest, n_fine, rng) if n_fine > 1 else np.zeros((1, self.dim), np.float32)
        rest -= self.fine[_nearest(rest, self.fine, 1)[:, 0]]
        # Groups of neighbouring cells: of fine cells within a coarse one where there are enough, else of coarse ones.
        points = self.fine if n_fine >= NEAR_CELLS else self.centroids
        lots = _nearest(points, _centres(points, max(1, len(points) // NEAR_CELLS), rng), 1)[:, 0].astype(np.int32)
        self.group = np.add.outer(np.arange(len(self.centroids), dtype=np.int32) * (lots.max() + 1), lots).ravel() if n_fine >= NEAR_CELLS else np.repeat(lots, n_fine)
        self.books = np.stack([rest[rng.permutation(len(x))[np.arange(CENTRES) % len(x)], m * self.sub : (m + 1) * self.sub] for m in range(SUBSPACES)])
        for _ in range(6):
            codes = self.encode(x, rest)
            self._fit(x, rest, codes)
        # Error of q.x by the codes, for sampled pairs of one cell; ``calibrate`` replaces it by that of true neighbours.
        err = rest - self.decode(self.encode(x, rest))
        order = np.argsort(near, kind="stable")
        pairs = [(order[:-k], order[k:]) for k in (1, 2, 5) if len(x) > k]
        seen = np.concatenate([(x[a] * err[b]).sum(1)[near[a] == near[b]] for a, b in pairs]) if pairs else np.zeros(0)
        self.margin = float(np.quantile(np.abs(seen), 0.9995)) + 0.01 if len(seen) else 0.1
        self.probes = PROBES

    def centre(self, cell):
        """The point that a cell's codes start from."""
        return self.centroids[np.asarray(cell) // len(self.fine)] + self.fine[np.asarray(cell) % len(self.fine)]

    def cells(self, x: np.ndarray, probes: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The cells of unit vectors, own cell first, then by distance, and which of them may hold anything within ``reach``.

        A vector within reach lies in another cell only if the border of that cell is within reach; this holds on both levels.
        """
        many = min(len(self.centroids), probes)
        near = _nearest(x, self.centroids, many)
        apart = lambda a, b: np.sqrt(((a - b) ** 2).sum(-1))
        gap = ((x[:, None] - self.centroids[near]) ** 2).sum(2)
        needed = (gap - gap[:, :1]) <= 2 * apart(self.centroids[near], self.centroids[near[:, :1]]) * reach + 1e-5
        needed[:, 0] = True
        if len(self.fine) == 1:
            return near, needed
        few = min(len(self.fine), probes)
        cells, far, need = [], [], []
        for j in range(many):
            rest = x - self.centroids[near[:, j]]
            sub = _nearest(rest, self.fine, few)
            d = ((rest[:, None] - self.fine[sub]) ** 2).sum(2)
            cells.append(near[:, j : j + 1] * len(self.fine) + sub)
            need.append(needed[:, j : j + 1] & ((d - d[:, :1]) <= 2 * apart(self.fine[sub], self.fine[sub[:, :1]]) * reach + 1e-5))
            far.append(d)
        far[0][:, 0] = -1.0
        cells, far, need = (np.concatenate(v, 1) for v in (cells, far, need))
        order = np.argsort(np.where(need, far, np.inf), 1, kind="stable")[:, :probes]
        return np.take_along_axis(cells, order, 1), np.take_along_axis(need, order, 1)

    def calibrate(self, q: np.ndarray, n: np.ndarray, reach: float) -> None:
        """How many cells to scan, and the error of the codes, from pairs of a vector and a true neighbour of it."""
        if not len(q):
            return
        q, n = _unit(q).astype(np.float32), _unit(n).astype(np.float32)
        own = self.cells(n, 1, reach)[0][:, 0]
        most = min(len(self.centroids) * len(self.fine), 64)
        where = self.cells(q, most, reach)[0] == own[:, None]
        rank = np.where(where.any(1), where.argmax(1), most) + 1
        self.probes = max(2, min(most, int(np.quantile(rank, GOAL, method="higher"))))
        rest = n - self.centre(own)
        err = np.abs((q * (rest - self.decode(self.encode(n, rest)))).sum(1))
        self.margin = float(err.max()) * 1.1 + 0.01

    def encode(self, x: np.ndarray, rest: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |error|^2 + weight (error along x)^2."""
        codes = np.zeros((len(x), SUBSPACES), np.uint8)
        along = np.zeros((len(x), SUBSPACES), np.float32)
        for turn in range(passes):
            for m in range(SUBSPACES):
                at = slice(m * self.sub, (m + 1) * self.sub)
                c = self.books[m]
                other = along.sum(1) - along[:, m]
                par = (x[:, at] * rest[:, at]).sum(1)[:, None] - x[:, at] @ c.T
                loss = (c * c).sum(1) - 2 * rest[:, at] @ c.T + self.weight * ((other[:, None] if turn else 0) + par) ** 2
                codes[:, m] = loss.argmin(1)
                along[:, m] = np.take_along_axis(par, codes[:, m : m + 1].astype(int), 1)[:, 0]
        return codes

    def _fit(self, x: np.ndarray, rest: np.ndarray, codes: np.ndarray) -> None:
        """Codebooks for given codes: weighted least squares, one small system per centre."""
        err = rest - self.decode(codes)
        for m in range(SUBSPACES):
            at = slice(m * self.sub, (m + 1) * self.sub)
            along = (x * err).sum(1) - (x[:, at] * err[:, at]).sum(1)
            for k in range(CENTRES):
                own = codes[:, m] == k
                if not own.any():
                    continue
                xm, rm = x[own, at].astype(np.float64), rest[own, at]
                left = self.weight * xm.T @ xm + own.sum() * np.eye(self.sub)
                right = (self.weight * (along[own] + (xm * rm).sum(1))[:, None] * xm + rm).sum(0)
                self.books[m, k] = np.linalg.solve(left, right)
            err[:, at] = rest[:, at] - self.books[m][codes[:, m]]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[m][codes[:, m]] for m in range(SUBSPACES)], 1)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Inner products of unit queries with what the codes stand for, from byte-wide tables (two four-bit codes a byte)."""
        tables = np.einsum("qms,mks->qmk", queries.reshape(len(queries), SUBSPACES, self.sub), self.books)
        low = tables.min(2, keepdims=True)
        step = np.maximum((tables - low).max((1, 2)) / 127, 1e-12)
        small = np.rint((tables - low) / step[:, None, None]).astype(np.uint8)
        total = np.zeros((len(queries), len(packed)), np.uint16)
        for j in range(SUBSPACES // 2):
            both = (small[:, 2 * j, None, :] + small[:, 2 * j + 1, :, None]).reshape(len(queries), 256)
            total += np.take(both, packed[:, j], axis=1)
        return total * step[:, None].astype(np.float32) + low.sum((1, 2))[:, None].astype(np.float32)


def _stack(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32, copy=False) if len(column) else np.zeros((0, dim), np.float32)


def _search(codec: Codec, base: np.ndarray, names: np.ndarray, cell: int, queries: np.ndarray, asks: np.ndarray, k: int, least: float, exact: bool = False) -> Iterator[pd.DataFrame]:
    b = _unit(base)
    rest = b.astype(np.float32) - codec.centre(cell)
    codes = codec.encode(b.astype(np.float32), rest)
    packed = codes[:, 0::2] | (codes[:, 1::2] << 4)
    for a in range(0, len(queries), 256):
        q = _unit(queries[a : a + 256])
        q32 = q.astype(np.float32)
        rough = q32 @ b.T.astype(np.float32) if exact else codec.scan(q32, packed) + (q32 @ codec.centre(cell))[:, None]
        margin = 1e-5 if exact else codec.margin
        floor = np.full(len(q), least - margin, np.float32)
        if len(b) > k + 1:  # the k nearest, and the query itself, have at least the (k+1)th best rough score less the error
            floor = np.maximum(floor, np.partition(rough, len(b) - k - 1, 1)[:, len(b) - k - 1] - 2 * margin)
        qi, bi = np.nonzero(rough >= floor[:, None])
        cos = np.concatenate([(q[qi[s : s + 65_536]] * b[bi[s : s + 65_536]]).sum(1) for s in range(0, len(qi), 65_536)]) if len(qi) else np.zeros(0)
        found = pd.DataFrame({"q": asks[a : a + 256][qi], "n": names[bi], "cos": cos})
        found = found[(found["cos"] >= least) & (found["q"] != found["n"])].sort_values(["q", "cos", "n"], ascending=[True, False, True])
        yield found.groupby("q", sort=False).head(k)


def _tried(distinct: DataFrame, total: int, k: int, least: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one of about TRIED vectors and each of its true neighbours (at most k), by one pass over all rows."""
    share = min(1.0, TRIED / total)
    asked = distinct.where(F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).toPandas().drop_duplicates("id")
    names, q = asked["id"].to_numpy(), _unit(_stack(asked["vec"], dim)).astype(np.float32) if len(asked) else np.zeros((0, dim), np.float32)
    shared = distinct.sparkSession.sparkContext.broadcast((names, q))

    def try_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = shared.value
        for batch in batches:
            cos = _unit(_stack(batch["vec"], dim)).astype(np.float32) @ q.T
            cos[batch["id"].to_numpy()[:, None] == names[None, :]] = -2
            if len(cos) > k:
                cos = np.where(cos >= np.partition(cos, len(cos) - k, 0)[len(cos) - k], cos, -2)
            i, j = np.nonzero(cos >= least)
            yield pd.DataFrame({"query_no": j.astype(np.int32), "id": batch["id"].to_numpy()[i], "cos": cos[i, j].astype(float), "vec": batch["vec"].to_numpy()[i]})

    found = distinct.mapInPandas(try_all, "query_no int, id string, cos double, vec array<float>")
    found = _top(found.dropDuplicates(["query_no", "id"]).withColumn("far", -F.col("cos")), "query_no", ["far", "id"], k).select("query_no", "vec").toPandas()  # at most k rows of each
    return q[found["query_no"].to_numpy()], _stack(found["vec"], dim)


def nearest(vectors: DataFrame, k: int = 10, least: float = 0.9, dim: int = 64, identifier: str = "id", vector: str = "vec", sample: int = SAMPLE, exact: bool = False) -> DataFrame:
    """q, n, cos: for each identifier its at most k nearest others with a cosine of at least ``least``."""
    spark = vectors.sparkSession
    every_row = usable(vectors, identifier, vector, dim)
    # Only hashes are shuffled to settle identifiers and copies; vectors stay where they are read.
    rows = materialize(every_row.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2"), "identifiers")
    # Copies: one representative, the lowest identifier, and the lowest k + 1 identifiers of each vector.
    reps = materialize(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vectors")
    total = reps.count()
    if not total:
        return spark.createDataFrame([], "q string, n string, cos double")
    distinct = _representatives(every_row, rows, reps)
    share = min(1.0, sample / total)  # of the hash range, so about ``sample`` rows whatever the size of the table
    part = distinct.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").toPandas()
    n_cells = int(np.clip(total // CELL, 1, min(MAX_CELLS, max(1, len(part) // 8))))
    codec = Codec(_stack(part["vec"], dim), n_cells, int(np.clip(total // (CELL * n_cells), 1, FINE)) if n_cells == MAX_CELLS else 1)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    if not exact:
        codec.calibrate(*_tried(distinct, total, k, least, dim), reach)
    probes = len(codec.centroids) * len(codec.fine) if exact else codec.probes
    shared = spark.sparkContext.broadcast(codec)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for batch in batches:
            cells, needed = c.cells(_unit(_stack(batch["vec"], dim)).astype(np.float32), probes, reach)
            lots = c.group[cells]
            at, lot, own, lists = [], [], [], []
            for i in range(len(cells)):
                mine = needed[i]
                for g in dict.fromkeys(lots[i][mine].tolist()):  # the group of the own cell comes first
                    at.append(i)
                    own.append(not lists or at[-2] != i)
                    lot.append(g)
                    lists.append(cells[i][mine & (lots[i] == g)].tolist())
            yield pd.DataFrame({"id": batch["id"].to_numpy()[at], "vec": batch["vec"].to_numpy()[at], "lot": lot, "own": own, "cells": lists})

    # Placing takes more than writing the vectors once for each of their groups; that copy is deleted after the search.
    placed = materialize(distinct.mapInPandas(place, "id string, vec array<float>, lot int, own boolean, cells array<int>"), "placed")
    # At most MAX_CELLS * FINE / NEAR_CELLS rows of twelve bytes; as a rule none.
    sizes = placed.groupBy("lot").agg(F.ceil(F.count_if("own") / BLOCK).cast("int").alias("pb"), F.ceil(F.count("*") / BLOCK).cast("int").alias("pa")).where("pb > 1 or pa > 1")
    sizes = materialize(sizes, "cells")
    groups = _blocks(placed, sizes)

    def search(group: pd.DataFrame) -> pd.DataFrame:
        c, empty = shared.value, pd.DataFrame({"q": pd.Series(dtype=str), "n": pd.Series(dtype=str), "cos": pd.Series(dtype=float)})
        group = group.drop_duplicates(["id", "base", "asks"])
        names, x = group["id"].to_numpy(), _stack(group["vec"], dim)
        lists = group["cells"].to_numpy()
        home = np.fromiter((r[0] for r in lists), np.int64, len(lists))
        base = np.flatnonzero(group["base"].to_numpy())
        asks = np.flatnonzero(group["asks"].to_numpy())
        if not len(base) or not len(asks):
            return empty
        asks = np.repeat(asks, np.fromiter((len(lists[i]) for i in asks), np.int64, len(asks)))
        wanted = np.concatenate([lists[i] for i in dict.fromkeys(asks.tolist())]).astype(np.int64)
        found = []
        for cell in np.unique(home[base]):
            b, q = base[home[base] == cell], asks[wanted == cell]
            if len(q):
                found += [f for f in _search(c, x[b], names[b], int(cell), x[q], names[q], k, least, exact) if len(f)]
        if not found:
            return empty
        found = pd.concat(found).sort_values(["q", "cos", "n"], ascending=[True, False, True])
        return found.groupby("q", sort=False).head(k)

    near = materialize(groups.groupBy("lot", "b", "a").applyInPandas(search, "q string, n string, cos double"), "near")
    discard(placed)
    return _expand(rows, reps, near, k)


def _blocks(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """placed with b, a (block of bases, block of askers), base, asks: in a large group (``sizes``: its blocks pb, pa) each block of bases meets each of askers."""
    whole = F.struct(F.lit(0).alias("b"), F.lit(0).alias("a"), F.col("own").alias("base"), F.lit(True).alias("asks"))
    columns = ["lot", "x.*", "id", "vec", "cells"]
    if not sizes.head(1):
        return placed.withColumn("x", whole).select(*columns)
    rows = placed.join(F.broadcast(sizes), "lot", "left")
    mine = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(parts)).cast("int")
    put = lambda b, a, base: F.struct(b.alias("b"), a.alias("a"), F.lit(base).alias("base"), F.lit(not base).alias("asks"))
    upto = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    as_asker = F.transform(upto("pb"), lambda b: put(b, mine(1, "pa"), False))
    as_base = F.transform(upto("pa"), lambda a: put(mine(0, "pb"), a, True))
    both = F.when(F.col("pb").isNull(), F.array(whole)).when(F.col("own"), F.concat(as_base, as_asker)).otherwise(as_asker)
    return rows.withColumn("x", F.explode(both)).select(*columns)


def _representatives(every_row: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """id, vec of the representatives. Rows to leave out are few as a rule; they are broadcast if they are at most FEW, else joined by a shuffle."""
    left_out = every_row.select("id", "h1", "h2").join(reps, ["id", "h1", "h2"], "left_anti").distinct()
    left_out = materialize(left_out, "left-out")
    small = F.broadcast(left_out) if left_out.count() <= FEW else left_out
    return every_row.join(small, ["id", "h1", "h2"], "left_anti").select("id", "vec")


def _expand(rows: DataFrame, reps: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours of all identifiers from those of the representatives of equal vectors."""
    best = _top(near.select("q", (-F.col("cos")).alias("far"), "n"), "q", ["far", "n"], k)
    single = reps.where("n = 1").select(F.col("id").alias("q"))
    several = materialize(reps.where("n > 1").select("h1", "h2", F.col("id").alias("rep")), "copies")
    of = rows.select("id", "h1", "h2").join(several, ["h1", "h2"]).select("rep", "id")
    low = _top(of, "rep", ["id"], k + 1)
    # Representatives that stand for one identifier are their own members.
    members = best.join(low.select(F.col("rep").alias("n"), F.col("id").alias("m")), "n", "left").select("q", "far", F.coalesce("m", "n").alias("n"))
    own = low.select(F.col("rep").alias("q"), F.lit(-1.0).alias("far"), F.col("id").alias("n"))
    lists = _top(members.unionAll(own), "q", ["far", "n"], k + 1)
    alone = lists.join(single, "q", "left_semi").groupBy("q").agg(_list(k).alias("l"))
    shared = lists.join(several.select(F.col("rep").alias("q")), "q", "left_semi").groupBy("q").agg(_list(k + 1).alias("l"))
    of_copies = of.join(shared, of["rep"] == shared["q"]).select(F.col("id").alias("q"), F.slice(F.filter("l", lambda x: x["n"] != F.col("id")), 1, k).alias("l"))
    return alone.select("q", "l").unionAll(of_copies).select("q", F.explode("l").alias("x")).select("q", F.col("x.n").alias("n"), (-F.col("x.far")).alias("cos"))


def _list(k: int) -> Column:
    return F.slice(F.sort_array(F.collect_list(F.struct("far", "n"))), 1, k)


def _top(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits each group before the shuffle, so a hot key stays small."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def pairs(near: DataFrame) -> DataFrame:
    """memory_a < memory_b: each pair once."""
    return near.select(F.least("q", "n").alias("memory_a"), F.greatest("q", "n").alias("memory_b")).distinct()
