"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised apart; a cell is a pair of centroids. A query goes through cells by the summed
distance of its halves to the two centroids, nearest first, with a heap over the pairs (each half's centroids sorted), until
the cells hold as many entries as its budget says; all their entries are ranked by the exact inner product. Centroids
and budget are fitted on a bounded sample, every vector is indexed.

Distances are negative inner products, so that vectors of unequal length are in order, too. Cells are dealt into blocks of
bounded size, a crowded cell into several; queries of the same or neighbouring cells form groups of bounded size. A query is sent
to the blocks that hold a cell it visits, a block to the groups that visit it, and only visited cells are scored. The number of
cells grows with the table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlight.llm.common import durable

K = 20
#: Bounds of what is fitted on: vectors, and queries among them for the budget.
SAMPLE, TRIALS = 12_000, 300
#: Entries of a cell, about, while both halves have no more than MOST centroids, which the sample can bear.
CELL, MOST = 50, 1024
#: Share of a sample query's neighbours whose cells the budget is to reach. Entries of a block, queries of a group.
AIM, BLOCK, GROUP = 0.95, 8192, 2048
ROUNDS = 10


def valid(v: Column, dim: int | None = None) -> Column:
    """Vectors that take part: not null, not zero, no null or non-finite component, of the index's length."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = v.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return out & (F.size(v) == dim) if dim is not None else out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


@dataclass(frozen=True)
class Index:
    """Centroids of both halves, and the share of all entries that a query looks at, at least."""

    first: np.ndarray
    second: np.ndarray
    budget: float

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.first) * len(self.second) + nearest(x[:, self.half :], self.second)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -(q[:, : self.half] @ self.first.T), -(q[:, self.half :] @ self.second.T)

    def traverse(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, need: float) -> list[int]:
        """Cells in the order of a[i] + b[j] until they hold ``need`` entries; a heap over the frontier of pairs."""
        oa, ob = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        sa, sb = np.sort(a).tolist(), np.sort(b).tolist()
        heap, out, held, width = [(sa[0] + sb[0], 0, 0)], [], 0, len(ob)
        n = counts.tolist()
        while heap and held < need:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * width + ob[j]
            if n[cell]:
                out.append(cell)
                held += n[cell]
            if j + 1 < width:
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(oa):
                heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
        return out


def fit(sample: np.ndarray, total: int, seed: int = 3) -> Index:
    """Centroids by k-means per half; the budget by the ranks at which sample queries meet the cells of their neighbours.

    Neighbours within a sample lie further off than those in the whole table, so the share found there is on the safe side.
    """
    rng = np.random.default_rng(seed)
    half = max(1, sample.shape[1] // 2)
    k = int(np.clip(round((total / CELL) ** 0.5), 4, MOST))
    index = Index(kmeans(sample[:, :half], k, rng), kmeans(sample[:, half:], k, rng), 1.0)
    cells = index.cells(sample)
    counts = np.bincount(cells, minlength=len(index.first) * len(index.second))
    at = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    a, b = index.distances(sample[at])
    shares = []
    for q, x, y in zip(at, a, b, strict=True):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(K, len(sample) - 1)]
        sums = (x[:, None] + y).ravel()
        held = np.empty(len(sums))
        order = np.argsort(sums, kind="stable")
        held[order] = np.cumsum(counts[order])
        shares += (held[cells[best]] / len(sample)).tolist()
    return Index(index.first, index.second, float(min(1.0, np.quantile(shares, AIM))) if shares else 1.0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def deal(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell its first block and how many blocks it has: cells in a row fill a block; a larger cell has blocks of its own."""
    first, parts, block, held = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // size)), 0, 0
    for c in np.flatnonzero(counts):
        if held and held + counts[c] > size:
            block, held = block + 1, 0
        first[c] = block
        held += counts[c]
        if parts[c] > 1:
            block, held = block + int(parts[c]), 0
    return first, parts


def visits(index: Index, q: np.ndarray, reach: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Queries x cells: whether a query goes to a cell; a little beyond its reach, so that rounding never keeps it from one."""
    da, db = index.distances(q)
    return da[:, cells // len(index.second)] + db[:, cells % len(index.second)] <= (reach + 1e-9 * (1 + np.abs(reach)))[:, None]


def best_of_block(index: Index, x: np.ndarray, ids: np.ndarray, cell: np.ndarray, q: np.ndarray, asks: np.ndarray, reach: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and scores of its k best in the cells of this block that it visits."""
    order = np.argsort(cell, kind="stable")
    x, ids, cells, starts = x[order], ids[order], *np.unique(cell[order], return_index=True)
    ends, goes = np.append(starts[1:], len(order)), visits(index, q, reach, cells)
    held: list[list] = [[] for _ in range(len(q))]
    for c, (lo, hi) in enumerate(zip(starts, ends, strict=True)):
        rows = np.flatnonzero(goes[:, c])
        if len(rows):
            for i, line in zip(rows.tolist(), q[rows] @ x[lo:hi].T, strict=True):
                held[i].append((lo, line))
    out = []
    for i, found in enumerate(held):
        at = np.concatenate([np.arange(lo, lo + len(line)) for lo, line in found]) if found else np.zeros(0, np.int64)
        line = np.concatenate([line for _, line in found]) if found else np.zeros(0)
        other = ids[at] != asks[i]
        at, line = at[other], line[other]
        if len(at) > k:
            # every entry that rounding may bring among the best is scored again, in one fixed order of addition
            floor = np.partition(line, -k)[-k]
            at = at[line >= floor - 1e-9 * max(1.0, abs(floor))]
        exact = (x[at] * q[i]).sum(1)
        best = np.lexsort((ids[at], -exact))[:k]
        out.append((ids[at][best], exact[best]))
    return out


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best found per query; ties go to the smaller id.

    ``queries`` marks the rows that are queries; every row but the query's own is a candidate. Vectors that are null, zero
    or not finite, or of another length than most, take no part, nor do rows without an id; equal vectors under different ids are
    different candidates; rows that repeat an id are candidates each, but not to each other; without valid rows the result is empty.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & valid(F.col("v")))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return empty
    dim, total = dims.dim, dims["count"]
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    index = fit(_matrix(sample.column("v"), dim), total)
    width, kinds = len(index.second), len(index.first) * len(index.second)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(index.cells(_matrix(b.column(1), dim)) if b.num_rows else [], pa.int64())], names=["id", "v", "asks", "cell"])

    entries = durable(rows.mapInArrow(place, "id long, v array<double>, asks boolean, cell long"), "entries")
    counts, asked = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("m")).toLocalIterator():  # at most MOST ** 2 rows
        counts[r.cell], asked[r.cell] = r.n, r.m
    (first, parts), (grp, grps) = deal(counts, BLOCK), deal(asked, GROUP)
    need = index.budget * total

    def route(batches):
        """A row per query and block; reach is the summed distance up to which the query visits cells."""
        for b in batches:
            ids, to, at, limit = b.column(0).to_pylist(), [], [], []
            da, db = index.distances(_matrix(b.column(1), dim))
            for i in range(len(ids)):
                cells = np.array(index.traverse(da[i], db[i], counts, need), np.int64)
                last = float((da[i][cells // width] + db[i][cells % width]).max())
                blocks = sorted({*first[cells[parts[cells] == 1]].tolist()} | {int(first[c]) + p for c in cells[parts[cells] > 1] for p in range(int(parts[c]))})
                to += blocks
                at += [i] * len(blocks)
                limit += [last] * len(blocks)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(limit, pa.float64()), pa.array(to, pa.int64())], names=["id", "v", "grp", "reach", "block"])

    spread = lambda at, n: F.pmod(F.xxhash64("id"), n) + at
    groups = spark.createDataFrame([(int(c), int(grp[c]), int(grps[c])) for c in np.flatnonzero(asked)], "cell long, at long, n long")
    blocks = spark.createDataFrame([(int(c), int(first[c]), int(parts[c])) for c in np.flatnonzero(counts)], "cell long, at long, n long")
    # both tables have at most MOST ** 2 rows
    mine = entries.where("asks").join(groups, "cell").select("id", "v", spread(F.col("at"), F.col("n")).alias("grp"))
    sent = durable(mine.mapInArrow(route, "id long, v array<double>, grp long, reach double, block long"), "sent")
    pairs = sent.select(F.col("block").alias("to"), F.col("grp").alias("of")).distinct()
    dealt = entries.join(blocks, "cell").select("id", "v", "cell", spread(F.col("at"), F.col("n")).alias("block"))
    dealt = dealt.join(pairs, F.col("block") == F.col("to")).select("id", "v", "cell", "block", F.col("of").alias("grp"))

    def rank(entry: pa.Table, query: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if entry.num_rows and query.num_rows:
            asks = query.column("id").to_numpy()
            found = best_of_block(index, _matrix(entry.column("v"), dim), entry.column("id").to_numpy(), entry.column("cell").to_numpy(), _matrix(query.column("v"), dim), asks, query.column("reach").to_numpy(), k)
            for ask, (ids, scores) in zip(asks.tolist(), found, strict=True):
                out_q += [ask] * len(ids)
                out_id += ids.tolist()
                out_s += scores.tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = dealt.groupBy("block", "grp").cogroup(sent.groupBy("block", "grp")).applyInArrow(rank, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
