"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact distances.

Each node splits at the median of the projections onto the difference of two points, and the depth follows from the number
of rows. The upper levels are fitted on a bounded sample; where the table asks for more, each of their cells fits the levels below it on its own share
of a sample that grows with the table, side by side on the executors. The trees together are bounded in bytes. Every row of the table is put into
one leaf of each tree. A query's leaves are taken best first from one queue over all trees, ordered by
the largest margin that the way to a leaf crosses.

How many leaves a query visits is measured, not set: for some probes the true neighbours are found by one scan of
the table, and the visits are as many as reach the wanted share of them. Vectors with structure need few;
vectors spread evenly over many dimensions need a large share, which no index of this kind avoids.

Leaves are joined with the queries that visit them in blocks of bounded size on both sides, and a block sends on its
k nearest for each query only. Of equal vectors only the k + 1 smallest ids can be among the k nearest of
any query (one may be the query itself), so the others are left out of the index: an exact rule,
whatever the size of a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietday.llm.common import cut, small_batches

#: Trees, rows in a leaf (about), the share of the true neighbours to reach and the rows it is measured on.
TREES, LEAF_ROWS, RECALL, PROBES = 4, 400, 0.965, 96
#: Bounds of what the upper levels are fitted on, rows of a sample that a leaf needs at least, and bytes of all trees.
SAMPLE_ROWS, SAMPLE_BYTES, LEAF_SAMPLE, FOREST_BYTES = 65_536, 64 << 20, 16, 256 << 20
#: Bytes of the vectors, and of the queries, of a block at most (about), and of a table of distances.
BLOCK_BYTES = 32 << 20


@dataclass
class Forest:
    """Trees as complete binary heaps: normals (trees, nodes, dims) and thresholds (trees, nodes)."""

    normals: np.ndarray
    thresholds: np.ndarray
    depth: int

    @property
    def cells(self) -> int:
        return len(self.thresholds) << self.depth

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The cell (tree and leaf as one number) of each row in each tree."""
        out = np.empty((len(x), len(self.thresholds)), np.int64)
        for t, (normals, thresholds) in enumerate(zip(self.normals, self.thresholds, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, normals[node]) >= thresholds[node]
                node = 2 * node + 1 + side
            out[:, t] = (t << self.depth) + node - ((1 << self.depth) - 1)
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Cells for one query, best first over all trees."""
        margins = self.normals @ q - self.thresholds
        inner = (1 << self.depth) - 1
        queue = [(-np.inf, t, 0) for t in range(len(margins))]
        out: list[int] = []
        while queue and len(out) < most:
            crossed, t, node = heapq.heappop(queue)
            if node >= inner:
                out.append((t << self.depth) + node - inner)
                continue
            m = margins[t, node]
            near = 2 * node + 1 + (m >= 0)
            far = 4 * node + 3 - near
            heapq.heappush(queue, (max(crossed, -abs(m)), t, near))
            heapq.heappush(queue, (max(crossed, abs(m)), t, far))
        return out


    def turns(self, q: np.ndarray) -> np.ndarray:
        """For each cell, as which one (from 1) the query visits it."""
        margins = self.normals @ q - self.thresholds
        crossed = np.full((len(margins), 1), -np.inf)
        for level in range(self.depth):
            m = margins[:, (1 << level) - 1 : (2 << level) - 1]
            crossed = np.stack([np.maximum(crossed, m), np.maximum(crossed, -m)], 2).reshape(len(margins), -1)
        turn = np.empty(self.cells, np.int64)
        turn[np.argsort(crossed.ravel(), kind="stable")] = np.arange(1, self.cells + 1)
        return turn


def grow(sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
    rng, dims = np.random.default_rng(seed), sample.shape[1]
    normals, thresholds = np.zeros((trees, (1 << depth) - 1, dims)), np.zeros((trees, (1 << depth) - 1))
    for t in range(trees):
        rows = [np.arange(len(sample))]
        for node in range((1 << depth) - 1):
            own = rows[node]
            w = np.zeros(dims)
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                w = sample[a] - sample[b]
            if not w.any():
                w = rng.standard_normal(dims)
            w /= np.linalg.norm(w)
            side = sample[own] @ w
            middle = float(np.median(side)) if len(own) else 0.0
            normals[t, node], thresholds[t, node] = w, middle
            rows += [own[side < middle], own[side >= middle]]
    return Forest(normals, thresholds, depth)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part; repeated ids take the least vector. Floats stay floats, all else is double."""
    v = F.col("v")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall(v, number) & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """List column to doubles; all lists have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows to one vector; a power of two for each keeps squares within the range of doubles."""
    half = x / 2 - q / 2
    power = np.frexp(np.abs(half).max(axis=1, initial=0.0))[1]
    return np.ldexp(np.sqrt((np.ldexp(half, -power[:, None]) ** 2).sum(1)), power + 1)


def nearest_in_block(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of the block, distance) of each query's k nearest of the block, without itself; exact."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    power = np.frexp(max(np.abs(x).max(initial=0.0), np.abs(q).max(initial=0.0)))[1]
    scaled, asked = np.ldexp(x, -power), np.ldexp(q, -power)
    norms = (scaled**2).sum(1)
    step = max(1, BLOCK_BYTES // (8 * max(len(x), 1)))
    for a in range(0, len(q), step):
        part = asked[a : a + step]
        own = (part**2).sum(1)
        rough = norms[None, :] + own[:, None] - 2 * part @ scaled.T
        for i, qid in enumerate(q_ids[a : a + step]):
            row = np.where(ids == qid, np.inf, rough[i])
            # all that rounding could put among the k nearest, ties included; it grows with the norms, not the distances
            slack = 32 * (x.shape[1] + 2) * np.finfo(float).eps * (norms.max(initial=0.0) + own[i])
            edge = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            near = np.nonzero((row <= edge + slack) & (row < np.inf))[0] if edge < np.inf else np.nonzero(row < np.inf)[0]
            exact = distances(x[near], q[a + i])
            best = np.lexsort((ids[near], exact))[:k]
            out.append((np.full(len(best), qid), near[best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def depth_for(rows: int, sample: int) -> int:
    """Levels of a tree: leaves of about LEAF_ROWS rows and, in the sample, of LEAF_SAMPLE rows at least."""
    levels = lambda n, leaf: int(np.floor(np.log2(max(n, 1) / leaf) + 0.5))
    return max(0, min(levels(rows, LEAF_ROWS), levels(sample, LEAF_SAMPLE)))


def deepened(top: Forest, index: DataFrame, total: int, depth: int, seed: int) -> Forest:
    """The trees of `top` grown to `depth`: each of their cells fits its own levels, on about LEAF_SAMPLE rows of `index` for each new leaf.

    A cell's rows of the sample come together in one task: about LEAF_SAMPLE << (depth - top.depth) of them, since cells are cut at medians.
    Only the new nodes come to the driver, which FOREST_BYTES bounds.
    """
    trees, dims, more = len(top.thresholds), top.normals.shape[2], depth - top.depth
    shared = index.sparkSession.sparkContext.broadcast(top)
    wanted = min(total, LEAF_SAMPLE << depth)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = shared.value.leaves(matrix(b.column(1)))
            got = b.take(pa.array(np.repeat(np.arange(b.num_rows), trees)))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), got.column(0), got.column(1)], ["cell", "vec_id", "v"])

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")  # the same tree, however rows arrive
        cell = rows.column("cell")[0].as_py()
        own = grow(matrix(rows.column("v").combine_chunks()), 1, more, seed + 1 + cell)
        return pa.table([pa.array([cell]), pa.array([own.normals[0].ravel()], pa.list_(pa.float64())), pa.array([own.thresholds[0]], pa.list_(pa.float64()))], ["cell", "normals", "thresholds"])

    filed = draw(index, wanted, total, seed, "lower levels").mapInArrow(put, f"cell long, vec_id long, v {dict(index.dtypes)['v']}")
    fitted = filed.groupBy("cell").applyInArrow(fit, "cell long, normals array<double>, thresholds array<double>")
    rng = np.random.default_rng(seed)
    normals, thresholds = np.zeros((trees, (1 << depth) - 1, dims)), np.zeros((trees, (1 << depth) - 1))
    upper = (1 << top.depth) - 1
    normals[:, :upper], thresholds[:, :upper] = top.normals, top.thresholds
    # a cell of which the sample holds nothing splits at random
    normals[:, upper:] = rng.standard_normal((1, (1 << depth) - 1 - upper, dims)) / np.sqrt(dims)
    for cell, n, t in fitted.toLocalIterator():
        tree, leaf = cell >> top.depth, cell & ((1 << top.depth) - 1)
        n, t = np.reshape(n, (-1, dims)), np.asarray(t)
        for level in range(more):
            to, own = ((1 << top.depth + level) - 1) + (leaf << level), (1 << level) - 1
            normals[tree, to : to + (1 << level)], thresholds[tree, to : to + (1 << level)] = n[own : own + (1 << level)], t[own : own + (1 << level)]
    return Forest(normals, thresholds, depth)


def draw(rows: DataFrame, most: int, total: int, seed: int, purpose: str) -> DataFrame:
    """About `most` of the rows (all, if there are no more), chosen by a hash of the id."""
    parts = 1 << 30
    return rows.where(F.pmod(F.xxhash64("vec_id", F.lit(purpose), F.lit(seed)), F.lit(parts)) < int(min(parts, parts * most / max(total, 1))))


def visits_needed(index: DataFrame, probes: DataFrame, forest: Forest, k: int) -> list[int]:
    """For each true neighbour of each probe, how many leaves the probe visits until one holds it; one scan of `index`."""
    got = probes.toArrow()
    p_ids, p = got.column(0).to_numpy(), matrix(got.column(1).combine_chunks())
    order = {int(i): n for n, i in enumerate(p_ids)}
    shared = index.sparkSession.sparkContext.broadcast((p_ids, p, forest))
    trees = len(forest.thresholds)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_ids, p, forest = shared.value
        probe, near, far, cells = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, trees), np.int64)
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1))
            asked, at, away = nearest_in_block(ids, x, p_ids, p, k)
            probe = np.concatenate([probe, np.array([order[int(i)] for i in asked], np.int64)])
            near, far, cells = np.concatenate([near, ids[at]]), np.concatenate([far, away]), np.concatenate([cells, forest.leaves(x)[at]])
            by = np.lexsort((near, far, probe))
            probe, near, far, cells = probe[by], near[by], far[by], cells[by]
            least = np.arange(len(probe)) - np.searchsorted(probe, probe) < k
            probe, near, far, cells = probe[least], near[least], far[least], cells[least]
        yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(near), pa.array(far), pa.array(list(cells), pa.list_(pa.int64()))], ["probe", "vec_id", "score", "cells"])

    seen = index.mapInArrow(scan, "probe long, vec_id long, score double, cells array<long>")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", "vec_id"))
    met: list[int] = []
    for r in seen.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("probe").agg(F.collect_list("cells").alias("cells")).collect():
        turn = forest.turns(p[r["probe"]])
        met += turn[np.array(r["cells"])].min(1).tolist()
    return met


def search(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = TREES, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k nearest found: query_id, rank, vec_id, score (Euclidean distance).

    Queries are the rows whose id is divisible by `every`, candidates all rows but the query's own. Nearest
    first, ties to the smaller id; all candidates, if fewer than k. Null and zero vectors, those with null
    or non-finite components and those of another length than most rows (ties: the longer) take no
    part, as rows without an id. Repeated ids count once, with their least vector. An empty table, or one without
    queries or candidates, gives no rows; other columns are ignored, whatever their names. `recall` is
    the share of true neighbours that the visits are to reach, measured on PROBES rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = cut(valid(vectors, id_col, vector_col))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims, total = (lengths["d"], lengths["n"]) if lengths else (1, 0)
    rows = rows.where(F.size("v") == dims)
    queries = rows.where(F.col("vec_id") % every == 0)
    first = Window.partitionBy("v").orderBy("vec_id")
    index = cut(rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n"))
    sample_rows = min(sample_rows, SAMPLE_BYTES // (8 * dims))
    depth = depth_for(total, min(sample_rows, total))
    whole = min(depth_for(total, total), int(np.log2(FOREST_BYTES / (8 * dims * trees))))
    sample = matrix(draw(index, sample_rows, total, seed, "forest").select("v").toArrow().column(0).combine_chunks())
    grown = grow(sample.reshape(-1, dims), trees if depth else 1, depth, seed)
    if whole > depth:
        grown = deepened(grown, index, total, whole, seed)
    forest = spark.sparkContext.broadcast(grown)
    needed = np.sort(visits_needed(index, draw(rows, PROBES, total, seed, "probes"), grown, k))
    most = int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else grown.cells

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = forest.value.leaves(matrix(b.column(1)))
            which = np.repeat(np.arange(b.num_rows), cells.shape[1])
            got = b.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), got.column(0), got.column(1)], ["cell", "vec_id", "v"])

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [forest.value.visits(q, most) for q in matrix(b.column(1))]
            which = np.repeat(np.arange(b.num_rows), [len(c) for c in cells])
            got = b.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([pa.array([c for x in cells for c in x], pa.int64()), got.column(0), got.column(1)], ["cell", "vec_id", "v"])

    schema = f"cell long, vec_id long, v {dict(rows.dtypes)['v']}"
    filed, called = index.mapInArrow(put, schema), queries.mapInArrow(call, schema)

    per = max(1, BLOCK_BYTES // (8 * dims))
    sizes = lambda side, name: side.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
    # into how many blocks each cell's rows and queries go: a row for each cell that has both, of which the forest has a bounded number
    cells = F.broadcast(cut(sizes(filed, "of_rows").join(sizes(called, "of_queries"), "cell")))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cell", "vec_id", "v", "block", "q_block"]
    left = filed.join(cells, "cell").withColumn("block", own("of_rows")).withColumn("q_block", each("of_queries")).select(*columns)
    right = called.join(cells, "cell").withColumn("q_block", own("of_queries")).withColumn("block", each("of_rows")).select(*columns)

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        ids = a.column("vec_id").to_numpy()
        asked, at, far = nearest_in_block(ids, matrix(a.column("v").combine_chunks()), b.column("vec_id").to_numpy(), matrix(b.column("v").combine_chunks()), k)
        return pa.table([pa.array(asked), pa.array(ids[at]), pa.array(far)], names)

    keys = ["cell", "block", "q_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, "query_id long, vec_id long, score double")
    # a vector is found once in each tree at most, with one distance, so its rows stand together
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    top = found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k * len(grown.thresholds))
    once = top.withColumn("again", F.lag("vec_id").over(by) == F.col("vec_id")).where("again is null or not again")
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
