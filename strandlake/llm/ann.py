"""Approximate nearest neighbours: stable low-dimensional projections in kd-trees, verified until a chi-square test holds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.runtime import written

#: Dimensions of the projection (even: the chi-square law then has a closed form).
DIMS = 8
#: Probability with which a nearer vector would have been met before the search of a tree stops.
CONFIDENCE = 0.97
ROWS_PER_TREE, QUERIES_PER_BLOCK, LEAF = 8192, 2048, 128


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m (even) degrees <= x) = p, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        lo, hi = (x, hi) if 1 - math.exp(-x / 2) * total < p else (lo, x)
    return (lo + hi) / 2


class Tree:
    """Leaves of a kd-tree over points: row numbers, and the leaves' bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))] if len(points) else []
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                continue
            own = points[rows]
            d = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order = np.argpartition(own[:, d], len(rows) // 2)
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        self.low = np.array([points[r].min(axis=0) for r in self.leaves])
        self.high = np.array([points[r].max(axis=0) for r in self.leaves])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Squared least distances of queries to leaves."""
        out = np.zeros((len(queries), len(self.leaves)))
        for d in range(queries.shape[1]):
            q = queries[:, d, None]
            out += np.maximum(0, np.maximum(self.low[None, :, d] - q, q - self.high[None, :, d])) ** 2
        return out


def search(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, top: float, k: int, confidence: float, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids (-1: none) and inner products of its k nearest vectors found, ties to smaller ids.

    Inner products become distances by one more coordinate: sqrt(top^2 - |x|^2) for a vector, 0 for a query (top: the largest norm), so
    the squared distance is |q|^2 + top^2 - 2 <q, x>. A query visits leaves in the order of their projected distance and verifies all vectors in them; it stops
    at a leaf whose squared distance exceeds the chi-square quantile times the squared true distance of its k-th neighbour so far.
    """
    rng = np.random.default_rng(20_077)
    axes = rng.standard_normal((vectors.shape[1] + 1, dims))
    rest = np.sqrt(np.maximum(0, top * top - (vectors * vectors).sum(axis=1)))
    tree = Tree(np.column_stack((vectors, rest)) @ axes)
    near = tree.bounds(queries @ axes[:-1])
    order = np.argsort(near, axis=1, kind="stable")
    limit, own = chi_square_quantile(confidence, dims), (queries * queries).sum(axis=1)
    best_id, best = np.full((len(queries), k), -1, dtype=np.int64), np.full((len(queries), k), -np.inf)
    active = np.arange(len(queries))
    for r in range(len(tree.leaves)):
        leaf = order[active, r]
        distance = np.maximum(0, own[active] + top * top - 2 * best[active, -1])
        go = np.isneginf(best[active, -1]) | (near[active, leaf] <= limit * distance)
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
            rows, at = tree.leaves[leaf[some[0]]], active[some]
            scores = np.einsum("qd,nd->qn", queries[at], vectors[rows])
            new = np.broadcast_to(ids[rows], scores.shape)
            scores = np.where(new == q_ids[at][:, None], -np.inf, scores)
            all_ids, all_scores = np.concatenate((best_id[at], new), axis=1), np.concatenate((best[at], scores), axis=1)
            pick = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[at] = np.take_along_axis(all_scores, pick, axis=1)
            best_id[at] = np.where(np.isneginf(best[at]), -1, np.take_along_axis(all_ids, pick, axis=1))
    return best_id, best


def nearest(rows: DataFrame, is_query: Column, k: int = 20, confidence: float = CONFIDENCE, dims: int = DIMS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of rows (vec_id, embedding) with is_query its k nearest others by inner product.

    Rows are dealt out by a hash to blocks of about ROWS_PER_TREE with a kd-tree each; every block of queries meets every tree, and each
    tree's k best are ranked. So work grows with queries times rows in the worst case, memory only with a block. Rows with a null vec_id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part. Rows that share a vec_id are rows of their own, as candidates and as queries (each such query has its own ranks). Vectors meet those of their own length only.
    Components are scaled by a power of two for the search, so none overflows; a score beyond the range of a double is infinite.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.coalesce(good, F.lit(False)))
    base = written(base.withColumn("row", F.monotonically_increasing_id()), "nn-rows")
    largest = base.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    power = math.frexp(largest)[1]
    base = base.withColumn("v", F.transform("v", lambda x: x * F.lit(2.0 ** -(power // 2)) * F.lit(2.0 ** -(power - power // 2))))
    seen = base.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    trees, blocks, top = -(-seen["n"] // ROWS_PER_TREE) or 1, -(-(seen["q"] or 0) // QUERIES_PER_BLOCK) or 1, math.sqrt(seen["top"] or 0.0)
    block, tree = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("row"), F.lit(trees)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    stored = base.select("vec_id", "row", "v", F.size("v").alias("n"), every(blocks).alias("block"), tree.alias("tree"), F.lit(False).alias("asks"))
    asked = base.where("asks").select("vec_id", "row", "v", F.size("v").alias("n"), block.alias("block"), every(trees).alias("tree"), F.lit(True).alias("asks"))

    def run(part: pa.Table) -> pa.Table:
        vectors = part.column("v").combine_chunks()
        vectors = vectors.values.slice(vectors.offsets[0].as_py() if len(vectors) else 0).to_numpy(zero_copy_only=False).reshape(len(part), -1) if len(part) else np.zeros((0, 1))
        ids, row, asks = part.column("vec_id").to_numpy(), part.column("row").to_numpy(), np.array(part.column("asks").to_pylist(), dtype=bool)
        order = np.lexsort((row, ids))
        ids, row, asks, vectors = ids[order], row[order], asks[order], vectors[order]
        # Numbers in the order of ties, the same for a query and its own row.
        number = np.cumsum(np.concatenate(([0], (np.diff(row) != 0) | (np.diff(ids) != 0)))) if len(row) else row
        found, scores = search(number[asks], vectors[asks], number[~asks], vectors[~asks], top, k, confidence, dims)
        hit = np.isfinite(scores.ravel())
        first = np.searchsorted(number, found.ravel()[hit])
        with np.errstate(over="ignore"):
            score = np.ldexp(scores.ravel()[hit], 2 * power)
        return pa.table({"query_row": pa.array(np.repeat(row[asks], k)[hit], pa.int64()), "query_id": pa.array(np.repeat(ids[asks], k)[hit], pa.int64()), "vec_id": pa.array(ids[first], pa.int64()), "row": pa.array(row[first], pa.int64()), "score": pa.array(score, pa.float64())})

    met = stored.unionByName(asked).groupBy("n", "block", "tree").applyInArrow(run, "query_row long, query_id long, vec_id long, row long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
