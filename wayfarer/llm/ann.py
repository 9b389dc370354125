"""Approximate nearest neighbours by collision-counting hashing.

Vectors are dealt to shards.  A shard keeps ``m`` sorted arrays: the
projections of its vectors on one random direction each, the same directions
everywhere.  A query stands in the middle of a window of each array; all windows
widen together (virtual rehashing: width W times the radius, the radius growing
by ``GROWTH``), and every vector that enters a window has one collision more.
Vectors with more than the threshold of collisions are verified: their true
distance is taken.  A query ends when its k-th verified neighbour is no farther
than the radius, or when the windows hold the whole shard.  The best k of each
shard are merged to the best k.

Every row is indexed; queries are dealt in blocks, each block to all shards, so
a task holds one shard and one block whatever the sizes of the tables.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, as candidates or as queries; only vectors of equal
length are compared; ties go to the smaller id; a query is never its own
neighbour, nor is a row with its id; of rows that share an id the nearest
counts, as candidate and as query; with fewer than k candidates all are
returned; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, BLOCK = 8192, 1024
#: Approximation ratio behind the number of directions and the threshold, and the chance of missing a near vector.
RATIO, MISS = 2.0, 0.1
W = math.sqrt(8 * RATIO**2 * math.log(RATIO) / (RATIO**2 - 1))
GROWTH = 1.3


def _parameters(n: int) -> tuple[int, int]:
    """Directions, and the collisions that a vector needs to be verified, for n vectors."""
    inside = lambda r: math.erf(W / (2 * r) / math.sqrt(2))  # noqa: E731  chance that a vector at r radii is in a window
    p1, p2 = inside(1.0), inside(RATIO)
    far = math.log(2 / min(0.5, 100 / max(n, 200)))
    near = math.log(1 / MISS)
    m = math.ceil((math.sqrt(far) + math.sqrt(near)) ** 2 / (2 * (p1 - p2) ** 2))
    eta = math.sqrt(far / near)
    return m, math.ceil((eta * p1 + p2) / (1 + eta) * m)


class Shard:
    """The sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.repeats = len(np.unique(ids)) < len(ids)
        self.m, self.least = _parameters(SHARD)
        self.directions = np.random.default_rng(7).standard_normal((self.m, vectors.shape[1])).T
        projected = vectors @ self.directions
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, axis=0).T)
        self.order = np.ascontiguousarray(order.T)

    def _first_of_each(self, found: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest first, ties to the smaller id; of rows that share an id the nearest."""
        best = np.lexsort((self.ids[found], far))
        if self.repeats:
            best = best[np.sort(np.unique(self.ids[found[best]], return_index=True)[1])]
        return found[best], far[best]

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and distances of the k nearest found, nearest first."""
        n, q = len(self.ids), len(queries)
        at = queries @ self.directions
        lo = np.stack([np.searchsorted(s, x) for s, x in zip(self.sorted, at.T, strict=True)], axis=1)
        hi = lo.copy()
        # windows begin at a twentieth of the shard on either side
        step, each = max(1, n // 20), np.arange(self.m)
        near = np.minimum(np.abs(self.sorted[each, np.minimum(n - 1, lo + step)] - at), np.abs(self.sorted[each, np.maximum(0, lo - step)] - at))
        radius = np.maximum(2 * np.median(near, axis=1) / W, 1e-9 * np.maximum(np.abs(at).max(axis=1), 1e-9))
        count = np.zeros((q, n), np.int32)
        done = np.zeros((q, n), bool)
        found, far = [np.zeros(0, np.int64)] * q, [np.zeros(0)] * q
        want = k + np.isin(own, self.ids)
        active = np.arange(q)
        while len(active):
            half = W * radius[active] / 2
            a, b = np.empty((len(active), self.m), np.int64), np.empty((len(active), self.m), np.int64)
            for j in range(self.m):
                a[:, j] = np.searchsorted(self.sorted[j], at[active, j] - half)
                b[:, j] = np.searchsorted(self.sorted[j], at[active, j] + half, "right")
            a, b = np.minimum(a, lo[active]), np.maximum(b, hi[active])
            goes_on = []
            for i, a_i, b_i in zip(active.tolist(), a, b, strict=True):
                entered = [order[x:y] for order, x, y in zip(self.order, a_i.tolist(), lo[i].tolist(), strict=True)]
                entered += [order[x:y] for order, x, y in zip(self.order, hi[i].tolist(), b_i.tolist(), strict=True)]
                count[i] += np.bincount(np.concatenate(entered), minlength=n).astype(np.int32)
                new = np.flatnonzero((count[i] >= self.least) & ~done[i])
                if len(new):
                    done[i, new] = True
                    apart = np.sqrt(((self.vectors[new] - queries[i]) ** 2).sum(axis=1))
                    found[i], far[i] = self._first_of_each(np.append(found[i], new), np.append(far[i], apart))
                enough = len(found[i]) >= want[i] and far[i][want[i] - 1] <= radius[i]
                goes_on.append(not enough and int((b_i - a_i).min()) < n)
            lo[active], hi[active] = a, b
            active = active[np.array(goes_on, bool)]
            radius[active] *= GROWTH
        out = []
        for i in range(q):
            other = self.ids[found[i]] != own[i]
            out.append((self.ids[found[i][other][:k]], far[i][other][:k]))
        return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``key`` and ``score`` (Euclidean distance) of the k nearest of every query."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")).where("id IS NOT NULL")
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("v", lambda x: x != 0))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, n_blocks = max(1, -(-sizes.n // SHARD)), max(1, -(-sizes.q // BLOCK))
    grid = ["shard", "block", "size"]
    held = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.size("v").alias("size"), "id", "v")
    asked = rows.where("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), F.size("v").alias("size"), "id", "v")

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        size = table["size"][0].as_py()
        values = table["v"].combine_chunks()
        return table["id"].to_numpy(), values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)

    def run(here: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if here.num_rows and queries.num_rows:
            shard = Shard(*matrix(here))
            owners, asked = matrix(queries)
            for own, (ids, far) in zip(owners, shard.nearest(owners, asked, k), strict=True):
                out["query_id"].append(np.full(len(ids), own))
                out["id"].append(ids)
                out["score"].append(far)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.float64() if c == "score" else pa.int64()) for c, x in out.items()})

    # by number, so that a task has few cells of the grid: what they cost is not their bytes
    tasks = min(20_000, 3 * shards * n_blocks)
    held, asked = held.repartition(tasks, *grid), asked.repartition(tasks, *grid)
    near = held.groupBy(*grid).cogroup(asked.groupBy(*grid)).applyInArrow(run, "query_id bigint, id bigint, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return near.groupBy("query_id", "id").agg(F.min("score").alias("score")).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
