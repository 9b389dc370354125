"""Hard negatives by branch and bound in ball trees.

Rows are dealt to shards by a range partition on label and on the signs of random
projections, so that neighbours lie together whatever the sizes of groups.  A shard
builds a tree of balls, halved along the line between two far rows, and stores it as a row.
For an anchor q, inner products in a ball of centre c and radius r lie between
``q.c - |q| r`` and ``q.c + |q| r``: a node is left out if they are outside the
asked score window, strictly beneath the k-th score that the anchor has by now, or if all
its labels are of the wrong kind.  The same holds for whole shards by their outermost
ball: an anchor first asks the shard with the best bound of each block of shards, and then, with
the k-th score of these, only the shards that can still give something.

Anchors find their positives (same label) first; each positive gives a window for
its negatives.  Scores are integers and exact; bounds leave room for rounding.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; of rows that share an id the smallest label, then vector, counts; only
vectors of equal length are compared; ties go to the smaller id; an empty vector
has score 0 with others; a window that holds nothing gives no rows; an empty table gives
no rows; other columns play no part.  A score outside a long raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm._shared import small, written

#: Rows of a shard (about) and of a leaf, asks that meet a shard at a time, and shards whose bounds are looked at together.
SHARD, LEAF, BLOCK, ROUTED = 8192, 64, 2048, 1024
PROJECTIONS = 16
NONE = -(2**62)

TREE = "shard bigint, size int, center binary, radius double, only string, ids binary, labels array<string>, vectors binary, centers binary, radii binary, spans binary"
ASK = "anchor bigint, turn int, label string, same boolean, positive bigint, size int, v array<bigint>, kth bigint"
FOUND = "anchor bigint, turn int, id bigint, score bigint"


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    most = float(np.abs(queries.astype(np.float64)).max()) * float(np.abs(vectors.astype(np.float64)).max()) * queries.shape[1]
    if most < 2**53:
        return np.rint(queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.astype(object).T
    if max(map(abs, exact.flat)) >= 2**62:
        raise OverflowError("a score doesn't fit a long")
    return exact.astype(np.int64)


class Tree:
    """Balls over rows in ``order``: node i covers ``spans[i]`` = (start, end, left child or -1); the right child follows all of the left one."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.order = np.lexsort((ids,))
        self.vectors, self.ids = vectors, ids
        centers, radii, spans = [], [], []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            start, end, parent, side = waiting.pop()
            node = len(spans)
            rows = vectors[self.order[start:end]].astype(np.float64)
            center = rows.mean(axis=0)
            far = np.sqrt(((rows - center) ** 2).sum(axis=1))
            centers.append(center)
            radii.append(far.max())
            spans.append([start, end, -1, -1])
            if parent >= 0:
                spans[parent][2 + side] = node
            if end - start > LEAF and far.max() > 0:
                a = rows[far.argmax()]
                b = rows[((rows - a) ** 2).sum(axis=1).argmax()]
                along = np.argsort(rows @ (b - a), kind="stable")
                self.order[start:end] = self.order[start:end][along]
                middle = (start + end) // 2
                waiting += [(middle, end, node, 1), (start, middle, node, 0)]
            else:  # within a leaf by id
                self.order[start:end] = self.order[start:end][np.argsort(ids[self.order[start:end]], kind="stable")]
        self.centers, self.radii, self.spans = np.array(centers), np.array(radii), np.array(spans, np.int64)


def bounds(queries: np.ndarray, center: np.ndarray, radius: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with a row of the ball(s), with room for rounding."""
    middle = queries @ center
    length = np.sqrt((queries**2).sum(axis=1)) if middle.ndim == 1 else np.sqrt((queries**2).sum(axis=1))[:, None]
    reach = length * radius
    room = 1e-9 * (np.abs(middle) + reach + length * np.sqrt((center**2).sum(axis=0))) + 1e-6
    return middle - reach - room, middle + reach + room


class Asks:
    """What some anchors want: rows of the same label, or of others within a window of the positive's score."""

    def __init__(self, t: pa.Table, low: int, high: int):
        self.anchor, self.turn = t["anchor"].to_numpy(), t["turn"].to_numpy()
        self.label = np.array(t["label"].to_pylist(), object)
        self.same = t["same"].to_numpy(zero_copy_only=False).astype(bool)
        self.v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1).astype(np.int64)
        self.float = self.v.astype(np.float64)
        self.windowed = ~self.same
        # whole scores of the window; none lies beyond 2**62
        positive = [p or 0 for p in t["positive"].to_pylist()]
        self.least = np.array([max(NONE, -(-low * p // 100)) for p in positive], np.int64)
        self.most = np.array([min(-NONE, high * p // 100) for p in positive], np.int64)
        self.kth = np.array([NONE if k is None else k for k in t["kth"].to_pylist()], np.int64)

    def possible(self, least: np.ndarray, most: np.ndarray, only: object, kth: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the asks ``at`` a ball with these bounds can serve; ``only``: the label of all its rows, or None."""
        fits = most >= kth
        window = self.windowed[at]
        fits &= ~window | ((most >= self.least[at]) & (least <= self.most[at]))
        if only is not None:
            fits &= (self.label[at] == only) == self.same[at]
        return fits

    def wanted(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> np.ndarray:
        fits = (labels[None, :] == self.label[at][:, None]) == self.same[at][:, None]
        fits &= ids[None, :] != self.anchor[at][:, None]
        inside = (self.least[at][:, None] <= score) & (score <= self.most[at][:, None])
        return fits & (self.same[at][:, None] | inside)


def search(tree: dict, asks: Asks, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and scores of the k best wanted rows of one tree for each ask, best first; NONE where there are fewer."""
    n, spans = len(asks.anchor), tree["spans"]
    leaves = np.flatnonzero(spans[:, 2] < 0)
    column = {int(leaf): c for c, leaf in enumerate(leaves)}
    reach = np.full((n, len(leaves)), -np.inf)
    live = {0: np.arange(n)}
    for node, (start, end, left, right) in enumerate(spans.tolist()):
        at = live.pop(node, None)
        if at is None or not len(at):
            continue
        least, most = bounds(asks.float[at], tree["centers"][node], tree["radii"][node])
        labels = tree["labels"][start:end]
        only = labels[0] if (labels == labels[0]).all() else None
        fits = asks.possible(least, most, only, asks.kth[at], at)
        if left < 0:
            reach[at[fits], column[node]] = most[fits]
        else:
            live[left] = live[right] = at[fits]
    best = np.full((n, k), NONE, np.int64)
    best_ids = np.zeros((n, k), np.int64)
    turns = np.argsort(-reach, axis=1, kind="stable")
    at = np.arange(n)
    for step in range(len(leaves)):
        leaf = turns[at, step]
        most = reach[at, leaf]
        goes_on = (most > -np.inf) & (most >= np.maximum(best[at, -1], asks.kth[at]))
        at, leaf = at[goes_on], leaf[goes_on]
        if not len(at):
            break
        for one in np.unique(leaf):
            here = at[leaf == one]
            start, end = spans[leaves[one], :2]
            ids, labels = tree["ids"][start:end], tree["labels"][start:end]
            score = scores(asks.v[here], tree["vectors"][start:end])
            score = np.where(asks.wanted(here, ids, labels, score), score, NONE)
            score = np.concatenate([best[here], score], axis=1)
            names = np.concatenate([best_ids[here], np.broadcast_to(ids, (len(here), len(ids)))], axis=1)
            first = np.lexsort((names, -score))[:, :k]
            best[here], best_ids[here] = np.take_along_axis(score, first, 1), np.take_along_axis(names, first, 1)
    return best_ids, best


def _signed(rows: DataFrame) -> DataFrame:
    """Rows with ``place``: the signs of their projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = np.zeros(b.num_rows, np.int64)
            sizes = b["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                v = b["v"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                place[at] = (v @ np.random.default_rng(11).standard_normal((size, PROJECTIONS)) > 0) @ (1 << np.arange(PROJECTIONS))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], [*b.schema.names, "place"])

    return rows.mapInArrow(run, "id bigint, label string, v array<bigint>, size int, asks boolean, place bigint")


def _trees(rows: DataFrame, total: int) -> DataFrame:
    """A row for each tree: of a range of rows, a tree for each length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        sizes = t["size"].to_numpy()
        for i, size in enumerate(np.unique(sizes).tolist()):
            some = t.filter(pa.array(sizes == size))
            vectors = some["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
            ids = some["id"].to_numpy()
            tree = Tree(vectors, ids)
            labels = np.array(some["label"].to_pylist(), object)[tree.order]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "shard": TaskContext.get().partitionId() * 2**24 + i,
                        "size": size,
                        "center": tree.centers[0].tobytes(),
                        "radius": float(tree.radii[0]),
                        "only": labels[0] if (labels == labels[0]).all() else None,
                        "ids": ids[tree.order].tobytes(),
                        "labels": labels.tolist(),
                        "vectors": vectors[tree.order].astype(np.int64).tobytes(),
                        "centers": tree.centers.tobytes(),
                        "radii": tree.radii.tobytes(),
                        "spans": tree.spans.tobytes(),
                    }
                ],
                pa.schema([("shard", pa.int64()), ("size", pa.int32()), ("center", pa.binary()), ("radius", pa.float64()), ("only", pa.string()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), *[(c, pa.binary()) for c in ("vectors", "centers", "radii", "spans")]]),
            )

    ranged = rows.drop("asks").repartitionByRange(max(1, -(-total // SHARD)), "size", "label", "place", "id")
    return ranged.select("id", "label", "v", "size").mapInArrow(run, TREE)


def _routed(asks: DataFrame, trees: DataFrame, blocks: int, groups: int, first: bool, low: int, high: int) -> DataFrame:
    """Asks with a shard that may serve them: of each block of shards the one with the best bound, or all others."""

    def run(some: pa.Table, tops: pa.Table) -> pa.Table:
        empty = some.slice(0, 0).select(kept).append_column("shard", pa.array([], pa.int64()))
        if not len(some) or not len(tops):
            return empty
        a = Asks(some, low, high)
        size = some["size"][0].as_py()
        centers = np.frombuffer(b"".join(tops["center"].to_pylist()), np.float64).reshape(len(tops), size)
        least, most = bounds(a.float, centers.T, tops["radius"].to_numpy())
        every = np.arange(len(some))
        fits = np.stack([a.possible(least[:, s], most[:, s], only, a.kth, every) for s, only in enumerate(tops["only"].to_pylist())], axis=1)
        # the best by what holds before any score is known, so that both rounds name the same one
        open_ = np.stack([a.possible(least[:, s], most[:, s], only, np.full(len(some), NONE), every) for s, only in enumerate(tops["only"].to_pylist())], axis=1)
        lead = np.where(open_, most, -np.inf).argmax(axis=1)
        leads = np.zeros_like(fits)
        leads[every, lead] = True
        i, s = np.nonzero(fits & (leads if first else ~leads))
        return some.select(kept).take(pa.array(i)).append_column("shard", tops["shard"].take(pa.array(s)))

    kept = [c.split()[0] for c in ASK.split(", ")]
    # blocks of shards and of asks by number; both keep the same order of shards in both rounds
    tops = trees.select("shard", "size", "center", "radius", "only").withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = asks.withColumn("block", F.pmod(F.xxhash64("anchor", "turn"), F.lit(blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["size", "group", "block"]

    def ordered(some: pa.Table, tops: pa.Table) -> pa.Table:
        return run(some, tops.sort_by("shard"))

    return sent.groupBy(*keys).cogroup(tops.groupBy(*keys)).applyInArrow(ordered, f"{ASK}, shard bigint")


def _served(routed: DataFrame, trees: DataFrame, blocks: int, k: int, low: int, high: int) -> DataFrame:
    """The k best of each ask and shard."""

    def run(some: pa.Table, held: pa.Table) -> pa.Table:
        out = {"anchor": [], "turn": [], "id": [], "score": []}
        for row in held.to_pylist() if len(some) else []:
            asks = Asks(some, low, high)
            tree = {"ids": np.frombuffer(row["ids"], np.int64), "labels": np.array(row["labels"], object), "radii": np.frombuffer(row["radii"]), "spans": np.frombuffer(row["spans"], np.int64).reshape(-1, 4)}
            tree["vectors"] = np.frombuffer(row["vectors"], np.int64).reshape(len(tree["ids"]), row["size"])
            tree["centers"] = np.frombuffer(row["centers"]).reshape(len(tree["radii"]), row["size"])
            ids, score = search(tree, asks, k)
            i, j = np.nonzero(score > NONE)
            for c, x in zip(out, (asks.anchor[i], asks.turn[i], ids[i, j], score[i, j]), strict=True):
                out[c].append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int32() if c == "turn" else pa.int64()) for c, x in out.items()})

    routed = routed.withColumn("block", F.pmod(F.xxhash64("anchor", "turn"), F.lit(blocks)).cast("int"))
    pairs = routed.select("shard", "block").distinct()
    held = trees.join(small(written(pairs, "pairs")), "shard")
    return routed.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(run, FOUND)


def best(asks: DataFrame, trees: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """``anchor``, ``turn``, ``rank``, ``id``, ``score``: the k best rows of every ask, over all shards."""
    blocks, groups = max(1, -(-asks.count() // BLOCK)), max(1, -(-trees.count() // ROUTED))
    place = F.row_number().over(Window.partitionBy("anchor", "turn").orderBy(F.desc("score"), "id"))
    first = written(_served(_routed(asks, trees, blocks, groups, True, low, high), trees, blocks, k, low, high), "first")
    ranked = first.withColumn("rank", place)
    kth = ranked.where(F.col("rank") == k).select("anchor", "turn", F.col("score").alias("kth"))
    told = written(asks.drop("kth").join(kth, ["anchor", "turn"], "left").select(asks.columns), "told")
    rest = _served(written(_routed(told, trees, blocks, groups, False, low, high), "rest"), trees, blocks, k, low, high)
    return first.unionByName(rest).withColumn("rank", place).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A component x counts as ``floor(scale * x)``.  An anchor's positives are its
    ``positives`` best rows of the same label; each gives the ``negatives`` best rows
    of other labels with a score of ``low`` to ``high`` percent of its own.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & finite)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"), F.max("asks").alias("asks")).select("id", "r.label", "r.v", F.size("r.v").alias("size"), "asks")
    rows = written(_signed(rows), "rows")
    trees = written(_trees(rows, rows.count()), "trees")
    null = F.lit(None).cast("long")
    asks = written(rows.where("asks").select(F.col("id").alias("anchor"), F.lit(0).alias("turn"), "label", F.lit(True).alias("same"), null.alias("positive"), "size", "v", null.alias("kth")), "asks")
    chosen = written(best(asks, trees, positives, low, high), "positives")
    pairs = chosen.select("anchor", F.col("rank").alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive"))
    windows = pairs.where((high - low) * F.signum("positive") >= 0).join(asks.select("anchor", "label", "size", "v"), "anchor")
    windows = written(windows.select("anchor", "turn", "label", F.lit(False).alias("same"), "positive", "size", "v", null.alias("kth")), "windows")
    found = best(windows, trees, negatives, low, high).join(pairs, ["anchor", "turn"])
    return found.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), F.col("positive").alias("positive_score"), F.col("score").alias("negative_score"))
