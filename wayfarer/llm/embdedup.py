"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is turned by ``turns`` random rotations and keeps only the signs:
its code.  With each turn it stores the inner product of the scaled signs and the
turned vector, the correction factor.  Signs of one vector times the turned other
one, divided by the factor, estimate the inner product of both without bias, and the
error shrinks with the root of the dimension and with the sine of their angle.  So
the bound of the error that a pair at the threshold can have tells which estimates
are too low; all other pairs are computed exactly, and only these decide.

Pairs are estimated where they meet: pieces of the code are bands, and vectors of a
label that agree in a band share a bucket.  Bits of a band grow with the logarithm of
the largest label, and bands until a pair at the threshold is missed with
probability ``MISS`` at most.  A pair counts in the first band in which it agrees.
Buckets above ``TILE`` rows are cut in blocks, and pairs of blocks are tasks of their own.
A tile gives one row per linked vector, its links there and the smallest
vector of its component there: never a row for a pair.

Equal vectors of a label are one row with a count before all this.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or id, link with nothing and have
themselves as component (a null id: null, and kept); only vectors of equal length and label are
compared; rows that share an id are vectors of their own and count as each other's links, where
they link; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm._shared import small, written
from wayfarer.llm.components import components

#: Chance that a pair at the threshold meets in no band, and deviations that a pair's estimate may lie too low.
MISS, DEVIATIONS = 1e-4, 5.0
#: Rows of a bucket (about, if directions are even), of a block of a large bucket, and of a task's share.
BUCKET, TILE, SHARE = 512, 1024, 8192
LEAST_BITS = 8
#: Pairs that are computed exactly at a time.
AT_ONCE = 32_768


@lru_cache(maxsize=8)
def _rotation(size: int, bits: int) -> np.ndarray:
    """Random rotations side by side, ``bits`` columns at least."""
    rng = np.random.default_rng(13)
    return np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-bits // size))], axis=1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def encode(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the turned unit vectors, and the correction factor of each turn."""
    size = vectors.shape[1]
    turned = _unit(vectors) @ _rotation(size, bits)
    return turned > 0, np.abs(turned).reshape(len(vectors), -1, size).sum(axis=2) / math.sqrt(size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # first by the largest component: squares of very large or small ones leave the range
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def estimates(signs: np.ndarray, factors: np.ndarray, others: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of coded vectors with ``others`` (unit vectors), and the lowest estimate of each coded one that may be ``least`` in truth."""
    turns, size = factors.shape[1], others.shape[1]
    scaled = np.where(signs, 1.0, -1.0) / np.repeat(factors, size, axis=1) / (math.sqrt(size) * turns)
    turned = others @ _rotation(size, signs.shape[1])
    spread = np.sqrt(np.maximum(0, (1 - factors**2) / factors**2).sum(axis=1)) / turns / math.sqrt(max(1, size - 1))
    return scaled.astype(np.float32) @ turned.T.astype(np.float32), least - math.sqrt(1 - least**2) * DEVIATIONS * spread - 1e-5


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of n, given edges."""
    label = np.arange(n)
    while True:
        now = label.copy()
        np.minimum.at(now, a, label[b])
        np.minimum.at(now, b, label[a])
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _tile(x: dict[str, np.ndarray], band: int, one_block: bool, bits: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (counted with copies) and component of each row of a tile, of pairs that agree in no earlier band."""
    n = len(x["v"])
    size = x["v"].shape[1]
    unit = _unit(x["v"])
    signs = np.unpackbits(x["code"], axis=1, count=-(-bits // size) * size).astype(bool)
    left = np.arange(n) if one_block else np.flatnonzero(x["first"])
    right = left if one_block else np.flatnonzero(~x["first"])
    guess, floor = estimates(signs[left], x["factors"][left], unit[right], least)
    i, j = np.nonzero(guess >= floor[:, None])
    if one_block:
        i, j = i[i < j], j[i < j]
    i, j = left[i], right[j]
    linked = [(i[:0], j[:0])]
    for s in range(0, len(i), AT_ONCE):
        a, b = i[s : s + AT_ONCE], j[s : s + AT_ONCE]
        fresh = ~(x["keys"][a, :band] == x["keys"][b, :band]).any(axis=1)
        a, b = a[fresh], b[fresh]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= least
        linked.append((a[near], b[near]))
    a, b = (np.concatenate(c) for c in zip(*linked, strict=True))
    links = np.bincount(a, x["n"][b], n) + np.bincount(b, x["n"][a], n)
    return links.astype(np.int64), _joined(n, a, b)


def dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` (it is the smallest of its component) for every row."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v"))
    numbers = F.transform("v", lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(numbers, lambda x: x != 0)
    takes_part = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    alone = rows.where(~takes_part).select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = rows.where(takes_part)
    apart = written(rows.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("id").alias("least_id")), "apart")
    apart = written(apart.withColumn("row", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "numbered")

    most = apart.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 1
    width = max(LEAST_BITS, math.ceil(math.log2(max(1, most / BUCKET))))
    agree = (1 - math.acos(least) / math.pi) ** width
    bands = math.ceil(math.log(MISS) / math.log1p(-agree))
    bits = width * bands

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sizes = t["size"].to_numpy()
            for size in np.unique(sizes).tolist():
                some = t.filter(pa.array(sizes == size))
                signs, factors = encode(_matrix(some["v"]).astype(np.float64), bits)
                keys = signs[:, :bits].reshape(-1, bands, width) @ (1 << np.arange(width, dtype=np.int64))
                packed = np.packbits(signs, axis=1)
                extra = {"code": pa.array([r.tobytes() for r in packed], pa.binary()), "factors": pa.array(list(factors.astype(np.float32))), "keys": pa.array(list(keys), pa.list_(pa.int64()))}
                yield from pa.table({c: some[c] for c in some.column_names} | extra).to_batches()

    numeric = apart.schema["v"].dataType.simpleString()
    coded = written(apart.select("row", "label", "size", "n", "v").mapInArrow(code, f"row bigint, label string, size int, n bigint, v {numeric}, code binary, factors array<float>, keys array<bigint>"), "coded")
    bucket = ["label", "size", "band", "bucket"]
    light = coded.select("label", "size", F.posexplode("keys").alias("band", "bucket"))
    large = small(written(light.groupBy(bucket).agg(F.count("*").alias("held")).where(F.col("held") > TILE), "large"))
    met = coded.select("*", F.posexplode("keys").alias("band", "bucket")).join(large, bucket, "left")
    blocks = F.ceil(F.coalesce("held", F.lit(1)) / TILE).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("row"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other", "held")
    tile = [*bucket, "low", "high"]
    shares = max(1, -(-coded.count() * bands // SHARE))

    def link(held: pa.Table) -> pa.Table:
        out = {"row": [], "links": [], "to": []}
        labels = np.asarray(held["label"].combine_chunks().dictionary_encode().indices)
        parts = [labels, *[held[c].to_numpy() for c in tile[1:]]]
        order = np.lexsort(parts[::-1])
        starts = np.flatnonzero(np.any([np.diff(p[order], prepend=p[order][0] - 1) != 0 for p in parts], axis=0)) if len(order) else []
        for start, end in zip(starts, [*starts[1:], len(order)], strict=True):
            if end - start < 2:
                continue
            some = held.take(pa.array(order[start:end]))
            low, high = some["low"][0].as_py(), some["high"][0].as_py()
            x = {"v": _matrix(some["v"]).astype(np.float64), "n": some["n"].to_numpy(), "keys": _matrix(some["keys"]), "first": some["own"].to_numpy() == low}
            x["code"] = np.frombuffer(b"".join(some["code"].to_pylist()), np.uint8).reshape(end - start, -1)
            x["factors"] = _matrix(some["factors"]).astype(np.float64)
            links, component = _tile(x, some["band"][0].as_py(), low == high, bits, least)
            ids, hit = some["row"].to_numpy(), links > 0
            for c, values in zip(out, (ids[hit], links[hit], ids[component[hit]]), strict=True):
                out[c].append(values)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in out.items()})

    found = met.withColumn("share", F.pmod(F.xxhash64(*tile), F.lit(shares))).groupBy("share").applyInArrow(link, "row bigint, links bigint, to bigint")
    found = written(found, "found")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    # a tile's component stands for its links; rows that are linked to a row of another tile meet there
    joined = components(found.select(F.col("row").alias("a"), F.col("to").alias("b")).where("a <> b").distinct())
    named = apart.select("row", "label", "v", "n", "least_id").join(links, "row", "left").join(joined.withColumnRenamed("node", "row"), "row", "left")
    named = written(named.withColumn("component", F.coalesce("component", "row")), "named")
    smallest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(smallest, "component").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = rows.join(named, ["label", "v"]).select(F.col("id").alias(key), "n_links", "component_id")
    return done.unionByName(alone).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))

