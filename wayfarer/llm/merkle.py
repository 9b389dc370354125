"""Merkle manifest of a table: a tree for each group of rows, a tree over the groups, and a proof for every row.

Leaves are numbered within their group by a range-partitioned sort.  Inner nodes
are made by events: a digest that arrives is laid into its parent, which is
partial until it has as many children as the group's size gives it (``fan``, or
fewer in the last run of a level); the parent's own digest is then the next
event.  Each task combines what it holds; the children of parents that stayed
partial are its frontier.  Frontiers, a few nodes for each level and task, are
dealt again by an ancestor some levels higher and combined there, until only roots are
left.  Every step leaves reverse links from its nodes to where they ended, with
the siblings on the way; read from the root down, these give each frontier node its
path, and each part of leaves, combined once more, its proofs.  No proof is
shuffled, and no task holds more than a part of leaves or a frontier's share.

Edge cases: a null field counts as ``-``; a null group is a group of its own and
the first; rows of a group ascend by their order column, nulls first, and rows that
share it by digest, so repeated rows are leaves of their own; a lone leaf is its
group's root, and a lone group's root is the root; an empty table gives no rows;
other columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfarer.llm._shared import small, written

#: Leaves of a part (about), and nodes of a task when frontiers meet.
PART, SHARE = 20_000, 10_000
#: Children of one ancestor that meet in a round, about.
REACH = 256

NODE = "tree string, level int, place bigint, size bigint, digest string"
STEP = "array<struct<at:int,others:array<string>>>"
LINK = f"tree string, level int, place bigint, size bigint, path {STEP}, up_level int, up_place bigint, up_digest string"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of the fields in turn: ``-`` for null, else bytes, colon and value."""
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""

    def up(now: Column, step: Column) -> Column:
        at, others = step["at"], step["others"]
        left, right = F.slice(others, F.lit(1), at), F.slice(others, at + 1, F.size(others) - at)
        return digest(F.concat(F.concat_ws("", left), now, F.concat_ws("", right)))

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up, left to right."""
    return digest(F.concat_ws("", F.flatten(F.transform(proof, lambda s: s["others"]))))


class Combiner:
    """Partial parents by place.  ``links`` keeps, if asked for, each child's place among its siblings."""

    def __init__(self, fan: int, keep: bool):
        self.fan, self.partial, self.roots = fan, {}, []
        self.links: dict[tuple, tuple[int, list[str]]] | None = {} if keep else None

    def add(self, tree: str, level: int, place: int, size: int, value: str) -> None:
        """A node is known: lay it into its parent, and go on with the parent if that is whole."""
        fan = self.fan
        while True:
            across = -(-size // fan**level)
            if across == 1:
                self.roots.append((tree, level, place, size, value))
                return
            parent, at = divmod(place, fan)
            arity = min(fan, across - parent * fan)
            _, have = self.partial.setdefault((tree, level, parent), (size, {}))
            have[at] = value
            if len(have) < arity:
                return
            del self.partial[tree, level, parent]
            run = [have[i] for i in range(arity)]
            if self.links is not None:
                for i in range(arity):
                    self.links[tree, level, parent * fan + i] = i, run[:i] + run[i + 1 :]
            level, place, value = level + 1, parent, hashlib.sha256("".join(run).encode()).hexdigest()

    def frontier(self) -> Iterator[tuple]:
        """The roots, and the children that still wait for siblings."""
        yield from self.roots
        for (tree, level, parent), (size, have) in self.partial.items():
            for at, value in have.items():
                yield tree, level, parent * self.fan + at, size, value

    def climb(self, tree: str, level: int, place: int) -> Iterator[tuple]:
        """The nodes from one up to its place in the frontier, that one included."""
        yield tree, level, place
        while (tree, level, place) in self.links:
            level, place = level + 1, place // self.fan
            yield tree, level, place


def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})


_NAMES, _TYPES = ["tree", "level", "place", "size", "digest"], [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
_STEP = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))


def _numbered(leaves: DataFrame, order: str) -> DataFrame:
    """``leaves`` with ``part``, ``place`` (from 0, within the tree) and ``size`` (of the tree), as a written table."""
    total = leaves.count()
    parts = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    keys = [F.col("tree"), F.col(order).asc_nulls_first(), F.col("leaf")]
    ranged = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("part", F.shiftright("_row", 33)).withColumn("_at", F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_row"), "leaves")
    counts = written(ranged.groupBy("tree", "part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), "counts")
    # a row for each part that holds some of a tree
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select("tree", "part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size")), "shifts")
    return ranged.join(small(counts), ["tree", "part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_shift")


def _first_frontier(leaves: DataFrame, fan: int) -> DataFrame:
    """The frontiers of the parts of leaves, each with its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, combiner = None, Combiner(fan, False)

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(*r, part) for r in combiner.frontier()]
            yield from _columns(rows, [*_NAMES, "part"], [*_TYPES, pa.int64()]).to_batches()

        for b in batches:
            columns = [b[c].to_pylist() for c in ("part", "tree", "place", "size", "leaf")]
            for now, tree, place, size, leaf in zip(*columns, strict=True):
                if now != part:
                    yield from flush()
                    part, combiner = now, Combiner(fan, False)
                combiner.add(tree, 0, place, size, leaf)
        yield from flush()

    return leaves.select("part", "tree", "place", "size", "leaf").mapInArrow(run, NODE + ", part bigint")


def _met(nodes: DataFrame, level: int, fan: int) -> DataFrame:
    """One round: nodes below the same ancestor of ``level`` meet; where each of them ended, and the siblings on its way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[b[c].to_pylist() for c in _NAMES], strict=True)]
        combiner = Combiner(fan, True)
        for r in rows:
            combiner.add(*r)
        ends = {r[:3]: r[4] for r in combiner.frontier()}
        out = []
        for tree, at, place, size, _ in rows:
            way = list(combiner.climb(tree, at, place))
            path = [dict(zip(("at", "others"), combiner.links[k], strict=True)) for k in way[:-1]]
            out.append((tree, at, place, size, path, *way[-1][1:], ends[way[-1]]))
        names = ["tree", "level", "place", "size", "path", "up_level", "up_place", "up_digest"]
        yield from _columns(out, names, [*_TYPES[:4], _STEP, pa.int32(), pa.int64(), pa.string()]).to_batches()

    above = F.greatest(F.lit(level) - F.col("level"), F.lit(0))
    ancestor = F.floor(F.col("place") / F.pow(F.lit(float(fan)), above))
    return nodes.repartition(max(1, -(-nodes.count() // SHARE)), "tree", ancestor).mapInArrow(run, LINK)


def _forest(leaves: DataFrame, order: str, fan: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``leaves`` (``tree``, ``leaf``, others) with ``proof``, ``subroot`` and ``root``.

    ``crown`` gets the roots (``tree``, ``subroot``) and adds ``root`` and
    ``above``, the path from a subroot to the root.
    """
    leaves = _numbered(leaves, order)
    first = written(_first_frontier(leaves, fan), "frontier")
    depth, largest = 0, first.agg(F.max("size")).first()[0] or 1
    while fan**depth < largest:
        depth += 1
    step = 1
    while fan ** (step + 1) <= REACH:
        step += 1
    rounds, nodes = [], first.drop("part")
    level = max((l for l in range(depth + 1) if fan**l <= PART), default=0)
    while True:
        level = min(depth, level + step)
        links = written(_met(nodes, level, fan), "links")
        rounds.append(links)
        nodes = links.select("tree", F.col("up_level").alias("level"), F.col("up_place").alias("place"), "size", F.col("up_digest").alias("digest")).distinct()
        if level == depth:
            break
        nodes = written(nodes, "nodes")
    crowned = written(crown(nodes.select("tree", F.col("digest").alias("subroot"))), "crown")
    # reverse links, from the roots down
    paths = rounds.pop().drop("up_level", "up_place", "up_digest").join(small(crowned), "tree").withColumn("path", F.concat("path", "above")).drop("above")
    while rounds:
        upper = paths.select("tree", F.col("level").alias("up_level"), F.col("place").alias("up_place"), F.col("path").alias("above"), "subroot", "root")
        paths = rounds.pop().join(upper, ["tree", "up_level", "up_place"]).withColumn("path", F.concat("path", "above")).drop("above", "up_digest", "up_level", "up_place")
    ends = written(first.select("part", "tree", "level", "place").join(paths.drop("size"), ["tree", "level", "place"]), "paths")

    kept = [f for f in leaves.schema if f.name not in ("part", "size")]
    schema = StructType([*kept, *StructType.fromDDL(f"proof {STEP}, subroot string, root string")])

    def prove(held: pa.Table, frontier: pa.Table) -> pa.Table:
        combiner = Combiner(fan, True)
        trees, places = held["tree"].to_pylist(), held["place"].to_pylist()
        for tree, place, size, leaf in zip(trees, places, held["size"].to_pylist(), held["leaf"].to_pylist(), strict=True):
            combiner.add(tree, 0, place, size, leaf)
        steps: list[tuple[int, list[str]]] = []
        number: dict[tuple, int] = {}
        tops: dict[tuple, tuple[list[int], str, str]] = {}
        for tree, level, place, path, subroot, root in zip(*[frontier[c].to_pylist() for c in ("tree", "level", "place", "path", "subroot", "root")], strict=True):
            tops[tree, level, place] = list(range(len(steps), len(steps) + len(path))), subroot, root
            steps += [(s["at"], s["others"]) for s in path]
        for key, link in combiner.links.items():
            number[key] = len(steps)
            steps.append(link)
        flat, ends, subroots, roots = [], [0], [], []
        for tree, place in zip(trees, places, strict=True):
            for key in combiner.climb(tree, 0, place):
                if key in tops:
                    above, subroot, root = tops[key]
                    flat += above
                    subroots.append(subroot)
                    roots.append(root)
                    break
                flat.append(number[key])
            ends.append(len(flat))
        each = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.int32()), pa.array([s[1] for s in steps], pa.list_(pa.string()))], ["at", "others"])
        proofs = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), each.take(pa.array(np.array(flat, np.int64))))
        out = {f.name: held[f.name] for f in kept}
        return pa.table(out | {"proof": proofs, "subroot": pa.array(subroots, pa.string()), "root": pa.array(roots, pa.string())})

    return leaves.groupBy("part").cogroup(ends.groupBy("part")).applyInArrow(prove, schema)


def manifest(leaves: DataFrame, order: str = "doc_id", group: str = "lang", fan: int = 2) -> DataFrame:
    """``leaves`` with ``place``, ``proof``, ``subroot`` (the group's root) and ``root`` for each row.

    ``leaves`` has the digest of each row in ``leaf``; a group's rows ascend by
    ``order`` and groups by ``group``, nulls first.  ``proof`` holds, from the leaf
    up, a node's place among its siblings and their digests: ``fold`` makes the
    root of it.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))

    def crown(subroots: DataFrame) -> DataFrame:
        top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("leaf"))
        top = _forest(written(top, "subroots"), "name", fan, lambda roots: roots.withColumn("root", F.col("subroot")).withColumn("above", F.array().cast(STEP)))
        return top.select(F.col("name").alias("tree"), F.col("leaf").alias("subroot"), "root", F.col("proof").alias("above"))

    rows = written(leaves.select(tree.alias("tree"), F.col(order).alias("key"), "leaf", F.struct("*").alias("row")), "digests")
    made = ["place", "proof", "subroot", "root"]
    return _forest(rows, "key", fan, crown).select(*[F.col("row").getField(c).alias(c) for c in leaves.columns if c not in made], *made)
