"""A positional index of three-letter runs: substring search over several corpora from posting lists.

Records lie one after another in segments, with fillers behind each title and
body so that every letter begins a gram and no gram crosses a border.  A segment
has a row for each of its grams with all its places, by which an exact answer
needs no text: where the grams that cover a query follow each other, the query
stands.  Rows lie in shards by the gram's first two letters, sorted by gram: a
query reads the shards of its grams, and in these the pages that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.functions.text import fold
from wayfarer.sources.scratch import written

SHARDS, SIZE = 16, 3
#: Letters of ``split`` segments (one longer record has its own), queries that are answered together, and grams that are named in the scan's filter at most.
LETTERS, TOGETHER, NAMED = 1 << 22, 1_000, 2_000
#: One above the last code point: no query holds it.
FILLER = 0x110000


def _shard(pair: Column) -> Column:
    return F.pmod(F.xxhash64(pair), F.lit(SHARDS)).cast("int")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _grams(code: np.ndarray) -> np.ndarray:
    """Three letters each as one number: the first two are its upper 42 bits."""
    code = code.astype(np.int64)
    return (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]


@dataclass(frozen=True)
class GramIndex:
    """Folder of an index: by shard, the lists of the segments' grams, and in shard -1 the records of each segment."""

    folder: str

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/postings")


def write_index(records: DataFrame, corpus: str, key: str, title: str, body: str, folder: str, split: int = 4) -> GramIndex:
    """Index the folded title and body of every record.  ``split``: segments for each ``LETTERS`` letters."""
    text = lambda c: F.coalesce(fold(F.col(c)), F.lit(""))
    held = records.select(F.coalesce(F.col(corpus).cast("string"), F.lit("")).alias("corpus"), F.col(key).alias("id"), text(title).alias("title"), text(body).alias("body"))
    between = np.full(SIZE - 1, FILLER, np.uint32)

    def lists(segment: int, corpora: list[pa.Array], ids: list[pa.Array], fields: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = ["segment", "gram", "places", "corpora", "ids", "starts"]
        starts = np.cumsum([0, *[len(f) + SIZE - 1 for f in fields[:-1]]]).astype(np.int32)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        held = [one(pa.concat_arrays(corpora)), one(pa.concat_arrays(ids)), one(pa.array(starts))]
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), *held], names)
        grams = _grams(np.concatenate([x for f in fields for x in (f, between)]))
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        first = np.flatnonzero(np.diff(grams, prepend=-1))
        steps = np.diff(order, prepend=0)
        steps[first] = order[first]
        # each place as the step from the one before it
        ends = np.append(first, len(order)).astype(np.int32) * 4
        places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(steps.astype("<u4"))])
        known = first < np.searchsorted(grams, FILLER << 42)
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(first), segment)), pa.array(grams[first]), places, *[pa.nulls(len(first), h.type) for h in held]], names)
        yield rows.slice(0, int(known.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        corpora, ids, fields, letters = [], [], [], 0
        for b in batches:
            done = 0
            for r, (t, x) in enumerate(zip(b["title"].to_pylist(), b["body"].to_pylist(), strict=True)):
                if fields and letters + len(t) + len(x) > LETTERS // split:
                    corpora.append(b["corpus"][done:r])
                    ids.append(b["id"][done:r])
                    yield from lists(segment, corpora, ids, fields)
                    corpora, ids, fields, letters, done, segment = [], [], [], 0, r, segment + 1
                fields += [_codes(t), _codes(x)]
                letters += len(t) + len(x)
            corpora.append(b["corpus"][done:])
            ids.append(b["id"][done:])
        if fields:
            yield from lists(segment, corpora, ids, fields)

    kind = records.schema[key].dataType.simpleString()
    rows = held.mapInArrow(run, f"segment long, gram long, places binary, corpora array<string>, ids array<{kind}>, starts array<int>")
    shard = F.when(F.col("gram").isNull(), -1).otherwise(_shard(F.shiftright("gram", 21)))
    rows.withColumn("shard", shard).sortWithinPartitions("shard", "gram").write.option("compression", "zstd").partitionBy("shard").parquet(f"{folder}/postings")
    return GramIndex(folder)


def _asked(queries: DataFrame, q: str, least: int) -> DataFrame:
    """``folded`` queries of ``least`` letters on, the ``q`` that fold to each, and ``grams`` (of two letters: ``pair``)."""
    rows = queries.select(F.col(q).alias("q"), fold(F.trim(q)).alias("folded")).where(F.length(F.trim("q")) >= F.lit(max(2, least))).where(F.length("folded") >= 2)
    rows = rows.groupBy("folded").agg(F.collect_set("q").alias("qs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [_codes(x) for x in b["folded"].to_pylist()]
            # without an overlap but for the last one
            offsets = [sorted({*range(0, len(c) - SIZE + 1, SIZE), len(c) - SIZE}) if len(c) >= SIZE else [] for c in codes]
            grams = [_grams(c)[o].tolist() if o else [] for c, o in zip(codes, offsets, strict=True)]
            pairs = [(int(c[0]) << 21) | int(c[1]) if len(c) < SIZE else None for c in codes]
            yield pa.RecordBatch.from_arrays([b["folded"], b["qs"], pa.array(grams, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int32())), pa.array(pairs, pa.int64())], ["folded", "qs", "grams", "offsets", "pair"])

    return rows.mapInArrow(run, "folded string, qs array<string>, grams array<long>, offsets array<int>, pair long")


def lookup(spark: SparkSession, index: GramIndex, queries: DataFrame, q: str, least: int = 2) -> DataFrame:
    """``q``, ``corpus``, ``id``, ``weight`` (0: in the title, 1: in the body only) and ``at`` (place in the body from 1, or 0) of every hit.

    Queries are trimmed and folded; those below ``least`` letters have no hits.
    The lists of a segment meet some queries in one task: of a longer query the
    places at which all grams that cover it agree, from the rarest; of two
    letters, whatever begins with them.
    """
    asked = written(_asked(queries, q, least))
    chunk = F.pmod(F.xxhash64("folded"), F.lit(max(1, -(-asked.count() // TOGETHER)))).cast("int").alias("chunk")
    chunks = asked.groupBy(chunk).agg(F.collect_list(F.struct("qs", "grams", "offsets", "pair")).alias("asked"))
    longer = asked.select(chunk, F.explode("grams").alias("gram")).groupBy("gram").agg(F.collect_set("chunk").alias("_a"))
    two = asked.where("pair IS NOT NULL").groupBy("pair").agg(F.collect_set(chunk).alias("_b"))
    table = index.table(spark)
    lists = table.where("gram IS NOT NULL").select("segment", "gram", "places", "shard").withColumn("pair", F.shiftright("gram", 21))
    # where they are few, shards and grams reach the scan
    names = [[r[0] for r in x.limit(NAMED + 1).collect()] for x in (longer.select("gram"), two.select("pair"))]
    if sum(map(len, names)) <= NAMED:
        pairs = {g >> 21 for g in names[0]} | set(names[1])
        shards = [r[0] for r in spark.createDataFrame([(p,) for p in pairs], "pair long").select(_shard(F.col("pair"))).distinct().collect()] if pairs else []
        hit = F.col("gram").isin(names[0])
        for p in names[1]:
            hit = hit | F.col("gram").between(p << 21, (p << 21) + FILLER)
        lists = lists.where(F.col("shard").isin(shards) & hit)
    none = F.array().cast("array<int>")
    lists = lists.join(longer, "gram", "left").join(two, "pair", "left").select("segment", F.explode(F.array_distinct(F.concat(F.coalesce("_a", none), F.coalesce("_b", none)))).alias("chunk"), "gram", "places")
    held = table.where("shard = -1").select("segment", "corpora", "ids", "starts").crossJoin(chunks)
    kind = table.schema["ids"].dataType.elementType.simpleString()
    names = ["q", "corpus", "id", "weight", "at"]

    def answer(group: pa.Table) -> pa.Table:
        own = group.filter(pc.is_null(group["gram"]))
        value = lambda c: own[c].combine_chunks().flatten()
        corpora, ids, starts, queries = value("corpora"), value("ids"), value("starts").to_numpy(), own["asked"][0].as_py()
        rows = group.filter(pc.is_valid(group["gram"]))
        grams, packed = rows["gram"].to_numpy(), rows["places"].to_pylist()
        where = {g: i for i, g in enumerate(grams.tolist())}
        pairs: dict[int, list[int]] = {}
        for i, g in enumerate(grams.tolist()):
            pairs.setdefault(g >> 21, []).append(i)
        made: dict[int, np.ndarray] = {}

        def places(i: int) -> np.ndarray:
            if i not in made:
                made[i] = np.cumsum(np.frombuffer(packed[i], "<u4"), dtype=np.int64)
            return made[i]

        letters: list[str] = []
        found: list[tuple[np.ndarray, ...]] = []
        for one in queries:
            if one["pair"] is not None:
                met = np.sort(np.concatenate([places(i) for i in pairs[one["pair"]]])) if one["pair"] in pairs else ()
            elif all(g in where for g in one["grams"]):
                each = sorted(((where[g], o) for g, o in zip(one["grams"], one["offsets"], strict=True)), key=lambda x: len(packed[x[0]]))
                met = places(each[0][0]) - each[0][1]
                for i, o in each[1:]:
                    others = places(i)
                    near = np.searchsorted(others, met + o)
                    met = met[others[np.minimum(near, len(others) - 1)] == met + o]
            else:
                continue
            if not len(met):
                continue
            # the first place of each field, titles and bodies in turn
            field = np.searchsorted(starts, met, side="right") - 1
            first = np.flatnonzero(np.diff(field, prepend=-1))
            field, at = field[first], met[first] - starts[field[first]] + 1
            record, is_body = field >> 1, field & 1 == 1
            again = np.flatnonzero(np.diff(record, prepend=-1) == 0)
            weight, at = is_body.astype(np.int32), np.where(is_body, at, 0)
            at[again - 1] = at[again]
            keep = np.ones(len(record), bool)
            keep[again] = False
            for q in one["qs"]:
                found.append((np.full(int(keep.sum()), len(letters)), record[keep], weight[keep], at[keep]))
                letters.append(q)
        n, record, weight, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
        take = lambda values, i: values.take(pa.array(i, pa.int64()))
        return pa.table([take(pa.array(letters, pa.string()), n), take(corpora, record), take(ids, record), pa.array(weight, pa.int32()), pa.array(at, pa.int32())], names)

    nothing = lambda df, like: df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like])
    both = {f.name: f for df in (lists, held) for f in df.schema}.values()
    return nothing(lists, both).unionByName(nothing(held, both)).groupBy("segment", "chunk").applyInArrow(answer, f"q string, corpus string, id {kind}, weight int, at int")


def grouped_hits(hits: DataFrame, caps: dict[str, int], cap: int) -> DataFrame:
    """Of each query and corpus the first hits (title before body, then by id), with ``place``, the ``total`` of the corpus and of the query."""
    hits = written(hits)
    allowed = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in caps.items() for v in pair]), F.col("corpus")), F.lit(cap)) if caps else F.lit(cap)
    totals = hits.groupBy("q", "corpus").agg(F.count("*").alias("total"))
    whole = totals.groupBy("q").agg(F.sum("total").alias("of_query"))
    place = F.row_number().over(Window.partitionBy("q", "corpus").orderBy("weight", "id"))
    most = max([cap, *caps.values()])
    # the constant bound lets each task keep few rows of a group before the shuffle
    first = hits.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= allowed)
    return first.join(totals, ["q", "corpus"]).join(whole, "q")
