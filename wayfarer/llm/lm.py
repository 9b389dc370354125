"""Language-model scores by prediction by partial matching (PPM) over bytes.

``train`` counts, over all whole training texts, every byte after its contexts
of up to three bytes: a context trie.  ``PPM`` turns the counts into the
probability of a byte in a context with escape estimation (method C: a context
with q distinct followers among n occurrences escapes with q/(n+q)) and symbol
exclusion (bytes that the longer context has seen take no part in the shorter
one).  The trie holds all contexts of up to two bytes (at most 256**3 entries)
and those of three bytes that make up at least ``SHARE`` of all positions (so at
most 1/SHARE of them): memory is bounded however much is learned.

``score`` adds, for every document, the pretrained code length of its bytes and
an end mark; with ``unigrams`` it also adds the word unigram base score, whose
counts travel by hash-partitioned joins between words and shards of documents.
``adaptive_score`` learns within each text alone, starting from nothing.

Edge cases: null is the empty text, which has an end mark only; rows that
repeat are scored each; with no training rows all bytes are equally likely; any
length of text is scored whole; extra columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm._shared import written
from wayfarer.llm._text import SPACED, blocks, hashed_words, text_bytes

#: Bytes that never occur in UTF-8 stand for the text's begin and end.
BEGIN, END = 0xFE, 0xFF
#: A three-byte context is held by every task if it makes up this part of all training positions, else joined.
SHARE = 2.0**-16
#: Bytes of text that share a table of word counts.
SHARD_BYTES = 12_000_000


def _framed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end, each after three BEGIN and before one END, and where each begins."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    framed = np.full(len(data) + 4 * n, BEGIN, np.uint8)
    text = np.repeat(np.arange(n), np.diff(offsets))
    framed[np.arange(len(data)) + 4 * text + 3] = data
    framed[offsets[1:] + 4 * np.arange(1, n + 1) - 1] = END
    return framed, offsets + 4 * np.arange(n + 1)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], first) if len(keys) else keys


def train(docs: DataFrame, text: str = "text") -> PPM:
    """Count the byte contexts of all rows of ``docs`` and build the model."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for part in blocks(batches, "text"):
            framed, _ = _framed(part.column("text"))
            wide = framed.astype(np.uint32)
            key = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
            parts.append(np.unique(key[framed[3:] != BEGIN], return_counts=True))
            if len(parts) > 15:
                parts = [_summed(parts)]
        if parts:
            keys, n = _summed(parts)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_pydict({"gram": keys[i : i + 100_000].astype(np.int64), "n": n[i : i + 100_000].astype(np.int64)})

    grams = written(docs.select(F.col(text).alias("text")).mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    least = math.ceil(SHARE * (grams.agg(F.sum("n")).first()[0] or 0))
    seen = grams.select("gram", "n", F.shiftright("gram", 8).alias("context")).withColumn("n3", F.expr("sum(n) OVER (PARTITION BY context)"))
    short = grams.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n"))
    # both tables in one result: all contexts of two bytes, and those of three that are frequent
    both = short.select(F.lit(2).alias("of"), "gram", "n").unionByName(seen.where(F.col("n3") >= least).select(F.lit(3).alias("of"), "gram", "n"))
    rows = both.toPandas()
    two, three = rows[rows.of == 2], rows[rows.of == 3]
    model = PPM(two.gram.to_numpy(np.int64), two.n.to_numpy(np.int64), three.gram.to_numpy(np.int64), three.n.to_numpy(np.int64))
    model.rare = written(_rare(seen.where(F.col("n3") < least), short), "contexts")
    return model


def _rare(grams: DataFrame, short: DataFrame) -> DataFrame:
    """``gram`` and ``log``, its log10 probability, of the grams of rare contexts; for the bytes that their context
    has not seen, ``mid`` or ``low`` is to be added to the log10 probability in the context of two bytes: ``mid`` if that has seen the byte.
    """
    shorter = short.select(F.col("gram").alias("gram2"), F.col("n").alias("count2"))
    whole = short.groupBy(F.shiftright("gram", 8).alias("context2")).agg(F.sum("n").alias("n2"), F.count("*").alias("q2"))
    own = grams.withColumn("gram2", F.col("gram").bitwiseAND(0xFFFFFF)).join(shorter, "gram2")
    own = own.select("*", F.expr("count(*) OVER (PARTITION BY context)").alias("q3"), F.expr("sum(count2) OVER (PARTITION BY context)").alias("m3"))
    own = own.withColumn("context2", F.col("context").bitwiseAND(0xFFFF)).join(whole, "context2")
    escape = F.log10(F.col("q3") / (F.col("n3") + F.col("q3")))
    left, q_left = F.col("n2") - F.col("m3"), F.col("q2") - F.col("q3")
    inside = F.col("n2") + F.col("q2")
    return own.select(
        "gram",
        F.log10(F.col("n") / (F.col("n3") + F.col("q3"))).alias("log"),
        F.when(left > 0, escape + F.log10(inside / (left + q_left))).otherwise(escape).alias("mid"),
        (F.when(left > 0, escape + F.log10(q_left / (left + q_left))).otherwise(escape) + F.log10(inside / F.col("q2"))).alias("low"),
    )


class Rare:
    """The rows of the table of rare contexts that a shard of documents needs."""

    def __init__(self, grams: np.ndarray, log: np.ndarray, mid: np.ndarray, low: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.log = grams[order], log[order]
        self.contexts, first = np.unique(self.grams >> 8, return_index=True)
        self.mid, self.low = mid[order][first], low[order][first]


class PPM:
    """Tables of log10 probabilities: by two-byte context, and by frequent three-byte context; ``rare`` has the others."""

    rare: DataFrame | None = None

    def __init__(self, grams2: np.ndarray, n2: np.ndarray, grams3: np.ndarray, n3: np.ndarray):
        used = np.zeros(256, bool)
        for shift in (0, 8, 16):
            used[(grams2 >> shift) & 255] = True
        used[[BEGIN, END]] = True
        #: Codes of the bytes; those never seen share the last code, as they share every probability.
        self.code = np.full(256, used.sum(), np.int64)
        self.code[used] = np.arange(used.sum())
        a = self.size = int(used.sum()) + 1
        unseen = 256 - (a - 1)

        def coded(grams: np.ndarray, order: int) -> np.ndarray:
            out = np.zeros(len(grams), np.int64)
            for shift in range(8 * order, -8, -8):
                out = out * a + self.code[(grams >> shift) & 255]
            return out

        count2 = np.zeros(a * a * a)
        count2[coded(grams2, 2)] = n2
        count2 = count2.reshape(a * a, a)
        count1 = count2.reshape(a, a, a).sum(axis=0)
        count0 = count1.sum(axis=0)
        # after an escape from the empty context: bytes never seen are equally likely
        none = np.full(a, 1.0 / max(1, unseen))
        p0 = _blend(count0[None, :], none[None, :])[0]
        after1 = _excluded(count1, count0[None, :], none[None, :])
        p1 = _blend(count1, after1)
        empty1 = count1.sum(axis=1) == 0
        p1[empty1] = p0
        after1[empty1] = p0
        table2 = np.empty((a * a, a), np.float32)
        rows3 = coded(grams3, 3)
        contexts = np.unique(rows3 // a)
        self.row3 = np.full(a**3, -1, np.int32)
        self.row3[contexts] = np.arange(len(contexts))
        count3 = np.zeros((len(contexts), a), np.float32)
        count3[self.row3[rows3 // a], rows3 % a] = n3
        table3 = np.empty((len(contexts), a), np.float32)
        suffix3 = contexts % (a * a)
        by_suffix = np.argsort(suffix3, kind="stable")
        for first in range(a):  # contexts whose first byte of two is this one: a table of a rows at a time
            rows = slice(first * a, first * a + a)
            own, lower = count2[rows], count1
            after2 = _excluded(own, lower, after1)
            p2 = _blend(own, after2)
            empty = own.sum(axis=1) == 0
            p2[empty] = p1[empty]
            table2[rows] = np.log10(p2)
            lo, hi = np.searchsorted(suffix3[by_suffix], [first * a, first * a + a])
            at = by_suffix[lo:hi]
            if len(at):
                suffix = suffix3[at] - first * a
                longer = count3[at].astype(float)
                table3[at] = np.log10(_blend(longer, _excluded(longer, own[suffix], after2[suffix])))
        self.table2, self.table3 = table2.reshape(-1), table3.reshape(-1)
        #: One bit for each entry of ``table2``: whether the context has seen the byte.
        self.seen2 = np.packbits(count2.reshape(-1) > 0)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rare"}  # tasks get its rows by joins

    def unheld(self, column: pa.Array) -> np.ndarray:
        """The contexts of three bytes in the texts that are not among the frequent ones."""
        framed, _ = _framed(column)
        c = self.code[framed]
        at = np.flatnonzero((self.row3[(c[:-3] * self.size + c[1:-2]) * self.size + c[2:-1]] < 0) & (framed[3:] != BEGIN))
        return np.unique(_contexts(framed, at))

    def log10(self, column: pa.Array, rare: Rare) -> np.ndarray:
        """log10 of the probability of each whole text, whose rare contexts are in ``rare``."""
        framed, begins = _framed(column)
        c = self.code[framed]
        a = self.size
        context = (c[:-3] * a + c[1:-2]) * a + c[2:-1]
        row = self.row3[context]
        sym = c[3:]
        known = row >= 0
        at2 = (context % (a * a)) * a + sym
        p = np.where(known, self.table3[np.where(known, row, 0).astype(np.int64) * a + sym] if len(self.table3) else np.float32(0), self.table2[at2]).astype(np.float64)
        if not len(begins) - 1:
            return np.zeros(0)
        if len(rare.contexts):
            at = np.flatnonzero(~known)
            context = _contexts(framed, at)
            i = np.minimum(np.searchsorted(rare.contexts, context), len(rare.contexts) - 1)
            good = rare.contexts[i] == context
            at, context, i = at[good], context[good], i[good]
            gram = (context << 8) | framed[at + 3]
            j = np.minimum(np.searchsorted(rare.grams, gram), len(rare.grams) - 1)
            two = at2[at]
            inside = (self.seen2[two >> 3] >> (7 - (two & 7)).astype(np.uint8)) & 1
            p[at] = np.where(rare.grams[j] == gram, rare.log[j], p[at] + np.where(inside == 1, rare.mid[i], rare.low[i]))
        p = np.append(p, [0.0, 0.0, 0.0])  # entry i is for byte i+3; a text's own entries are its length and the end
        total = np.append(0.0, np.cumsum(p))
        return total[begins[1:] - 3] - total[begins[:-1]]


def _contexts(framed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three bytes from each place, as a number."""
    return (framed[at].astype(np.int64) << 16) | (framed[at + 1].astype(np.int64) << 8) | framed[at + 2]


def _blend(own: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Probabilities in contexts with counts ``own``, given those after an escape."""
    n, q = own.sum(axis=1, keepdims=True), np.count_nonzero(own, axis=1)[:, None]
    of = np.maximum(n + q, 1)
    return np.where(own > 0, own / of, np.where(n > 0, q / of, 1.0) * after)


def _excluded(own: np.ndarray, lower: np.ndarray, after_lower: np.ndarray) -> np.ndarray:
    """Probabilities after an escape from ``own``: the shorter context without what ``own`` has seen."""
    left = np.where(own > 0, 0, lower)
    return _blend(left, np.broadcast_to(after_lower, left.shape))


def _dealt(docs: DataFrame, n_bytes: int, key: str, text: str, *more: str) -> DataFrame:
    """``shard``, ``key``, ``text`` and the columns ``more``, dealt by hash to shards of about ``SHARD_BYTES``."""
    shards = max(1, -(-n_bytes // SHARD_BYTES))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(key).cast("string"), text), F.lit(shards)).cast("int").alias("shard"),
        F.col(key).alias("key"),
        F.coalesce(text, F.lit("")).alias("text"),
        *(F.col(name).alias(name) for name in more),
    )
    return rows.repartition(shards, "shard")


def _rare_of_shards(dealt: DataFrame, model: PPM, shared: Broadcast) -> DataFrame:
    """``shard`` and the rows of the table of rare contexts whose context is in the shard's texts."""

    def contexts_of(table: pa.Table) -> pa.Table:
        found = [shared.value.unheld(part.column("text")) for part in blocks(table.select(["text"]).to_batches(), "text")]
        contexts = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return pa.table({"shard": pa.array(np.full(len(contexts), table["shard"][0].as_py(), np.int32)), "context": contexts})

    asked = dealt.select("shard", "text").groupBy("shard").applyInArrow(contexts_of, "shard int, context bigint")
    return asked.join(model.rare.withColumn("context", F.shiftright("gram", 8)), "context").select("shard", "gram", "log", "mid", "low")


def _rare_rows(table: pa.Table) -> Rare:
    return Rare(*(table[x].to_numpy() for x in ("gram", "log", "mid", "low")))


def score(docs: DataFrame, model: PPM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score``, the log10 probability of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dealt = _dealt(docs, docs.agg(F.sum(F.octet_length(text))).first()[0] or 0, key, text)

    def scored(shard_docs: pa.Table, contexts: pa.Table) -> pa.Table:
        rare = _rare_rows(contexts)
        parts = [pa.RecordBatch.from_arrays([part.column("key"), pa.array(shared.value.log10(part.column("text"), rare))], ["key", "score"]) for part in blocks(shard_docs.to_batches(), "text")]
        return pa.Table.from_batches(parts)

    joined = dealt.groupBy("shard").cogroup(_rare_of_shards(dealt, model, shared).groupBy("shard"))
    return joined.applyInArrow(scored, f"key {dealt.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def score_with_unigrams(docs: DataFrame, model: PPM, key: str = "doc_id", text: str = "text", held_out: str = "held_out") -> DataFrame:
    """The PPM score beside a word unigram score learned from the rows that are not held out.

    Documents are dealt by hash to shards of about ``SHARD_BYTES``.  Each shard
    sends its distinct words with their own counts; a window by word, which has
    a row for each shard, adds them up, and what differs from the shard's own count goes back to it.  The rare
    contexts of its texts come the same way.  No word and no document is
    gathered beyond its shard.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count_if(~F.col(held_out)).alias("training")).first()
    training = size.training
    dealt = _dealt(docs.withColumn("held_out", F.col(held_out)), size.bytes or 0, key, text, "held_out")

    def counted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of the shard, and how often training rows have each."""
        parts = []
        for part in blocks(table.select(["text", "held_out"]).to_batches(), "text"):
            words, bounds = hashed_words(part.column("text"), SPACED)
            learned = np.repeat(~np.array(part.column("held_out").to_pylist(), bool), np.diff(bounds))
            unique, at = np.unique(words, return_inverse=True)
            parts.append((unique, np.bincount(at, learned, len(unique)).astype(np.int64)))
        return _summed(parts) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def words_of(table: pa.Table) -> pa.Table:
        words, n = counted(table)
        return pa.table({"shard": pa.array(np.full(len(words), table["shard"][0].as_py(), np.int32)), "word": words.view(np.int64), "n": n})

    pieces = dealt.groupBy("shard").applyInArrow(words_of, "shard int, word bigint, n bigint")
    whole = pieces.select("*", F.expr("sum(n) OVER (PARTITION BY word) AS total"), F.expr("min(shard) OVER (PARTITION BY word) AS first"))
    totals = whole.agg(F.sum("n").alias("n"), F.count_if((F.col("shard") == F.col("first")) & (F.col("total") > 0)).alias("v"))
    elsewhere = whole.where("total <> n").select("shard", "word", "total", F.lit(None).cast("struct<gram: bigint, log: double, mid: double, low: double>").alias("rare"))
    rare = _rare_of_shards(dealt, model, shared).select("shard", F.lit(None).cast("bigint").alias("word"), F.lit(None).cast("bigint").alias("total"), F.struct("gram", "log", "mid", "low").alias("rare"))

    def scored(shard_docs: pa.Table, joined: pa.Table) -> pa.Table:
        of_words = pc.is_valid(joined["word"])
        counts = joined.select(["word", "total"]).filter(of_words)
        contexts = joined["rare"].filter(pc.invert(of_words))
        contexts = _rare_rows(pa.table({x: pc.struct_field(contexts, x) for x in ("gram", "log", "mid", "low")}))
        words, n = counted(shard_docs)
        at = np.searchsorted(words, counts["word"].to_numpy().view(np.uint64))
        n[at] = counts["total"].to_numpy()
        logs = np.log10(n + 0.1)
        out = []
        for part in blocks(shard_docs.to_batches(), "text"):
            found, bounds = hashed_words(part.column("text"), SPACED)
            at = np.searchsorted(words, found)
            sums = np.append(0.0, np.cumsum(logs[at]))
            known = np.append(0, np.cumsum(n[at] > 0))
            out.append(
                pa.RecordBatch.from_pydict({
                    "key": part.column("key"),
                    "held_out": part.column("held_out"),
                    "n_words": np.diff(bounds),
                    "n_known": known[bounds[1:]] - known[bounds[:-1]],
                    "logs": np.array([math.fsum(logs[at[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]),
                    "score": shared.value.log10(part.column("text"), contexts),
                })
            )
        return pa.Table.from_batches(out)

    kind = dealt.schema["key"].dataType.simpleString()
    joined = dealt.groupBy("shard").cogroup(elsewhere.unionByName(rare).groupBy("shard")).applyInArrow(scored, f"key {kind}, held_out boolean, n_words bigint, n_known bigint, logs double, score double")
    n_all, v_all = F.coalesce(totals.select("n").scalar(), F.lit(0)) + F.lit(training), F.coalesce(totals.select("v").scalar(), F.lit(0)) + F.lit(int(training > 0))
    below = F.log10(n_all + 0.1 * (v_all + 1))
    n_tokens = F.col("n_words") + 1
    return joined.select(
        F.col("key").alias(key),
        F.col("held_out").alias(held_out),
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + int(training > 0)).alias("n_known"),
        n_all.cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(training + 0.1) - n_tokens * below).alias("base_score"),
        "score",
    )


class AdaptivePPM:
    """PPM that learns a text while it codes it, with contexts of up to ``order`` bytes."""

    def __init__(self, order: int = 3):
        self.order = order

    def log10(self, text: str | None) -> float:
        data = list((text or "").encode()) + [END]
        seen: dict[bytes, dict[int, int]] = {}
        total = 0.0
        for i, sym in enumerate(data):
            out: set[int] = set()
            left = 1.0
            for d in range(min(self.order, i), -1, -1):
                now = {s: c for s, c in seen.get(bytes(data[i - d : i]), {}).items() if s not in out}
                n, q = sum(now.values()), len(now)
                if sym in now:
                    left *= now[sym] / (n + q)
                    break
                if n:
                    left *= q / (n + q)
                    out |= now.keys()
            else:
                left /= 256 - len(out)
            total += math.log10(left)
            for d in range(min(self.order, i) + 1):
                followers = seen.setdefault(bytes(data[i - d : i]), {})
                followers[sym] = followers.get(sym, 0) + 1
        return total


def adaptive_score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """``key`` and ``score``: each whole text coded by what it has itself shown so far."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = AdaptivePPM(order)
        for part in batches:
            yield pa.RecordBatch.from_arrays([part.column("key"), pc.cast(pa.array([model.log10(t) for t in part.column("text").to_pylist()]), pa.float64())], ["key", "score"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)
