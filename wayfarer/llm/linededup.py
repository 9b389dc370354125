"""Line dedup with a suffix array over line ids, by distributed prefix doubling.

The corpus is one long sequence of line ids: documents in key order, lines in
text order, and no run crosses a document.  Prefix doubling names, for every
position that is still tied with another, the run of 2**k lines that begins
there: pairs of names (of the position, and of the one 2**k lines on) are
counted, sorted, and numbered in their order, so names sort as the suffixes do
and the positions with one name are one interval of the suffix array whose
longest common prefix is at least 2**k lines.  Positions that are alone leave
after each step; lines that occur once never enter.

After the step that names runs of 2**k lines, the positions of one name are an
interval of the suffix array whose longest common prefix is at least 2**k.  A
run of m lines, 2**k <= m < 2**(k+1), repeats exactly where two positions share
the interval of its head and, m - 2**k lines on, that of its tail: so the
intervals of the steps hold all maximal repeated runs (``repeated_runs``).

A repeated run counts if it holds at least ``min_words`` words.  Every line
inside a maximal run of that kind lies in a shortest such window, counted
forward from its first line or back from its last, so it is enough to look at
these windows: one of m lines is named by the two names of its first and last
2**k lines (2**k <= m < 2**(k+1)), and doubling ends when no tied position
needs longer ones.  Of the windows with one name the first in corpus order
stays, and the lines of all others are deleted.

Edge cases: a null text stays null and has no lines; an empty text is one line
without words; lines with few words go only as part of a run with enough of
them; rows with equal key and text are one place of the corpus and are treated
alike; rows with equal keys and other texts are ordered by the hash of their
text; a null key sorts first.  Columns other than the text stay; result columns
replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.llm._shared import written
from wayfarer.llm._text import blocks

MIN_WORDS = 10


def _place(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def lines(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """Every line of every text: its document, number, id, and the shortest windows from it and up to it."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), _place(key, text).alias("doc"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            ids, numbers, ahead, behind, of = [], [], [], [], []
            for i, text in enumerate(part.column("text")):
                found = text.as_py().encode().split(b"\n")
                n = len(found)
                ids += map(xxhash.xxh3_64_intdigest, found)
                upto = np.zeros(n + 1, np.int64)
                np.cumsum([len(line.split()) for line in found], out=upto[1:])
                at = np.arange(n)
                stop = np.searchsorted(upto, upto[:-1] + min_words)
                ahead.append(np.where(stop <= n, stop - at, 0))
                start = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
                behind.append(np.where(start >= 0, at + 1 - start, 0))
                numbers.append(at)
                of.append(np.full(n, i))
            if not of:
                continue
            of = np.concatenate(of)
            columns = [part.column("key").take(pa.array(of)), part.column("doc").take(pa.array(of)), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (numbers, ahead, behind)), pa.array(np.array(ids, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "line", "ahead", "behind", "name"])

    return rows.mapInArrow(cut, f"key {kind}, doc bigint, line int, ahead int, behind int, name bigint")


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies of windows of lines: ``key``, ``doc`` (hash of key and text), ``start`` and ``size``."""
    spark = docs.sparkSession
    every = lines(docs, key, text, max(1, min_words))
    # counted apart and written: the join can then split a line that makes up a large part of the corpus
    often = written(every.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "often")
    tied = written(every.join(often, "name", "left_semi").distinct(), "lines")
    windows = tied.select("key", "doc", F.explode(F.array(F.struct(F.col("line").alias("start"), F.col("ahead").alias("size")), F.struct((F.col("line") - F.col("behind") + 1).alias("start"), F.col("behind").alias("size")))).alias("w"))
    windows = windows.select("key", "doc", "w.*").where("size > 0").distinct()
    longest = windows.agg(F.max("size")).first()[0] or 0
    names = tied.select("doc", "line", "name")
    found = None
    span = 1
    while span <= longest:
        first, last = names.select("doc", F.col("line").alias("start"), F.col("name").alias("head")), names.select("doc", F.col("line").alias("end"), F.col("name").alias("tail"))
        fit = windows.where((F.col("size") >= span) & (F.col("size") < 2 * span))
        fit = fit.join(first, ["doc", "start"])
        if span > 1:
            fit = fit.withColumn("end", F.col("start") + F.col("size") - span).join(last, ["doc", "end"])
        else:
            fit = fit.withColumn("tail", F.col("head"))
        place = F.struct("key", "doc", "start")
        copies = fit.groupBy("size", "head", "tail").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
        copies = written(copies, f"repeated{span}")
        later = fit.join(copies, ["size", "head", "tail"]).where(place != F.col("kept")).select("key", "doc", "start", "size")
        later = written(later, f"copies{span}")
        found = later if found is None else found.unionByName(later)
        if 2 * span > longest:
            break
        pairs = names.join(names.select("doc", (F.col("line") - span).alias("line"), F.col("name").alias("next")), ["doc", "line"])
        # names of the tied pairs in their sort order; written, so that every reader sees the same numbers
        numbered = pairs.groupBy("name", "next").agg(F.count("*").alias("n")).where("n > 1").orderBy("name", "next").select("name", "next", F.monotonically_increasing_id().alias("longer"))
        numbered = written(numbered, f"names{2 * span}")
        names = written(pairs.join(numbered, ["name", "next"]).select("doc", "line", F.col("longer").alias("name")), f"tied{2 * span}")
        span *= 2
        longest = windows.join(names.select("doc", F.col("line").alias("start")), ["doc", "start"], "left_semi").agg(F.max("size")).first()[0] or 0
    return found if found is not None else spark.createDataFrame([], windows.schema)


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Later copies as maximal runs of lines: ``key``, ``doc``, ``start`` and ``stop`` (not included).

    Windows of a document that overlap or touch make one run; the order is by
    line within a document, never over the corpus.
    """
    later = repeated_windows(docs, key, text, min_words).withColumn("stop", F.col("start") + F.col("size"))
    along = Window.partitionBy("doc").orderBy("start", "stop")
    reach = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begun = later.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return begun.groupBy("doc", "_run").agg(F.first("key").alias("key"), F.min("start").alias("start"), F.max("stop").alias("stop")).select("key", "doc", "start", "stop")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs taken out of the text, ``n_lines`` (before) and ``n_removed``."""
    later = repeated_windows(docs, key, text, min_words)
    gone = later.select(F.col("doc").alias("_of"), F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("line")).groupBy("_of").agg(F.collect_set("line").alias("_gone"))
    joined = docs.drop("n_lines", "n_removed").withColumn("_doc", _place(key, text)).join(gone, F.col("_doc") == F.col("_of"), "left").drop("_doc", "_of")
    cut = F.split(F.col(text), "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("_gone"))
    shorter = F.array_join(F.transform(stays, lambda i: F.get(cut, i)), "\n")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(cut)).cast("long")
    return joined.withColumn("n_lines", n_lines).withColumn("n_removed", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")).withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(shorter)).drop("_gone")
