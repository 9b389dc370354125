"""Counters, votes, roll-ups and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Counts by key, those under ``least`` left out; ordered by count, then key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), *keys)


def histogram(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts between the edges (the upper one included), with buckets for null, zero and the open end; empty ones are kept."""
    names = ["null", "zero"] + [f"<={e:g}" for e in edges] + [f">{edges[-1]:g}"]
    bucket = F.when(value.isNull(), "null").when(value == 0, "zero")
    for e in edges:
        bucket = bucket.when(value <= e, f"<={e:g}")
    counted = df.groupBy(bucket.otherwise(names[-1]).alias("bucket")).agg(F.count("*").alias("n"))
    all_buckets = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(names)], "bucket string, place int")
    return all_buckets.join(counted, "bucket", "left").select("bucket", "place", F.coalesce("n", F.lit(0)).alias("n"))


def consensus(votes: DataFrame, group: list[str], order: list[str], vote: str, confidence: str, warning: str) -> DataFrame:
    """The verdict of up to three votes per group.

    Two equal first votes decide; else a third is heard and two of three decide;
    else the verdict is ``uncertain``.  Confidence is the mean over the winning
    votes, to three places; warnings are the sorted distinct ones of all heard.
    """
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    heard = votes.withColumn("_place", place).where("_place <= 3")
    rows = heard.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_place", F.col(vote).alias("v"), F.col(confidence).alias("c"), F.col(warning).alias("w")))).alias("all"))
    agreed = F.coalesce(F.get("all", F.lit(0))["v"] == F.get("all", F.lit(1))["v"], F.lit(False))
    used = F.when(agreed, F.slice("all", 1, 2)).otherwise(F.col("all"))
    rows = rows.withColumn("used", used)
    # of at most three votes the winner, if there is one, is the vote that another repeats
    winner = F.get(F.filter("used", lambda x: F.size(F.filter("used", lambda y: y["v"] == x["v"])) >= 2), F.lit(0))["v"]
    rows = rows.withColumn("winner", winner)
    winning = F.filter("used", lambda x: x["v"] == F.col("winner"))
    mean = F.aggregate(winning, F.lit(0.0), lambda a, x: a + x["c"]) / F.size(winning)
    return rows.select(
        *group,
        F.coalesce("winner", F.lit("uncertain")).alias("decision"),
        F.when(agreed, "two").when(F.col("winner").isNotNull(), "majority").otherwise("none").alias("method"),
        F.when(F.col("winner").isNotNull(), F.round(mean, 3)).alias("confidence"),
        F.array_sort(F.array_distinct(F.filter(F.transform("used", lambda x: x["w"]), lambda w: w.isNotNull()))).alias("warnings"),
    )


def dominant(df: DataFrame, key: str, kind: str, priority: list[str], default: str) -> DataFrame:
    """The most frequent kind of each key; ties by the priority list; keys without a kind get the default."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind))
    counts = df.groupBy(key, kind).agg(F.count(kind).alias("n"))
    return counts.groupBy(key).agg(F.coalesce(F.max_by(kind, F.struct("n", -F.when(rank > 0, rank).otherwise(len(priority) + 1))), F.lit(default)).alias("dominant"))


def ordered_list(order: list[str], value: str) -> Column:
    """The values of a group in order, the first of repeated ones kept."""
    return F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value")))), lambda r: r["_value"]))


def span(first: tuple[str, str], last: tuple[str, str]) -> list[Column]:
    """First page with its smallest line, last page with its largest line."""
    low, high = F.min(F.struct(*first)), F.max(F.struct(*last))
    return [low[first[0]].alias("first_page"), low[first[1]].alias("first_line"), high[last[0]].alias("last_page"), high[last[1]].alias("last_line")]
