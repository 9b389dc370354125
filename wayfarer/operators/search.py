"""Faceted search: hits by weight, caps, totals and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.text import fold, search_snippet


def top_per_group(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each group and the ``total`` of the group.

    The total is counted apart, so that the ranking keeps ``cap`` rows of each
    group before its shuffle instead of holding whole groups.
    """
    totals = df.groupBy(group).agg(F.count("*").alias("total"))
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= cap)
    return ranked.join(totals, group)


def overlaps(values: Column, active: list) -> Column:
    """Facet test on an array: nothing active, or an empty array, lets all pass."""
    if not active:
        return F.lit(True)
    return (F.size(values) == 0) | F.arrays_overlap(values, F.array(*[F.lit(a) for a in active]))


def facets(scope: Column, tests: list[Column]) -> Column:
    """The tests hold in the ``map`` scope only."""
    all_hold = F.lit(True)
    for test in tests:
        all_hold = all_hold & test
    return F.when(scope == "map", all_hold).otherwise(True)


def search(df: DataFrame, q: str, title: str, body: str) -> DataFrame:
    """Rows whose title or body has the query: ``weight`` 0 or 1, the place in the body, and a snippet."""
    needle = fold(F.lit(q))
    in_title = F.contains(fold(F.col(title)), needle)
    at = F.call_function("locate", needle, fold(F.col(body)))
    hits = df.withColumn("weight", F.when(in_title, 0).when(at > 0, 1)).where(F.col("weight").isNotNull())
    return hits.withColumn("at", at).withColumn("snippet", search_snippet(F.col(body), F.col("at")))


def first_with_total(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of all, each with the ``total`` of all."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(n).join(F.broadcast(total))
