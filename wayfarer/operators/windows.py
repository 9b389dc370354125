"""Neighbours, carry-forward, islands and numbering over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def legs_filtered(df: DataFrame, keys: list[str], order: list, eligible: Column, stop: str, route: str | None = None) -> DataFrame:
    """Legs between neighbours after the ineligible stops are gone (so legs bridge them); no leg across a change of route."""
    w = ordered(keys, order)
    rows = df.where(eligible).withColumn("from_stop", F.lag(stop).over(w)).withColumn("to_stop", F.col(stop))
    legs = rows.where("from_stop IS NOT NULL AND to_stop IS NOT NULL")
    return legs if route is None else rows.withColumn("_route", F.lag(route).over(w)).where("from_stop IS NOT NULL AND to_stop IS NOT NULL").where(F.col("_route") == F.col(route)).drop("_route")


def legs_raw(df: DataFrame, keys: list[str], order: list, eligible: Column, stop: str) -> DataFrame:
    """Legs between direct neighbours only: an ineligible stop breaks the chain."""
    w = ordered(keys, order)
    rows = df.withColumn("_ok", eligible).withColumn("_was", F.lag("_ok").over(w)).withColumn("from_stop", F.lag(stop).over(w)).withColumn("to_stop", F.col(stop))
    return rows.where("_ok AND _was AND from_stop IS NOT NULL AND to_stop IS NOT NULL").drop("_ok", "_was")


def next_known(value: str, keys: list[str], order: list) -> Column:
    """The next value that is not null."""
    return F.first(value, ignorenulls=True).over(ordered(keys, order).rowsBetween(1, Window.unboundedFollowing))


def previous_known(value: str, keys: list[str], order: list) -> Column:
    """The last value before this row that is not null."""
    return F.last(value, ignorenulls=True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1))


def carried(value: Column, keys: list[str], order: list) -> Column:
    """The value of the row, or the last one known."""
    return F.last(value, ignorenulls=True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def changes(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    return df.withColumn("was", F.lag(value).over(ordered(keys, order))).where(F.col("was") != F.col(value))


def clusters(df: DataFrame, keys: list[str], order: list, hit: Column, tolerance: int = 1) -> DataFrame:
    """Runs of hits with at most ``tolerance`` rows between them.

    A run keeps up to ``tolerance`` rows after its last hit.  Adds ``position``
    and ``cluster`` (from 1 in each key); rows of no run are left out.
    """
    w = ordered(keys, order)
    rows = df.withColumn("position", F.row_number().over(w)).withColumn("_hit", hit)
    here = F.when(F.col("_hit"), F.col("position"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_last", F.max(here).over(before))
    begins = F.col("_hit") & (F.col("_last").isNull() | (F.col("position") - F.col("_last") > tolerance + 1))
    rows = rows.withColumn("cluster", F.sum(F.when(begins, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("_hit") | (F.col("position") - F.col("_last") <= tolerance)).drop("_last", "_hit")


def with_one_more(found: DataFrame, df: DataFrame, keys: list[str], order: list, extra: Column) -> DataFrame:
    """Each cluster and the row after its end, if that row is wanted and in no cluster."""
    rows = df.withColumn("position", F.row_number().over(ordered(keys, order))).where(extra)
    ends = found.groupBy(*keys, "cluster").agg((F.max("position") + 1).alias("position"))
    free = rows.join(found.select(*keys, "position"), [*keys, "position"], "left_anti")
    return found.unionByName(free.join(ends, [*keys, "position"]), allowMissingColumns=True)


def letter_id(prefix: Column, keys: list[str], order: list) -> Column:
    """Prefix and a, b, c ... by order."""
    return F.concat(prefix, F.char(F.lit(96) + F.row_number().over(ordered(keys, order))))


def wrapped_neighbours(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """``next`` and ``previous`` value, the ends joined to a ring."""
    w = ordered(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({"next": F.coalesce(F.lead(value).over(w), F.first(value).over(whole)), "previous": F.coalesce(F.lag(value).over(w), F.last(value).over(whole))})


def contiguous(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Per key whether the numbers are 1 to n, each once."""
    return df.groupBy(*keys).agg(((F.min(number) == 1) & (F.max(number) == F.count("*")) & (F.count_distinct(number) == F.count("*"))).alias("contiguous"))


def buckets(df: DataFrame, keys: list[str], order: list, size: int, text: str, between: str = " ") -> DataFrame:
    """Rows in groups of ``size`` by order, their texts joined."""
    number = F.floor((F.row_number().over(ordered(keys, order)) - 1) / size)
    rows = df.withColumn("bucket", number).withColumn("_at", F.row_number().over(ordered(keys, order)))
    return rows.groupBy(*keys, "bucket").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", text))), lambda r: r[text]), between).alias("text"))
