"""Numbering and carrying values along a whole table in a sort order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.sources.scratch import written

#: Keys drawn to place the borders of the ranges: the work per range depends on them, the results do not.
DRAWN = 2_000


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with ``_key``, the order as a struct, and ``_range``: rows of a range stand before all rows of the next; equal keys share one.

    Borders are drawn from the keys, a range for each shuffle partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    keyed = df.withColumn("_key", key)
    total = keyed.count()
    drawn = sorted(tuple(r[0]) for r in keyed.select("_key").sample(min(1.0, DRAWN / max(1, total)), seed=1).collect())
    borders = drawn[:: max(1, len(drawn) // parts)][1:]
    below = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, keyed.schema["_key"].dataType, strict=True)]) for b in borders]
    return keyed.withColumn("_range", F.size(F.filter(F.array(*below), lambda b: b <= F.col("_key"))) if below else F.lit(0))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row from 1 on by the ascending ``order``, which must be total and without nulls.

    Rows are dealt to ranges of the order, sorted, numbered within each range and written once; the
    counts of the ranges, one row each, give what to add.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # what an id of this function holds: the range above the place within it
    at = F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at))
    rows = rows.withColumns({"_range": F.shiftright("_at", 33), "_within": F.col("_at").bitwiseAND(F.lit(2**33 - 1))})
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # as many rows as there are ranges
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(F.broadcast(counts.select("_range", before.alias("_before"))), "_range")
    return placed.withColumn(name, (F.col("_within") + F.col("_before") + 1).cast("int")).drop("_at", "_range", "_within", "_before")


def carry(rows: DataFrame, values: dict[str, Column], current: bool = False, then: tuple[str, ...] = ()) -> DataFrame:
    """``carried`` over rows that are ``ranged`` already; ``then``: further columns of their order."""
    rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    place = F.struct("_key", *then)
    ends = rows.groupBy("_range").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in values])
    # as many rows as there are ranges
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_range", *[F.last(f"_e_{n}", ignorenulls=True).over(earlier).alias(f"_e_{n}") for n in values])
    within = Window.partitionBy("_range").orderBy("_key", *then).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    rows = rows.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(within) for n in values}).join(F.broadcast(ends), "_range")
    return rows.withColumns({n: F.coalesce(n, f"_e_{n}") for n in values}).drop(*[f"_{k}_{n}" for k in "ve" for n in values])


def running(rows: DataFrame, values: dict[str, Column], then: tuple[str, ...] = ()) -> DataFrame:
    """``ranged`` rows with the sums of values up to and with each row."""
    rows = rows.withColumns({f"_v_{n}": v for n, v in values.items()})
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in values])
    # as many rows as there are ranges
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_e_{n}").over(earlier), F.lit(0)).alias(f"_e_{n}") for n in values])
    within = Window.partitionBy("_range").orderBy("_key", *then).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(f"_v_{n}").over(within) for n in values}).join(F.broadcast(sums), "_range")
    return rows.withColumns({n: F.col(n) + F.col(f"_e_{n}") for n in values}).drop(*[f"_{k}_{n}" for k in "ve" for n in values])


def carried(df: DataFrame, order: list[Column], values: dict[str, Column], current: bool = False) -> DataFrame:
    """``df`` with, for each of ``values``, the last one that is not null in an earlier row of the whole table (``current``: or in the row itself).

    ``order`` must be total and without nulls.  Each range is passed once, in
    order; what it carries in comes from the last values of the ranges before
    it, one row for each range.
    """
    return carry(ranged(df, order), values, current).drop("_key", "_range")
