"""Unions, upserts, refreshes and ledgers over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_distinct(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The parts as one table; of rows with one key the earliest part's first stays."""
    out = parts[0].withColumn("_part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("_part", F.lit(i)), allowMissingColumns=True)
    others = [c for c in out.columns if c not in keys and c != "_part"]
    rows = out.groupBy(*keys).agg(F.min(F.struct("_part", *others)).alias("r"))
    return rows.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def upsert(base: DataFrame, patch: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Patch rows replace or join the base; a null in the patch, and the columns to keep, leave the base's value."""
    columns = [c for c in base.columns if c != key]
    new = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns if c in patch.columns])
    joined = base.join(new, key, "full")
    return joined.select(key, *[F.coalesce(c, f"_{c}").alias(c) if c in keep and c in patch.columns else F.coalesce(f"_{c}", c).alias(c) if c in patch.columns else F.col(c) for c in columns])


def refresh(base: DataFrame, fresh: DataFrame, key: str, column: str) -> DataFrame:
    """One column from the fresh table, all else as curated; ``state`` says refreshed, stale or new."""
    new = fresh.select(key, F.col(column).alias("_new"), F.lit(True).alias("_fresh"))
    joined = base.withColumn("_old", F.lit(True)).join(new, key, "full")
    state = F.when(F.col("_old") & F.col("_fresh"), "refreshed").when(F.col("_old"), "stale").otherwise("new")
    return joined.withColumn("state", state).withColumn(column, F.when(F.col("_fresh"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_fresh", "_old")


def apply_ledger(base: DataFrame, ledger: DataFrame, key: str, position: str, writes: dict[str, Column], skipped: Column) -> DataFrame:
    """Decisions in ledger order on keyed rows.

    ``writes`` gives for each column the condition under which a decision writes
    it; the last such decision counts.  Keys that the base lacks are inserted
    unless their last decision is ``skipped``.  ``outcome`` is kept, updated or
    inserted.
    """
    wanted = [F.max_by(F.when(cond, F.col(c)), F.when(cond, F.col(position))).alias(f"_{c}") for c, cond in writes.items()]
    touched = [F.max(F.when(cond, F.col(position))).isNotNull().alias(f"_{c}_set") for c, cond in writes.items()]
    last = ledger.groupBy(key).agg(*wanted, *touched, F.max_by(skipped, F.col(position)).alias("_skip"))
    joined = base.withColumn("_old", F.lit(True)).join(last, key, "full").where("_old OR NOT _skip")
    any_set = F.lit(False)
    for c in writes:
        any_set = any_set | F.coalesce(F.col(f"_{c}_set"), F.lit(False))
    outcome = F.when(F.col("_old").isNull(), "inserted").when(any_set, "updated").otherwise("kept")
    joined = joined.withColumn("outcome", outcome).withColumns({c: F.when(F.coalesce(F.col(f"_{c}_set"), F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in writes})
    return joined.drop("_old", "_skip", *[f"_{c}" for c in writes], *[f"_{c}_set" for c in writes])


def last_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    """Of rows with one key the last."""
    down = [F.desc(c) for c in order]
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*down))).where("_place = 1").drop("_place")


def append_missing(rows: Column, new: Column, same) -> Column:
    """An array with one more element unless an element is the same."""
    return F.when(F.exists(rows, lambda r: same(r, new)), rows).otherwise(F.concat(rows, F.array(new)))


def keep_existing(new: DataFrame, old: DataFrame, key: str, text: str, form) -> DataFrame:
    """Generated texts, but the existing one where both have the same normal form."""
    joined = new.join(old.select(key, F.col(text).alias("_old")), key, "left")
    same = F.coalesce(form(F.col("_old")) == form(F.col(text)), F.lit(False))
    return joined.withColumn("kept", same).withColumn(text, F.when(same, F.col("_old")).otherwise(F.col(text))).drop("_old")


def remaining(df: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What a resumed run still has to do."""
    return df if force else df.join(done, key, "left_anti")
