"""Streams of input events: quiet gaps, coalescing, sessions and thresholds, each beside its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from wayfarer.operators.sorting import carried


def settled(df: DataFrame, key: str, ts: str, quiet: float) -> DataFrame:
    """Debounce: the events that no other of their key follows within ``quiet`` seconds; ties go with all columns' order."""
    order = Window.partitionBy(key).orderBy(ts, *[c for c in df.columns if c not in (key, ts)])
    gap = F.lead(ts).over(order).cast("double") - F.col(ts).cast("double")
    return df.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > quiet)).drop("_gap")


def settled_stream(df: DataFrame, key: str, ts: str, value: str, quiet: str, late: str) -> DataFrame:
    """Debounce of a stream: the last value of every session that a gap of ``quiet`` ends; events later than ``late`` are dropped."""
    sessions = df.withWatermark(ts, late).groupBy(F.session_window(ts, quiet).alias("session"), F.col(key))
    return sessions.agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts)).drop("session")


def coalesced(df: DataFrame, key: str, ts: str, value: str, frame: str) -> DataFrame:
    """Frame coalescing: of the updates of a key in one frame the last; runs on tables and, with a watermark, on streams."""
    return df.groupBy(F.window(ts, frame).alias("frame"), F.col(key)).agg(F.max_by(value, ts).alias(value), F.count("*").alias("updates"))


def gestures(df: DataFrame, key: str, ts: str, dx: Column, dy: Column, gap: float, least: float) -> DataFrame:
    """Gesture sessions: moves of a key with gaps of at most ``gap`` seconds, locked to the axis of the larger first move; ``fires`` if the sum along it reaches ``least``."""
    order = Window.partitionBy(key).orderBy(ts)
    begun = F.coalesce((F.col(ts).cast("double") - F.lag(ts).over(order).cast("double") > gap).cast("int"), F.lit(1))
    rows = df.withColumns({"_begun": begun, "_dx": dx, "_dy": dy}).withColumn("gesture", F.sum("_begun").over(order))
    first = F.min_by(F.abs("_dx") >= F.abs("_dy"), ts)
    sums = rows.groupBy(key, "gesture").agg(first.alias("_flat"), F.sum("_dx").alias("_x"), F.sum("_dy").alias("_y"), F.count("*").alias("moves"))
    along = F.when(F.col("_flat"), F.col("_x")).otherwise(F.col("_y"))
    return sums.select(key, "gesture", "moves", F.when(F.col("_flat"), "x").otherwise("y").alias("axis"), (F.abs(along) >= least).alias("fires"))


def active(lines: DataFrame, triggers: DataFrame, line: str, place: str, index: str) -> DataFrame:
    """Each line with the index of the last trigger at or above it (null above the first, and for a null line; of triggers at one place the largest index).

    An as-of join: lines and triggers are dealt to ranges of places, one ordered
    pass goes over each, and the last trigger is carried over the borders.  Lines
    at one place are told apart by a hash, so they need not share a range.
    """
    nothing = F.lit(None).cast(triggers.schema[index].dataType)
    both = lines.where(F.col(line).isNotNull()).select(F.col(line).alias("_at"), nothing.alias(index), F.lit(1).alias("_kind"), F.struct(*lines.columns).alias("_row"))
    both = both.withColumn("_tie", F.xxhash64("_row"))
    marks = triggers.where(F.col(place).isNotNull()).groupBy(F.col(place).alias("_at")).agg(F.max(index).alias(index))
    marks = marks.select("_at", index, F.lit(0).alias("_kind"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.lit(0).cast("long").alias("_tie"))
    rows = carried(both.unionByName(marks), [F.col("_at"), F.col("_kind"), F.col("_tie")], {"_last": F.col(index)}, current=True)
    return rows.where("_kind = 1").select("_row.*", F.col("_last").alias(index)).unionByName(lines.where(F.col(line).isNull()).withColumn(index, nothing))


def cached(df: DataFrame, key: str, order: list) -> DataFrame:
    """Which look-ups of a key a cache answers: all but its first."""
    return df.withColumn("hit", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


class Accumulator:
    """Deltas added up until they pass a threshold; a quiet gap starts anew, and after firing all is ignored for a while."""

    def __init__(self, quiet: float, cooldown: float, threshold: float, state: tuple[float, float, float] | None = None):
        self.quiet, self.cooldown, self.threshold = quiet, cooldown, threshold
        self.last, self.until, self.total = state or (float("-inf"), float("-inf"), 0.0)

    def step(self, at: float, delta: float) -> int:
        """1 or -1 where it fires, else 0."""
        since, self.last = at - self.last, at
        if at < self.until:
            return 0
        self.total = delta if since > self.quiet else self.total + delta
        if abs(self.total) <= self.threshold:
            return 0
        fired = 1 if self.total > 0 else -1
        self.total, self.until = 0.0, at + self.cooldown
        return fired


def fires(df: DataFrame, key: str, ts: str, delta: str, quiet: float, cooldown: float, threshold: float) -> DataFrame:
    """Where the accumulator of each key fires, over a table: one key's events are one group, in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", kind="stable")
        one = Accumulator(quiet, cooldown, threshold)
        rows["fired"] = [one.step(a, d) for a, d in zip(rows["at"], rows["delta"], strict=True)]
        return rows.loc[rows["fired"] != 0, ["key", "ts", "fired"]]

    renamed = df.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(ts).cast("timestamp").cast("double").alias("at"), F.col(delta).cast("double").alias("delta"))
    return renamed.groupBy("key").applyInPandas(run, f"key bigint, ts {df.schema[ts].dataType.simpleString()}, fired int").withColumnRenamed("key", key)


def fires_stream(df: DataFrame, key: str, ts: str, delta: str, quiet: float, cooldown: float, threshold: float, late: str = "10 seconds") -> DataFrame:
    """The same over a stream, event by event in the order of their times, whatever the order they come in.

    Events wait in the state of their key until the watermark (``late`` behind
    the latest event) has passed them, and are then stepped through in order;
    those that come after the watermark has passed them are dropped.  A timer
    wakes a key when its next event is due, and once more when neither the quiet gap
    nor the cooldown can matter to a later event: then its state is gone.
    """

    def run(key_of: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, until, total, at, change = state.get if state.exists else (float("-inf"), float("-inf"), 0.0, [], [])
        seen = state.getCurrentWatermarkMs() / 1000
        waiting = list(zip(at, change, strict=True))
        for part in parts:
            waiting += [(a, d) for a, d in zip(part["at"], part["delta"], strict=True) if a > seen]
        waiting.sort(key=lambda e: e[0])
        one, fired = Accumulator(quiet, cooldown, threshold, (last, until, total)), []
        due = [e for e in waiting if e[0] <= seen]
        for a, d in due:
            if f := one.step(a, d):
                fired.append((key_of[0], a, f))
        waiting = waiting[len(due) :]
        over = max(one.last + quiet, one.until)
        if not waiting and over < seen:
            state.remove()
        else:
            state.update((one.last, one.until, one.total, [a for a, _ in waiting], [d for _, d in waiting]))
            wake = waiting[0][0] if waiting else over
            state.setTimeoutTimestamp(int(max(wake, seen) * 1000) + 1)
        yield pd.DataFrame(fired, columns=["key", "at", "fired"])

    renamed = df.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(delta).cast("double").alias("delta")).withWatermark("ts", late)
    renamed = renamed.withColumn("at", F.col("ts").cast("double"))
    found = renamed.groupBy("key").applyInPandasWithState(run, "key bigint, at double, fired int", "last double, until double, total double, at array<double>, delta array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumnRenamed("key", key)
