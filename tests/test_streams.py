"""Streams over several batches, with late rows, against their batch forms."""

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.streaming import inputs

START = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "user bigint, ts timestamp, value double"


def batches(seed):
    """Events of four users in six batches, each a few seconds out of order; then one event far later, that lets all others pass."""
    rng = np.random.default_rng(seed)
    at = np.sort(rng.uniform(0, 600, 160)).round(3) + np.arange(160) * 1e-3
    rows = [(int(rng.integers(4)), START + timedelta(seconds=float(a)), float(np.round(rng.normal(0, 40)))) for a in at]
    order = np.argsort(at + rng.uniform(0, 8, len(at)))
    rows = [rows[i] for i in order]
    cut = [rows[i : i + 32] for i in range(0, 160, 32)]
    return rows, [*cut, [(9, START + timedelta(days=2), 0.0)], [(9, START + timedelta(days=4), 0.0)]]


def streamed(spark, tmp_path, parts, build):
    """The rows that a stream yields when each part is one batch, and its progress reports."""
    source = f"file://{tmp_path}/in"
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    name = f"out_{abs(hash(tmp_path))}"
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    run = build(df).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert run.exception() is None
    return [tuple(r) for r in spark.table(name).collect()], run.recentProgress


def test_fires_of_a_stream_equal_the_batch_and_leave_no_state(spark, tmp_path):
    rows, parts = batches(1)
    late = (0, START + timedelta(seconds=1), 1000.0)  # long passed by the watermark when it comes
    parts[4] = [*parts[4], late]
    got, progress = streamed(spark, tmp_path, parts, lambda df: inputs.fires_stream(df, "user", "ts", "value", 20, 15, 60, "20 seconds"))
    expected = inputs.fires(spark.createDataFrame(rows, SCHEMA), "user", "ts", "value", 20, 15, 60)
    expected = [(r.user, r.ts.timestamp(), r.fired) for r in expected.collect()]
    assert len(expected) > 10
    assert sorted((u, round(a, 3), f) for u, a, f in got) == sorted((u, round(a, 3), f) for u, a, f in expected)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 1  # the last event's own key


def test_debounce_of_a_stream_equals_the_batch(spark, tmp_path):
    rows, parts = batches(2)
    got, _ = streamed(spark, tmp_path, parts, lambda df: inputs.settled_stream(df, "user", "ts", "value", "9 seconds", "20 seconds"))
    expected = [tuple(r) for r in inputs.settled(spark.createDataFrame(rows, SCHEMA), "user", "ts", 9).select("user", "value", "ts").collect()]
    assert len(expected) > 10
    assert sorted(g for g in got if g[0] != 9) == sorted(expected)


def test_coalescing_of_a_stream_equals_the_batch(spark, tmp_path):
    rows, parts = batches(3)
    build = lambda df: inputs.coalesced(df, "user", "ts", "value", "10 seconds").select("user", "value", "updates")
    got, _ = streamed(spark, tmp_path, parts, lambda df: build(df.withWatermark("ts", "20 seconds")))
    expected = [tuple(r) for r in build(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(g for g in got if g[0] != 9) == sorted(expected)
