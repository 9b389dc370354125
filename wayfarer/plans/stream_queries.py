"""Batch forms of the event streams: D01-D06."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.plans.registry import Tables, query
from wayfarer.streaming import inputs


@query("""SELECT user_id, ts, event_id FROM (SELECT *, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch(ts) AS gap FROM events) WHERE gap IS NULL OR gap > 7200""")
def q_debounce(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return inputs.settled(rows, "user_id", "ts", 7200).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT user_id, max_by(event_id, ts) AS event_id, count(*) AS updates FROM events GROUP BY user_id, CAST(ts AS DATE)""")
def q_coalesce(t: Tables) -> DataFrame:
    return inputs.coalesced(t.events, "user_id", "ts", "event_id", "1 day").drop("frame")


@query(
    """WITH g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS gesture FROM (
         SELECT user_id, ts, value AS dx, (event_id % 100)::DOUBLE AS dy, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events)),
       s AS (SELECT user_id, gesture, min_by(abs(dx) >= abs(dy), ts) AS flat, sum(dx) AS x, sum(dy) AS y, count(*) AS moves FROM g GROUP BY 1, 2)
       SELECT user_id, CAST(gesture AS BIGINT) AS gesture, moves, CASE WHEN flat THEN 'x' ELSE 'y' END AS axis, abs(CASE WHEN flat THEN x ELSE y END) >= 200 AS fires FROM s"""
)
def q_gestures(t: Tables) -> DataFrame:
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return inputs.gestures(rows, "user_id", "ts", F.col("value"), (F.col("event_id") % 100).cast("double"), 86400, 200)


@query("""SELECT p_partkey, (SELECT max(n_nationkey) FROM nation WHERE n_nationkey * 2 <= p_size) AS n_nationkey FROM part""")
def q_active_index(t: Tables) -> DataFrame:
    """The last of the nations' marks at or above the line of each part."""
    marks = t.nation.select((F.col("n_nationkey") * 2).alias("mark"), "n_nationkey")
    return inputs.active(t.part.select("p_partkey", "p_size"), marks, "p_size", "mark", "n_nationkey").select("p_partkey", "n_nationkey")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS hit FROM events""")
def q_cache_hits(t: Tables) -> DataFrame:
    keyed = t.events.withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return inputs.cached(keyed, "key", ["ts", "event_id"]).select("event_id", "hit")


@query()
def q_accumulate_fire(t: Tables) -> DataFrame:
    """Sums of values that pass a threshold; held against a plain loop in the tests."""
    return inputs.fires(t.events, "user_id", "ts", "value", 2 * 86400, 86400, 150).withColumn("ts", F.col("ts").cast("string"))
