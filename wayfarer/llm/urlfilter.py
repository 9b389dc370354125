"""URL filters as a temporal list join, in DataFrame operations only.

A block list is a history: dated entries that add a value or take it away.
``intervals`` turns the entries of each value into the spans of time in which
it is listed.  ``evaluate`` derives from every captured URL all values that
could list it (its host and parent domains, and its path prefixes), joins them
to the intervals by value, and keeps what was active when the capture was
fetched: the as-of join of captures and list.

The list is broadcast only if it was counted and has at most ``BROADCAST_ROWS``
entries; a longer one is joined by shuffle, where adaptive execution splits
values that many captures share.  Matches are added up per capture before and
after the shuffle.

Edge cases: a null or unparsable URL has no host and is never blocked; a capture
without a fetch time matches nothing; entries of a value on the same day apply
in the order add, remove; repeated entries change nothing; rows that repeat are
evaluated each; with an empty list nothing is blocked; columns of the captures
stay, but for those named as the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000

# The entries of the registered query, as (list, kind, value, action, day).
ENTRIES = [
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-01-15"),
    ("spam", "domain", "cheap-pills.example.com", "remove", "2024-06-01"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2024-09-01"),
    ("spam", "domain", "ththan.example.net", "add", "2024-03-01"),
    ("adult", "domain", "tionsh.example.net", "add", "2024-02-01"),
    ("adult", "domain", "tionsh.example.net", "remove", "2024-08-15"),
    ("adult", "prefix", "ththre.example.com/fr/", "add", "2024-04-01"),
    ("optout", "domain", "example.org", "add", "2024-05-01"),
    ("optout", "domain", "example.org", "remove", "2024-07-01"),
    ("optout", "prefix", "thther.example.org/en/", "add", "2024-01-01"),
    ("optout", "domain", "m.ththth.example.net", "add", "2024-10-01"),
]


def list_entries(spark, entries: list[tuple] = ENTRIES) -> DataFrame:
    """Dated entries as a DataFrame: list, kind (domain or prefix), value, action (add or remove), day."""
    return spark.createDataFrame(entries, "list string, kind string, value string, action string, day string").withColumn("day", F.to_date("day"))


def intervals(entries: DataFrame) -> DataFrame:
    """``list``, ``kind``, ``value``, ``since`` and ``until`` (not included; null: still listed)."""
    order = Window.partitionBy("list", "kind", "value").orderBy("day", "action")
    until = F.lead("day").over(order)
    return entries.select("list", "kind", "value", F.col("day").alias("since"), until.alias("until"), "action").where("action = 'add' AND (until IS NULL OR until > since)").drop("action")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with ``host``, ``blocked``, ``lists`` (sorted, comma-joined) and ``n_entries`` active and matching."""
    active = intervals(entries).select(F.concat_ws(":", "kind", "value").alias("_value"), F.col("list").alias("_list"), F.col("since").alias("_since"), F.col("until").alias("_until"))
    if entries.count() <= BROADCAST_ROWS:
        active = F.broadcast(active)
    kept = captures.drop("host", "blocked", "lists", "n_entries")
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    labels, segments = F.split("_host", r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(F.lit("prefix:"), F.col("_host"), F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/")))
    # a prefix ends at a slash, or is the whole path
    candidates = F.when(F.col("_host") != "", F.array_distinct(F.concat(domains, prefixes, F.array(F.concat(F.lit("prefix:"), F.col("_host"), path)))))
    rows = kept.withColumn("_row", F.monotonically_increasing_id()).withColumn("_host", host)
    asked = rows.select("*", F.explode_outer(candidates).alias("_candidate"))
    then = (F.col(fetched) >= F.col("_since")) & (F.col("_until").isNull() | (F.col(fetched) < F.col("_until")))
    matched = asked.join(active, (F.col("_candidate") == F.col("_value")) & then, "left").drop("_candidate", "_value", "_since", "_until")
    same = [F.col(c) for c in rows.columns]
    found = matched.groupBy(*same).agg(F.collect_set("_list").alias("_lists"), F.count("_list").alias("_active"))
    return found.select(*kept.columns, F.col("_host").alias("host"), (F.col("_active") > 0).alias("blocked"), F.array_join(F.array_sort("_lists"), ",").alias("lists"), F.col("_active").alias("n_entries"))


SQL = """
WITH e AS (SELECT * FROM (VALUES %s) AS t(list, kind, value, action, day)),
i AS (
  SELECT list, kind, value, action, CAST(day AS DATE) AS since,
         lead(CAST(day AS DATE)) OVER (PARTITION BY list, kind, value ORDER BY day, action) AS until FROM e
),
c AS (
  SELECT page_id, url, date '2024-01-01' + CAST(page_id %% 366 AS INTEGER) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]*)', 2)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
m AS (
  SELECT c.page_id, i.list FROM c JOIN i
    ON i.action = 'add' AND c.fetched >= i.since AND (i.until IS NULL OR c.fetched < i.until)
   AND CASE WHEN i.kind = 'domain' THEN c.host = i.value OR ends_with(c.host, '.' || i.value)
            ELSE c.host || c.path = i.value OR (ends_with(i.value, '/') AND starts_with(c.host || c.path || '/', i.value)) END
)
SELECT c.page_id, c.url, CAST(CAST(c.fetched AS DATE) AS VARCHAR) AS fetched, c.host, count(m.list) > 0 AS blocked,
       coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists, CAST(count(m.list) AS BIGINT) AS n_entries
FROM c LEFT JOIN m ON m.page_id = c.page_id GROUP BY ALL
""" % ", ".join(str(x) for x in ENTRIES)
