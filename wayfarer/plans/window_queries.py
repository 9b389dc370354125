"""Windows and sorts: W01-W15, O01-O06, O09, G04-G06."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions import geo
from wayfarer.operators import windows as W
from wayfarer.operators.sorting import numbered
from wayfarer.plans.registry import Tables, query

_ORDER = ["ts", "event_id"]


def _masked(t: Tables) -> DataFrame:
    """Events whose value counts as a place only every third time."""
    return t.events.select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("site"))


_MASKED = "(SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 3 <> 0 THEN event_id END AS site FROM events)"


@query(
    f"""SELECT event_id, from_stop, to_stop FROM (SELECT event_id, event_type, lag(site) OVER w AS from_stop, site AS to_stop, lag(event_type) OVER w AS r FROM {_MASKED}
       WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE from_stop IS NOT NULL AND to_stop IS NOT NULL AND r = event_type"""
)
def q_legs_filtered(t: Tables) -> DataFrame:
    return W.legs_filtered(_masked(t), ["user_id"], _ORDER, F.col("event_type") != "error", "site", "event_type").select("event_id", "from_stop", "to_stop")


@query(
    f"""SELECT event_id, from_stop, to_stop FROM (SELECT event_id, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER w AS was, lag(site) OVER w AS from_stop, site AS to_stop FROM {_MASKED}
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE ok AND was AND from_stop IS NOT NULL AND to_stop IS NOT NULL"""
)
def q_legs_raw(t: Tables) -> DataFrame:
    return W.legs_raw(_masked(t), ["user_id"], _ORDER, F.col("event_type") != "error", "site").select("event_id", "from_stop", "to_stop")


@query(
    f"""SELECT event_id, first_value(site IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_site FROM {_MASKED}"""
)
def q_next_mapped(t: Tables) -> DataFrame:
    return _masked(t).select("event_id", W.next_known("site", ["user_id"], _ORDER).alias("next_site"))


@query(
    f"""SELECT event_id, last_value(site IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_site FROM {_MASKED}"""
)
def q_prev_mapped(t: Tables) -> DataFrame:
    return _masked(t).select("event_id", W.previous_known("site", ["user_id"], _ORDER).alias("previous_site"))


@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase FROM events"""
)
def q_carry_forward(t: Tables) -> DataFrame:
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return t.events.select("event_id", W.carried(value, ["user_id"], _ORDER).alias("purchase"))


@query(
    """SELECT event_id, was, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was <> event_type"""
)
def q_change_points(t: Tables) -> DataFrame:
    return W.changes(t.events, ["user_id"], _ORDER, "event_type").select("event_id", "was", "event_type")


_CLUSTERS = """WITH a AS (SELECT {key} AS k, {id} AS id, {hit} AS hit, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS p FROM {table}),
  b AS (SELECT *, max(CASE WHEN hit THEN p END) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM a),
  c AS (SELECT *, sum(CASE WHEN hit AND (l IS NULL OR p - l > 2) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS cluster FROM b)
  SELECT '{table}' AS source, k, id, CAST(p AS INTEGER) AS position, CAST(cluster AS BIGINT) AS cluster FROM c WHERE hit OR p - l <= 1"""


@query(
    "SELECT * FROM ("
    + _CLUSTERS.format(table="conversations", key="conv_id", id="turn", hit="role = 'user'", order="turn, role")
    + ") UNION ALL SELECT * FROM ("
    + _CLUSTERS.format(table="events", key="user_id", id="event_id", hit="event_type = 'error'", order="ts, event_id")
    + ")"
)
def q_clusters(t: Tables) -> DataFrame:
    talk = W.clusters(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn", "role"], F.col("role") == "user")
    events = W.clusters(t.events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], _ORDER, F.col("event_type") == "error")
    named = lambda df, source, k, i: df.select(F.lit(source).alias("source"), F.col(k).alias("k"), F.col(i).alias("id"), "position", "cluster")
    return named(talk, "conversations", "conv_id", "turn").unionByName(named(events, "events", "user_id", "event_id"))


@query(
    """SELECT turn, role, conv_id || chr(CAST(96 + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS INTEGER)) AS id FROM conversations"""
)
def q_letter_ids(t: Tables) -> DataFrame:
    return t.conversations.select("turn", "role", W.letter_id(F.col("conv_id").cast("string"), ["conv_id"], ["turn", "role"]).alias("id"))


@query(
    """SELECT c_custkey, round(CASE WHEN n > 1 THEN 13 * cos(2 * pi() * (p - 1) / n - pi() / 2) ELSE 0 END, 6) + 0.0 AS dx, round(CASE WHEN n > 1 THEN 13 * sin(2 * pi() * (p - 1) / n - pi() / 2) ELSE 0 END, 6) + 0.0 AS dy FROM (
         SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS p, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"""
)
def q_ring(t: Tables) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    spot = geo.ring_offset(F.row_number().over(w.orderBy("c_custkey")) - 1, F.count("*").over(w))
    return t.customer.select("c_custkey", spot.alias("at")).select("c_custkey", (F.round("at.dx", 6) + 0.0).alias("dx"), (F.round("at.dy", 6) + 0.0).alias("dy"))


@query(
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS number, count(*) OVER (PARTITION BY conv_id) AS of,
         coalesce(lead(turn) OVER w, first_value(turn) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next,
         coalesce(lag(turn) OVER w, last_value(turn) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous
       FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)"""
)
def q_wrap(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")).alias("number"), F.count("*").over(Window.partitionBy("conv_id")).alias("of"))
    return W.wrapped_neighbours(rows, ["conv_id"], ["turn", "role"], "turn")


@query("""SELECT conv_id, min(turn) = 0 AND max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY 1""")
def q_contiguous(t: Tables) -> DataFrame:
    return W.contiguous(t.conversations.withColumn("number", F.col("turn") + 1), ["conv_id"], "number")


@query(
    """SELECT doc_id, CAST(i // 4 AS BIGINT) AS bucket, string_agg(line, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY 1, 2"""
)
def q_paragraph_buckets(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return W.buckets(lines, ["doc_id"], ["at"], 4, "line")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
       h AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l WHERE length(line) < 60)
       SELECT h.doc_id, CAST(h.i AS INTEGER) AS header, CAST(coalesce(n, c) - h.i AS BIGINT) AS lines FROM h JOIN (SELECT doc_id, count(*) AS c FROM l GROUP BY 1) USING (doc_id)"""
)
def q_headers(t: Tables) -> DataFrame:
    cut = F.split("text", "\n")
    lines = t.documents.select("doc_id", F.size(cut).alias("n"), F.posexplode(cut).alias("header", "line")).where(F.length("line") < 60)
    end = F.coalesce(F.lead("header").over(Window.partitionBy("doc_id").orderBy("header")), F.col("n"))
    return lines.select("doc_id", "header", (end - F.col("header")).cast("long").alias("lines"))


@query(
    """SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN s IS NULL THEN 1 ELSE 0 END, s, lower(p_brand), p_partkey) AS place FROM (SELECT *, try_cast(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS s FROM part)"""
)
def q_natural_sort(t: Tables) -> DataFrame:
    number = F.try_to_number(F.nullif(F.regexp_extract("p_brand", r"([0-9]+)$", 1), F.lit("")), F.lit("999999999")).cast("long")
    order = [F.coalesce(number, F.lit(2**62)), F.lower("p_brand"), F.col("p_partkey")]
    return numbered(t.part.select("p_partkey", "p_brand"), order, "place").select("p_partkey", "place")


@query(
    """SELECT s_suppkey, row_number() OVER (ORDER BY coalesce(nullif(s_nationkey % 7, 0), 9999), s_suppkey) AS sentinel, row_number() OVER (ORDER BY nullif(s_nationkey % 7, 0) DESC NULLS LAST, s_suppkey) AS nulls_last,
         row_number() OVER (ORDER BY len(string_split(s_name, '0')) DESC, length(s_name) DESC, s_name, s_suppkey) AS longest, row_number() OVER (ORDER BY coalesce(list_position([3, 1, 2], s_nationkey % 5), 99), s_suppkey) AS enumerated FROM supplier"""
)
def q_sort_orders(t: Tables) -> DataFrame:
    key = F.nullif(F.col("s_nationkey") % 7, F.lit(0))
    place = F.array_position(F.array(F.lit(3), F.lit(1), F.lit(2)), F.col("s_nationkey") % 5)
    orders = {
        "sentinel": [F.coalesce(key, F.lit(9999))],
        "nulls_last": [-F.coalesce(key, F.lit(-1))],
        "longest": [-F.size(F.split("s_name", "0")), -F.length("s_name"), F.col("s_name")],
        "enumerated": [F.when(place > 0, place).otherwise(99)],
    }
    rows = t.supplier.select("s_suppkey", "s_nationkey", "s_name")
    for name, by in orders.items():
        rows = numbered(rows, [*by, F.col("s_suppkey")], name)
    return rows.select("s_suppkey", *orders)


@query(
    """SELECT conv_id, string_agg(role || ':' || turn, ', ' ORDER BY score DESC, turn, role) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, role) AS k FROM (
         SELECT conv_id, turn, role, length(text) - length(replace(text, 'the', '')) AS score FROM conversations) WHERE score > 0) WHERE k <= 2 GROUP BY 1"""
)
def q_heuristic_top2(t: Tables) -> DataFrame:
    score = F.length("text") - F.length(F.replace(F.col("text"), F.lit("the"), F.lit("")))
    rows = t.conversations.select("conv_id", "turn", "role", score.alias("score")).where("score > 0")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "turn", "role"))), 1, 2)
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(best, lambda r: F.concat(r["role"], F.lit(":"), r["turn"].cast("string"))), ", ").alias("best"))


@query(
    """SELECT o_custkey, o_orderkey AS from_stop, nxt AS to_stop, CAST(k AS INTEGER) AS number, lon BETWEEN 5 AND 85 AND lat BETWEEN 5 AND 45 AS in_frame FROM (
         SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS nxt, row_number() OVER w AS k, o_orderkey % 100 AS lon, o_orderkey % 60 AS lat FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE nxt IS NOT NULL"""
)
def q_edges(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("from_stop"), F.lead("o_orderkey").over(w).alias("to_stop"), F.row_number().over(w).alias("number"), (F.col("o_orderkey") % 100).alias("lon"), (F.col("o_orderkey") % 60).alias("lat"))
    return rows.where("to_stop IS NOT NULL").select("o_custkey", "from_stop", "to_stop", "number", geo.in_frame(F.col("lat"), F.col("lon"), (5, 45), (5, 85)).alias("in_frame"))
