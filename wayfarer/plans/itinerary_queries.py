"""Itineraries: J11, J20, W06, T07, T11, G05, F24, F35."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.operators import itinerary as I
from wayfarer.plans.registry import Tables, query


@query(
    """WITH s AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN event_id END AS d, event_id % 3 <> 0 AS md, CASE WHEN event_type IN ('click', 'view') AND event_id % 4 <> 0 THEN event_id END AS m, CASE WHEN event_type = 'error' THEN -event_id END AS g FROM events),
       c AS (SELECT *, CASE WHEN d IS NOT NULL THEN CASE WHEN md THEN d END ELSE m END AS onmap FROM s)
       SELECT event_id, coalesce(d, m, last_value(onmap IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g) AS focus FROM c"""
)
def q_focus(t: Tables) -> DataFrame:
    """Events as sections: purchases as destinations, clicks as mapped places, errors as new ones."""
    e, kind = F.col("event_id"), F.col("event_type")
    rows = t.events.select("user_id", "event_id", "event_type").withColumn("mapped_destination", e % 3 != 0)
    found = I.focus(rows, ["user_id"], "event_id", F.when(kind == "purchase", e), F.when(kind.isin("click", "view") & (e % 4 != 0), e), F.when(kind == "error", -e))
    return found.select("event_id", "focus")


@query(
    """SELECT o_custkey, CAST(k AS INTEGER) AS focus_order, 'section_' || lpad(o_custkey::VARCHAR, 4, '0') || '_focus_' || lpad(k::VARCHAR, 2, '0') AS focus_id, o_orderpriority, o_orderpriority IN ('1-URGENT', '3-MEDIUM') AS has_site
       FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_custkey BETWEEN 5 AND 5000)"""
)
def q_visits(t: Tables) -> DataFrame:
    """Customers as sections, their orders as reviewed items, two priorities as the view's sites."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda r: r["o_orderpriority"])
    reviews = t.orders.groupBy("o_custkey").agg(items.alias("items"))
    sites = t.orders.select("o_orderpriority").distinct().where("o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
    return I.visits(reviews, "o_custkey", "items", sites, "o_orderpriority", 5, 5000)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_name FROM lineitem JOIN part ON l_partkey || '.' || l_suppkey % 3 = p_partkey || '.' || p_size % 3""")
def q_path_join(t: Tables) -> DataFrame:
    """Entries and chapters met by their path."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", I.path_key(F.col("l_partkey"), F.col("l_suppkey") % 3).alias("path"))
    return lines.join(t.part.select("p_name", I.path_key(F.col("p_partkey"), F.col("p_size") % 3).alias("path")), "path").drop("path")


@query("""SELECT s_suppkey, s_name, '' AS decision, '' AS reviewer FROM supplier""")
def q_review_queue(t: Tables) -> DataFrame:
    return I.review_queue(t.supplier.select("s_suppkey", "s_name"), ["decision", "reviewer"])


@query("""SELECT n_regionkey, to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name} ORDER BY n_nationkey))::VARCHAR AS nations FROM nation GROUP BY 1""")
def q_nested(t: Tables) -> DataFrame:
    """Nations below their regions again."""
    return I.nested(t.nation, "n_regionkey", ["n_nationkey", "n_name"], "nations", ["n_nationkey"]).select("n_regionkey", F.to_json("nations").alias("nations"))


@query("""SELECT c_custkey, '[' || c_custkey || ',' || array_to_string(path, ',') || ']' AS path FROM customer JOIN (SELECT n_nationkey, [n_regionkey * 1000, n_regionkey * 1000 + n_nationkey] AS path FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey""")
def q_converging(t: Tables) -> DataFrame:
    r = F.col("n_regionkey").cast("long") * 1000
    corridors = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.array(r, r + F.col("n_nationkey")).alias("path"))
    found = I.converging(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", F.col("c_custkey"), corridors, "path")
    return found.select("c_custkey", F.to_json("path").alias("path"))


@query("""SELECT item_id, array_to_string(list_filter(string_split_regex(regexp_extract(text, '^([^.:]*)', 1), '\\s+'), lambda w: w <> '')[1:4], ' ') AS lemma FROM benchmark WHERE NOT regexp_matches(text, '^\\s*[0-9\\[]') AND NOT regexp_matches(regexp_extract(text, '^([^.:]*)', 1), '[\\[\\],;·.]')""")
def q_derived_lemma(t: Tables) -> DataFrame:
    """What items are about: those that begin with no number or bracket, and whose first words hold no other stop."""
    first = F.regexp_extract("text", "^([^.:]*)", 1)
    rows = t.benchmark.where(~F.col("text").rlike(r"^\s*[0-9\[]") & ~first.rlike(r"[\[\],;·.]"))
    return rows.select("item_id", X.derive_lemma(F.col("text")).alias("lemma"))


@query("""SELECT DISTINCT event_type, upper(substr(replace(event_type, '_', ' '), 1, 1)) || substr(replace(event_type, '_', ' '), 2) AS label, replace(replace('a ' || event_type || '&b', ' ', '%20'), '&', '%26') AS query FROM events""")
def q_human_labels(t: Tables) -> DataFrame:
    x = F.col("event_type")
    return t.events.select(x, X.human(x).alias("label"), X.query_escape(F.concat(F.lit("a "), x, F.lit("&b"))).alias("query")).distinct()
