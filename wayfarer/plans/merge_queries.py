"""Set operations and merges: X01-X13."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text
from wayfarer.operators import merge as M
from wayfarer.plans.registry import Tables, query


@query(
    """WITH v AS (SELECT 'all' AS view, n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT lower(r_name), n_nationkey, n_name, n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey < 3)
       SELECT 'rows' AS kind, view, n_nationkey, n_name FROM v UNION ALL SELECT 'distinct', min_by(view, CASE WHEN view = 'all' THEN 1 ELSE 0 END), n_nationkey, n_name FROM v GROUP BY n_nationkey, n_name"""
)
def q_view_union(t: Tables) -> DataFrame:
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    by_region = nation.join(t.region.where("r_regionkey < 3"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.lower("r_name").alias("view"), "n_nationkey", "n_name")
    everything = nation.select(F.lit("all").alias("view"), "n_nationkey", "n_name")
    distinct = M.union_distinct([by_region, everything], ["n_nationkey", "n_name"])
    return by_region.unionByName(everything).withColumn("kind", F.lit("rows")).unionByName(distinct.withColumn("kind", F.lit("distinct")))


@query(
    """SELECT coalesce(b.o_orderkey, p.o_orderkey) AS o_orderkey, coalesce(p.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(b.o_orderpriority, p.o_orderpriority) AS o_orderpriority, b.o_totalprice
       FROM (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) b FULL JOIN (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, 'patched' AS o_orderpriority FROM orders WHERE o_orderkey % 6 = 0) p ON b.o_orderkey = p.o_orderkey"""
)
def q_upsert(t: Tables) -> DataFrame:
    base = t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    patch = t.orders.where("o_orderkey % 6 = 0").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.lit("patched").alias("o_orderpriority"))
    return M.upsert(base, patch, "o_orderkey", keep=("o_orderpriority",))


@query(
    """SELECT coalesce(b.o_orderkey, p.o_orderkey) AS o_orderkey, b.o_orderstatus, CASE WHEN p.o_orderkey IS NOT NULL THEN p.x ELSE b.o_orderpriority END AS o_orderpriority,
         CASE WHEN b.o_orderkey IS NOT NULL AND p.o_orderkey IS NOT NULL THEN 'refreshed' WHEN b.o_orderkey IS NOT NULL THEN 'stale' ELSE 'new' END AS state
       FROM (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) b FULL JOIN (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS x FROM orders WHERE o_orderkey % 6 = 0) p ON b.o_orderkey = p.o_orderkey"""
)
def q_refresh(t: Tables) -> DataFrame:
    base = t.orders.where("o_orderkey % 4 <> 0").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    fresh = t.orders.where("o_orderkey % 6 = 0").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderpriority"))
    return M.refresh(base, fresh, "o_orderkey", "o_orderpriority")


@query(
    """WITH l AS (SELECT event_id AS pos, user_id * 3 AS c_custkey, event_type AS status, value AS c_acctbal, 'S' || event_id AS c_mktsegment FROM events),
       b AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM customer),
       g AS (SELECT c_custkey, max_by(c_acctbal, pos) FILTER (status = 'purchase') AS bal, max_by(c_mktsegment, pos) FILTER (status IN ('purchase', 'signup')) AS seg,
               count(*) FILTER (status IN ('purchase', 'signup')) > 0 AS hit, count(*) FILTER (status = 'purchase') > 0 AS balhit, max_by(status = 'error', pos) AS skip FROM l GROUP BY 1)
       SELECT coalesce(b.c_custkey, g.c_custkey) AS c_custkey, CASE WHEN balhit THEN bal ELSE b.c_acctbal END AS c_acctbal, CASE WHEN hit THEN seg ELSE b.c_mktsegment END AS c_mktsegment,
         CASE WHEN b.c_custkey IS NULL THEN 'inserted' WHEN coalesce(hit, false) THEN 'updated' ELSE 'kept' END AS outcome
       FROM b FULL JOIN g ON b.c_custkey = g.c_custkey WHERE b.c_custkey IS NOT NULL OR NOT skip"""
)
def q_ledger(t: Tables) -> DataFrame:
    ledger = t.events.select(F.col("event_id").alias("pos"), (F.col("user_id") * 3).alias("c_custkey"), F.col("event_type").alias("status"), F.col("value").alias("c_acctbal"), F.concat(F.lit("S"), "event_id").alias("c_mktsegment"))
    base = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    writes = {"c_acctbal": F.col("status") == "purchase", "c_mktsegment": F.col("status").isin("purchase", "signup")}
    return M.apply_ledger(base, ledger, "c_custkey", "pos", writes, F.col("status") == "error")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def q_resume(t: Tables) -> DataFrame:
    return M.remaining(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("""SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""")
def q_last_wins(t: Tables) -> DataFrame:
    return M.last_wins(t.events.select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    """SELECT conv_id, array_to_string(list_append(rs, 'system'), ',') AS roles FROM (SELECT conv_id, list_sort(list(DISTINCT role)) AS rs FROM conversations GROUP BY 1) WHERE NOT list_contains(rs, 'system')
       UNION ALL SELECT conv_id, array_to_string(rs, ',') FROM (SELECT conv_id, list_sort(list(DISTINCT role)) AS rs FROM conversations GROUP BY 1) WHERE list_contains(rs, 'system')"""
)
def q_array_append(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    return rows.select("conv_id", F.array_join(M.append_missing(F.col("roles"), F.lit("system"), lambda a, b: a == b), ",").alias("roles"))


@query(
    """SELECT doc_id, sha1(CASE WHEN same THEN old ELSE text END) AS digest, same AS kept FROM (SELECT doc_id, text, replace(text, 'the', '*the*') AS old, doc_id % 3 = 0 AS same FROM documents)"""
)
def q_keep_existing(t: Tables) -> DataFrame:
    new = t.documents.select("doc_id", "text")
    old = t.documents.where("doc_id % 3 = 0").select("doc_id", F.replace(F.col("text"), F.lit("the"), F.lit("*the*")).alias("text"))
    unmarked = lambda x: F.replace(x, F.lit("*"), F.lit(""))
    return M.keep_existing(new, old, "doc_id", "text", unmarked).select("doc_id", F.sha1("text").alias("digest"), "kept")


@query(
    """SELECT DISTINCT p_brand AS name FROM part WHERE p_size > 45 UNION SELECT DISTINCT p_type FROM part WHERE p_size < 5"""
)
def q_distinct_union(t: Tables) -> DataFrame:
    return t.part.where("p_size > 45").select(F.col("p_brand").alias("name")).union(t.part.where("p_size < 5").select("p_type")).distinct()


@query(
    """WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS st, list_sort(list(DISTINCT left(o_orderpriority, 1))) AS pr FROM orders GROUP BY 1)
       SELECT o_custkey, len(list_filter(st, lambda x: NOT list_contains(['F', 'O'], x))) = 0 AS subset, len(list_filter(['F', 'O'], lambda x: NOT list_contains(st, x))) = 0 AS superset, st = ['F', 'O'] AS equal, list_has_any(pr, ['1', '2']) AS overlap FROM s"""
)
def q_set_tests(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("st"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("pr"))
    wanted = F.array(F.lit("F"), F.lit("O"))
    sub, sup = F.size(F.array_except("st", wanted)) == 0, F.size(F.array_except(wanted, "st")) == 0
    return rows.select("o_custkey", sub.alias("subset"), sup.alias("superset"), (sub & sup).alias("equal"), F.arrays_overlap("pr", F.array(F.lit("1"), F.lit("2"))).alias("overlap"))


@query(
    """WITH s AS (SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'place') AS slug FROM part)
       SELECT p_partkey, slug || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS key FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s)"""
)
def q_unique_key(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.part.select("p_partkey", text.slug(F.col("p_name")).alias("slug"))
    k = F.row_number().over(Window.partitionBy("slug").orderBy("p_partkey"))
    return rows.select("p_partkey", F.concat("slug", F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise("")).alias("key"))
