"""Aggregations: A01-A20."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import aggregates as A
from wayfarer.plans.registry import Tables, query


@query(
    """SELECT 'event' AS kind, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2
       UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2 HAVING count(*) >= 3"""
)
def q_sorted_counter(t: Tables) -> DataFrame:
    named = lambda df, kind, key, least=1: A.counter(df, key, least=least).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "n")
    return named(t.events, "event", "event_type").unionByName(named(t.documents, "lang", "lang")).unionByName(named(t.documents, "source", "source", 3))


@query(
    """SELECT l_partkey, min_by(l_shipdate, (l_orderkey, l_linenumber, l_suppkey, l_shipdate))::DATE::VARCHAR AS first_ship, bool_or(l_returnflag = 'R') AS any_returned, bool_or(o_orderstatus = 'P') AS any_partial,
              sum(l_quantity) AS quantity, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"""
)
def q_rollup_flags(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity")
    rows = lines.join(t.orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("l_partkey").agg(
        F.min_by("l_shipdate", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")).cast("date").cast("string").alias("first_ship"),
        F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("any_partial"),
        F.sum("l_quantity").alias("quantity"),
        F.count("*").alias("n"),
    )


@query(
    """SELECT user_id, coalesce(max_by(event_type, (n, -p)), 'none') AS dominant FROM (
         SELECT user_id, event_type, count(event_type) AS n, coalesce(list_position(['purchase', 'signup', 'click'], event_type), 4) AS p
         FROM (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN event_type END AS event_type FROM events) GROUP BY 1, 2) GROUP BY 1"""
)
def q_dominant(t: Tables) -> DataFrame:
    known = t.events.withColumn("event_type", F.when(F.col("event_type").isin("purchase", "signup", "click"), F.col("event_type")))
    return A.dominant(known, "user_id", "event_type", ["purchase", "signup", "click"], "none")


@query(
    """WITH b(bucket, place) AS (VALUES ('null', 0), ('zero', 1), ('<=0.01', 2), ('<=0.05', 3), ('<=0.09', 4), ('>0.09', 5)),
       v AS (SELECT CASE WHEN x IS NULL THEN 'null' WHEN x = 0 THEN 'zero' WHEN x <= 0.01 THEN '<=0.01' WHEN x <= 0.05 THEN '<=0.05' WHEN x <= 0.09 THEN '<=0.09' ELSE '>0.09' END AS bucket FROM (SELECT nullif(l_discount, 0.07) AS x FROM lineitem))
       SELECT b.bucket, CAST(b.place AS INTEGER) AS place, count(v.bucket) AS n FROM b LEFT JOIN v USING (bucket) GROUP BY 1, 2"""
)
def q_histogram(t: Tables) -> DataFrame:
    return A.histogram(t.lineitem.select(F.nullif("l_discount", F.lit(0.07)).alias("x")), F.col("x"), [0.01, 0.05, 0.09])


@query(
    """SELECT conv_id, min_by(p, (p, l)) AS first_page, min_by(l, (p, l)) AS first_line, max_by(p, (p, l)) AS last_page, max_by(l, (p, l)) AS last_line
       FROM (SELECT conv_id, turn // 3 AS p, length(text) AS l FROM conversations) GROUP BY 1"""
)
def q_span_minmax(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", F.floor(F.col("turn") / 3).alias("p"), F.length("text").cast("long").alias("l"))
    return rows.groupBy("conv_id").agg(*A.span(("p", "l"), ("p", "l")))


@query(
    """SELECT label, round(min(x), 5) AS min_x, round(max(x), 5) AS max_x, round(min(y), 5) AS min_y, round(max(y), 5) AS max_y,
         round(greatest(1.0, least(4.2, 2.0 / greatest(max(x) - min(x), max(y) - min(y)))), 5) AS scale
       FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings) GROUP BY 1"""
)
def q_bbox(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    width = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    scale = F.greatest(F.lit(1.0), F.least(F.lit(4.2), 2.0 / width))
    return rows.groupBy("label").agg(*[F.round(f(c), 5).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))], F.round(scale, 5).alias("scale"))


_VOTES = """SELECT user_id, day, event_type AS v, round(value % 1.0, 3) AS c, CASE WHEN event_id % 7 = 0 THEN 'late' WHEN event_id % 5 = 0 THEN 'thin' END AS w, k
  FROM (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events) WHERE k <= 3"""


@query(
    f"""WITH h AS ({_VOTES}), g AS (SELECT user_id, day, list(v ORDER BY k) AS vs FROM h GROUP BY 1, 2),
       u AS (SELECT h.* FROM h JOIN g USING (user_id, day) WHERE NOT coalesce(vs[1] = vs[2], false) OR k <= 2),
       m AS (SELECT user_id, day, v, count(*) AS n, round(sum(c) / count(*), 3) AS c FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 2)
       SELECT g.user_id, g.day, coalesce(m.v, 'uncertain') AS decision, CASE WHEN coalesce(vs[1] = vs[2], false) THEN 'two' WHEN m.v IS NOT NULL THEN 'majority' ELSE 'none' END AS method, m.c AS confidence,
         coalesce((SELECT list_sort(list(DISTINCT w)) FROM u WHERE u.user_id = g.user_id AND u.day = g.day AND w IS NOT NULL), []) AS warnings
       FROM g LEFT JOIN m ON m.user_id = g.user_id AND m.day = g.day"""
)
def q_consensus(t: Tables) -> DataFrame:
    votes = t.events.select("user_id", F.col("ts").cast("date").cast("string").alias("day"), "ts", "event_id", F.col("event_type").alias("v"), F.round(F.col("value") % 1.0, 3).alias("c"), F.when(F.col("event_id") % 7 == 0, "late").when(F.col("event_id") % 5 == 0, "thin").alias("w"))
    return A.consensus(votes, ["user_id", "day"], ["ts", "event_id"], "v", "c", "w")


@query(
    """SELECT l_orderkey, list_distinct_ordered AS parts, array_to_string(list_sort(list_distinct(flags)), ' / ') AS flags, n FROM (
         SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ps, list(l_returnflag) AS flags, count(*) AS n,
           list_filter(list(l_partkey ORDER BY l_linenumber, l_partkey), lambda x, i: list_position(list(l_partkey ORDER BY l_linenumber, l_partkey), x) = i) AS list_distinct_ordered FROM lineitem GROUP BY 1)"""
)
def q_ordered_groups(t: Tables) -> DataFrame:
    flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), " / ").alias("flags")
    return t.lineitem.groupBy("l_orderkey").agg(A.ordered_list(["l_linenumber", "l_partkey"], "l_partkey").alias("parts"), flags, F.count("*").alias("n"))


@query(
    """SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS dear, count(*) FILTER (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AS high,
         count(DISTINCT o_custkey) AS customers, count(*) FILTER (nullif(o_custkey % 11, 0) IS NULL) AS unmapped FROM orders GROUP BY 1 HAVING count(*) > 10"""
)
def q_counts(t: Tables) -> DataFrame:
    return (
        t.orders.groupBy("o_orderstatus")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("o_totalprice") > 200000).alias("dear"),
            F.count_if(F.col("o_orderpriority").rlike("^[12]")).alias("high"),
            F.count_distinct("o_custkey").alias("customers"),
            F.count_if(F.nullif(F.col("o_custkey") % 11, F.lit(0)).isNull()).alias("unmapped"),
        )
        .where("n > 10")
    )


@query(
    """SELECT label, list_sort(list(DISTINCT p_partkey)) AS ids FROM (VALUES ('tin', 'tin'), ('red', 'red'), ('red', 'rose'), ('none', 'zzz')) v(label, word)
       JOIN part ON list_contains(string_split(lower(p_name), ' '), word) GROUP BY 1"""
)
def q_spot_check(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("tin", "tin"), ("red", "red"), ("red", "rose"), ("none", "zzz")], "label string, word string")
    words = t.part.select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return words.join(F.broadcast(wanted), "word").groupBy("label").agg(F.array_sort(F.collect_set("p_partkey")).alias("ids"))


@query(
    """SELECT 'labels_only' AS side, count(*) AS n FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')
       UNION ALL SELECT 'documents_only', count(*) FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def q_difference_counts(t: Tables) -> DataFrame:
    a, b = t.labels.where("toxic = 1").select("doc_id"), t.documents.where("lang = 'en'").select("doc_id")
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "labels_only").otherwise("documents_only").alias("side")
    joined = a.distinct().withColumn("a", F.lit(True)).join(b.distinct().withColumn("b", F.lit(True)), "doc_id", "full").fillna(False)
    return joined.groupBy(side).agg(F.count("*").alias("n")).where("side <> 'both'")


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, count(*) AS n, bool_or(l_discount > 0.05) AS broad, bool_or(l_tax = 0) AS uncertain, list(l_linenumber ORDER BY l_linenumber) AS line_numbers
       FROM lineitem GROUP BY 1, 2, 3, 4, 5"""
)
def q_composite_groups(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    return t.lineitem.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_or(F.col("l_discount") > 0.05).alias("broad"), F.bool_or(F.col("l_tax") == 0).alias("uncertain"), F.array_sort(F.collect_list("l_linenumber")).alias("line_numbers"))


@query(
    """SELECT c_nationkey, string_agg(c_mktsegment || ':' || n, ', ' ORDER BY n DESC, c_mktsegment) AS segments FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1"""
)
def q_nested_counts(t: Tables) -> DataFrame:
    counts = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "c_mktsegment", "n")))
    return counts.groupBy("c_nationkey").agg(F.array_join(F.transform(rows, lambda r: F.concat(r["c_mktsegment"], F.lit(":"), r["n"].cast("string"))), ", ").alias("segments"))
