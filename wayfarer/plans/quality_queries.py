"""Data-quality constraints: V01-V11."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import json_schema as JS
from wayfarer.operators import quality as V
from wayfarer.plans.registry import Tables, query


@query("""SELECT 'unique l_orderkey, l_linenumber' AS rule, l_orderkey || '|' || l_linenumber AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_quality_unique(t: Tables) -> DataFrame:
    return V.unique(t.lineitem, "l_orderkey", "l_linenumber")


@query(
    """SELECT 'references l_partkey' AS rule, l_orderkey::VARCHAR AS key, l_partkey::VARCHAR AS detail FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 97 <> 0)
       UNION ALL SELECT 'references parts', l_orderkey::VARCHAR, p::VARCHAR FROM (SELECT l_orderkey, unnest(list(l_partkey)) AS p FROM lineitem GROUP BY 1) WHERE p NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 89 <> 0)"""
)
def q_quality_references(t: Tables) -> DataFrame:
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return V.violations([
        V.references(t.lineitem, "l_orderkey", "l_partkey", t.part.where("p_partkey % 97 <> 0"), "p_partkey"),
        V.references(lists, "l_orderkey", "parts", t.part.where("p_partkey % 89 <> 0"), "p_partkey"),
    ])


@query(
    """WITH c AS (SELECT c_custkey, nullif(c_custkey % 10, 0) AS lat, nullif(c_custkey % 15, 0) AS lon, c_acctbal FROM customer)
       SELECT 'paired lat, lon' AS rule, c_custkey::VARCHAR AS key, '' AS detail FROM c WHERE (lat IS NULL) <> (lon IS NULL)
       UNION ALL SELECT 'range lat', c_custkey::VARCHAR, lat::VARCHAR FROM c WHERE lat > 7 UNION ALL SELECT 'range lon', c_custkey::VARCHAR, lon::VARCHAR FROM c WHERE lon < 3"""
)
def q_quality_pairs(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.nullif(F.col("c_custkey") % 10, F.lit(0)).alias("lat"), F.nullif(F.col("c_custkey") % 15, F.lit(0)).alias("lon"))
    return V.violations([V.paired(rows, "c_custkey", "lat", "lon"), V.between(rows, "c_custkey", "lat", 0, 7), V.between(rows, "c_custkey", "lon", 3, 99)])


@query(
    """SELECT rule, count(*) AS n FROM (
         SELECT 'vocabulary o_orderstatus' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
         UNION ALL SELECT 'pattern o_orderpriority' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-')
         UNION ALL SELECT 'range o_totalprice' FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 300000
         UNION ALL SELECT 'required o_missing' FROM orders WHERE o_custkey % 13 = 0) GROUP BY 1"""
)
def q_quality_schema(t: Tables) -> DataFrame:
    schema = {
        "required": ["o_orderkey", "o_missing"],
        "properties": {"o_orderstatus": {"enum": ["F", "O"]}, "o_orderpriority": {"pattern": "^[1-4]-"}, "o_totalprice": {"minimum": 1000, "maximum": 300000}},
    }
    rows = t.orders.withColumn("o_missing", F.nullif(F.col("o_custkey") % 13, F.lit(0)))
    return V.summary(V.violations(V.compile_schema(rows, "o_orderkey", schema)))


@query(
    """SELECT 'forbidden url' AS rule, page_id::VARCHAR AS key, url AS detail FROM pages WHERE url LIKE '%cheap-pills%' OR url LIKE '%#top'
       UNION ALL SELECT 'disjoint roles, closed', conv_id::VARCHAR, array_to_string(list_sort(list_intersect(roles, closed)), ',') FROM (
         SELECT conv_id, list(DISTINCT role) FILTER (turn < 2) AS roles, list(DISTINCT role) FILTER (turn >= 6) AS closed FROM conversations GROUP BY 1) WHERE list_has_any(roles, closed)"""
)
def q_quality_forbidden(t: Tables) -> DataFrame:
    sets = t.conversations.groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") < 2, F.col("role"))).alias("roles"), F.collect_set(F.when(F.col("turn") >= 6, F.col("role"))).alias("closed"))
    return V.violations([V.forbidden(t.pages, "page_id", "url", "cheap-pills|#top$"), V.disjoint(sets, "conv_id", "roles", "closed")])


@query(
    """SELECT 'equal c_name, c_acctbal' AS rule, c_custkey::VARCHAR AS key, concat_ws(',', CASE WHEN c_custkey % 10 = 0 THEN 'c_name' END, CASE WHEN c_custkey % 14 = 0 THEN 'c_acctbal' END) AS detail FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 14 = 0"""
)
def q_quality_equal(t: Tables) -> DataFrame:
    other = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 14 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return V.equal(t.customer, other, "c_custkey", ["c_name", "c_acctbal"])


@query(
    """SELECT 'golden' AS rule, 'extra' AS key, '{"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS detail FROM nation WHERE n_regionkey = 4
       UNION ALL SELECT 'golden', 'missing', '{"n_nationkey":99,"n_regionkey":1}'"""
)
def q_quality_golden(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", "n_regionkey")
    extra = t.spark.createDataFrame([(99, 1)], "n_nationkey int, n_regionkey int")
    return V.golden(rows, rows.where("n_regionkey <> 4").union(extra))


@query(
    """SELECT l_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_returnflag <> 'R')
         AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')"""
)
def q_quality_uncovered(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag")
    links = lines.where("l_returnflag <> 'R'")
    mentions = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct()
    return mentions.join(links, ["l_orderkey", "l_partkey"], "left_anti").join(links, "l_orderkey", "left_semi")


@query(
    """WITH e AS (SELECT event_id AS e, event_type AS t, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
       SELECT e AS event_id, '$' AS path, 'json' AS rule, '{broken ' || e AS value FROM e WHERE e % 29 = 0
       UNION ALL SELECT e, '$.id', 'type', '"' || e || '"' FROM e WHERE e % 29 > 0 AND e % 7 = 0
       UNION ALL SELECT e, '$.type', 'enum', '"' || t || '"' FROM e WHERE e % 29 > 0 AND t = 'error'
       UNION ALL SELECT e, '$.props', 'required', NULL FROM e WHERE e % 29 > 0 AND e % 13 = 0
       UNION ALL SELECT e, '$.props.k', 'maximum', k::VARCHAR FROM e WHERE e % 29 > 0 AND e % 13 > 0 AND k > 80
       UNION ALL SELECT e, '$.x', 'additionalProperties', '{"y":1}' FROM e WHERE e % 29 > 0 AND e % 11 = 0
       UNION ALL SELECT e, '$.tags[' || i || ']', 'oneOf', v FROM e, (VALUES (1, '"B"'), (2, '2.5')) x(i, v) WHERE e % 29 > 0 AND e % 5 = 0
       UNION ALL SELECT e, '$.in[0].k', 'minimum', '-1' FROM e WHERE e % 29 > 0 AND e % 3 = 0"""
)
def q_schema_nested(t: Tables) -> DataFrame:
    """Events as nested JSON, some with faults, against a schema with references, items, choices and no other members."""
    schema = {
        "$defs": {"props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 80}}, "additionalProperties": False}},
        "type": "object",
        "required": ["id", "type", "props"],
        "properties": {
            "id": {"type": "integer"},
            "type": {"enum": ["click", "view", "purchase", "signup"]},
            "props": {"$ref": "#/$defs/props"},
            "tags": {"type": "array", "items": {"oneOf": [{"type": "string", "pattern": "^[a-z]+$"}, {"type": "integer"}]}},
            "in": {"items": {"$ref": "#/$defs/props"}},
        },
        "additionalProperties": False,
    }
    e = F.col("event_id")
    s, some = e.cast("string"), lambda n, yes, no="": F.when(e % n == 0, yes).otherwise(no)
    whole = F.concat(
        F.lit('{"id":'), F.when(e % 7 == 0, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s), F.lit(',"type":"'), "event_type", F.lit('"'), F.when(e % 13 > 0, F.concat(F.lit(',"props":'), "props")).otherwise(""),
        some(11, ',"x":{"y":1}'), some(5, ',"tags":["a","B",2.5]', ',"tags":["a",3]'), F.lit(',"in":[{"k":'), some(3, "-1", "1"), F.lit("}]}"),
    )
    text = F.when(e % 29 == 0, F.concat(F.lit("{broken "), s)).otherwise(whole)
    return JS.validate(t.events.select("event_id", text.alias("text")), "event_id", "text", schema)
