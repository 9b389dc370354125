"""Joins: J01-J26."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.operators import joins
from wayfarer.operators.nearest import nearest
from wayfarer.plans.registry import Tables, query


def _words():
    return F.split(F.lower("p_name"), " ")


@query(
    """SELECT word AS term, list_sort(list(DISTINCT p_partkey)) AS ids FROM
       (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word HAVING count(DISTINCT p_partkey) > 1"""
)
def q_inverted_index(t: Tables) -> DataFrame:
    return joins.inverted_index(t.part, _words(), "p_partkey").where(F.size("ids") > 1)


@query(
    """SELECT term, p_partkey, CAST(pos AS INTEGER) AS pos FROM (
         SELECT term, p_partkey, pos, row_number() OVER (PARTITION BY term ORDER BY p_partkey, pos) AS k FROM (
           SELECT p_partkey, string_split(lower(p_name), ' ')[i + 1] AS term, i AS pos
           FROM (SELECT *, unnest(range(0, len(string_split(lower(p_name), ' ')))) AS i FROM part))) WHERE k = 1"""
)
def q_first_wins_index(t: Tables) -> DataFrame:
    return joins.first_wins_index(t.part, _words(), "p_partkey")


@query(
    """SELECT a.l_partkey, a.k, a.l_orderkey, a.l_linenumber, a.l_quantity, b.s_suppkey FROM
       (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem) a
       JOIN (SELECT s_suppkey, s_suppkey % 50 + 1 AS l_partkey, row_number() OVER (PARTITION BY s_suppkey % 50 ORDER BY s_acctbal, s_suppkey) AS k FROM supplier) b
       ON a.l_partkey = b.l_partkey AND a.k = b.k"""
)
def q_kth_occurrence(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    offers = t.supplier.select("s_suppkey", "s_acctbal", (F.col("s_suppkey") % 50 + 1).alias("l_partkey"))
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return joins.kth_occurrence(lines, offers, "l_partkey", order, ["s_acctbal", "s_suppkey"]).select("l_partkey", "k", "l_orderkey", "l_linenumber", "l_quantity", "s_suppkey")


@query(
    """WITH a(alias, canonical) AS (VALUES ('AUTOMOBILE', 'VEHICLE'), ('MACHINERY', 'VEHICLE'), ('auto', 'VEHICLE'))
       SELECT name, count(*) AS n, sum(c_acctbal) AS balance FROM (
         SELECT coalesce(a.canonical, c_mktsegment) AS name, c_acctbal FROM customer LEFT JOIN a ON a.alias = c_mktsegment)
       JOIN (SELECT DISTINCT coalesce(a.canonical, label) AS name FROM (VALUES ('auto'), ('BUILDING'), ('FURNITURE')) l(label) LEFT JOIN a ON a.alias = label) USING (name)
       GROUP BY name"""
)
def q_alias_join(t: Tables) -> DataFrame:
    aliases = t.spark.createDataFrame([("AUTOMOBILE", "VEHICLE"), ("MACHINERY", "VEHICLE"), ("auto", "VEHICLE")], "alias string, canonical string")
    wanted = t.spark.createDataFrame([("auto",), ("BUILDING",), ("FURNITURE",)], "label string")
    joined = joins.alias_join(t.customer, wanted, "c_mktsegment", "label", aliases)
    return joined.groupBy("name").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))


@query(
    """SELECT c_custkey, coalesce(s.bal, c_acctbal) AS c_acctbal, CASE WHEN s.k IS NOT NULL THEN 'supplier' ELSE 'own' END AS source
       FROM customer LEFT JOIN (SELECT s_suppkey * 3 AS k, nullif(s_acctbal, round(s_acctbal, 0)) AS bal FROM supplier) s ON s.k = c_custkey"""
)
def q_override_join(t: Tables) -> DataFrame:
    new = t.supplier.select((F.col("s_suppkey") * 3).alias("c_custkey"), F.nullif("s_acctbal", F.round("s_acctbal", 0)).alias("c_acctbal"))
    return joins.override(t.customer.select("c_custkey", "c_acctbal"), new, "c_custkey", ["c_acctbal"], "supplier")


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, max(CAST(o_orderstatus = 'F' AS INT)) OVER (PARTITION BY o_custkey) AS any_f FROM orders)
       WHERE o_orderstatus = 'F' OR any_f = 0"""
)
def q_fallback_filter(t: Tables) -> DataFrame:
    return joins.narrow_or_all(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", F.col("o_orderstatus") == "F")


@query(
    """WITH b AS (SELECT p_brand, max(p_size) AS v FROM part WHERE p_brand LIKE '%1' GROUP BY 1), ty AS (SELECT p_type, min(p_size) AS v FROM part WHERE p_type LIKE 'S%' GROUP BY 1),
       s AS (SELECT DISTINCT p_size, p_size * 100 AS v FROM part WHERE p_size % 2 = 0)
       SELECT p_partkey, coalesce(b.v, ty.v, s.v) AS value, CASE WHEN b.v IS NOT NULL THEN 'brand' WHEN ty.v IS NOT NULL THEN 'type' WHEN s.v IS NOT NULL THEN 'size' END AS match_type
       FROM part LEFT JOIN b USING (p_brand) LEFT JOIN ty USING (p_type) LEFT JOIN s USING (p_size)"""
)
def q_cascade(t: Tables) -> DataFrame:
    part = t.part
    brand = part.where("p_brand LIKE '%1'").groupBy("p_brand").agg(F.max("p_size").alias("value"))
    kind = part.where("p_type LIKE 'S%'").groupBy("p_type").agg(F.min("p_size").alias("value"))
    size = part.where("p_size % 2 = 0").select("p_size", (F.col("p_size") * 100).alias("value")).distinct()
    return joins.cascade(part, [("brand", "p_brand", brand), ("type", "p_type", kind), ("size", "p_size", size)], "value").select("p_partkey", "value", "match_type")


_SIMILAR = "1 - levenshtein(label, name) / greatest(length(label), length(name))"


def _match_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Names of parts as labels; kinds of parts, each with the names of its parts and short forms of them, as points."""
    name = X.fold_alnum(F.col("p_name"))
    labels = t.part.select(name.alias("label")).distinct()
    variants = F.array(F.concat(F.lower("p_type"), F.lit(" "), name), F.substr(name, F.lit(1), F.length(name) - 2), F.substr(name, F.lit(1), F.lit(3)))
    points = t.part.select(F.crc32("p_type").alias("point"), F.explode(variants).alias("name")).withColumn("name", X.fold_alnum(F.col("name"))).distinct()
    return labels, points


@query(
    f"""WITH l AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^0-9a-z]+', ' ', 'g')) AS label, p_type FROM part),
       n AS (SELECT DISTINCT p_type, trim(name) AS name FROM (SELECT p_type, unnest([lower(p_type) || ' ' || label, substr(label, 1, CAST(length(label) - 2 AS INTEGER)), substr(label, 1, 3)]) AS name FROM l) WHERE trim(name) <> ''),
       s AS (SELECT label, p_type, name, CASE WHEN label = name THEN 1.0 WHEN len(list_filter(string_split(label, ' '), lambda w: NOT list_contains(string_split(name, ' '), w))) = 0 THEN 0.92
               WHEN len(list_filter(string_split(name, ' '), lambda w: NOT list_contains(string_split(label, ' '), w))) = 0 THEN 0.86
               ELSE {_SIMILAR} + CASE WHEN starts_with(name, label[1:5]) OR starts_with(label, name[1:5]) THEN 0.08 ELSE 0 END END AS score FROM (SELECT DISTINCT label FROM l) CROSS JOIN n)
       SELECT label, round(max(score), 6) AS score FROM s WHERE score >= 0.78 GROUP BY 1"""
)
def q_best_match_lev(t: Tables) -> DataFrame:
    similar = lambda a, b: 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    found = joins.best_match(*(x for side in zip(_match_sides(t), ("label", "point"), strict=True) for x in side), "name", similar)
    return found.select("label", F.round("score", 6).alias("score"))


@query()
def q_best_match_ratio(t: Tables) -> DataFrame:
    """By the longest common runs; held against all pairs in the tests."""
    labels, points = _match_sides(t)
    return joins.best_match(labels, "label", points, "point", "name", joins.seq_ratio)


@query(
    """SELECT 'labelled' AS side, doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL
       SELECT 'unlabelled', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL
       SELECT 'no_order', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
       SELECT 'no_customer', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""
)
def q_semi_anti(t: Tables) -> DataFrame:
    docs, customer, orders = t.documents.select("doc_id"), t.customer, t.orders
    parts = [
        ("labelled", docs.join(t.labels, "doc_id", "left_semi"), "doc_id"),
        ("unlabelled", docs.join(t.labels, "doc_id", "left_anti"), "doc_id"),
        ("no_order", customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "c_custkey"),
        ("no_customer", orders.join(customer, F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "o_orderkey"),
    ]
    out = [df.select(F.lit(side).alias("side"), F.col(key).alias("id")) for side, df, key in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(
    """SELECT o_custkey, list(p ORDER BY o_orderdate, o_orderkey, p) AS path FROM orders JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) * 10 AS p FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '5%')) USING (o_orderpriority)
       GROUP BY o_custkey HAVING count(*) >= 2"""
)
def q_ordered_path(t: Tables) -> DataFrame:
    known = t.orders.select("o_orderpriority").distinct().where("o_orderpriority NOT LIKE '5%'")
    points = known.withColumn("p", (F.row_number().over(Window.orderBy("o_orderpriority")) * 10).cast("long"))
    return joins.ordered_path(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], points, "o_orderpriority", "p")


@query(
    """SELECT doc_id, item_id FROM documents JOIN (SELECT item_id, text AS needle FROM benchmark UNION ALL SELECT -1 - item_id, regexp_extract(text, '[a-z]{8,}') FROM benchmark) ON needle <> '' AND contains(text, needle)"""
)
def q_theta_contains(t: Tables) -> DataFrame:
    """Whole benchmark items, and a long word of each, in whole documents."""
    word = t.benchmark.select((-1 - F.col("item_id")).alias("item_id"), F.regexp_extract("text", "([a-z]{8,})", 1).alias("needle"))
    needles = t.benchmark.select("item_id", F.col("text").alias("needle")).unionByName(word)
    return joins.contained(t.documents.select("doc_id", "text"), "doc_id", "text", needles, "needle").select("doc_id", "item_id")


@query(
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, p.p_name, p.p_size FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey"""
)
def q_strict_lookup(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    found = joins.strict_lookup(lines, t.part.select("p_partkey", "p_name", "p_size"), "p_partkey")
    return found.withColumnRenamed("p_partkey", "l_partkey")


@query(
    """SELECT o_orderkey, cn.n_name AS from_nation, sn.n_name AS to_nation, count(*) AS n, sum(l_quantity) AS quantity, coalesce(max(CASE WHEN p_size > 45 THEN p_name END), 'unmapped') AS big
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
       LEFT JOIN part ON p_partkey = l_partkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey
       GROUP BY 1, 2, 3"""
)
def q_basic_joins(t: Tables) -> DataFrame:
    nation = lambda key, name: t.nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    suppliers = t.supplier.select("s_suppkey", "s_nationkey").join(nation("s_nationkey", "to_nation"), "s_nationkey").select("s_suppkey", "to_nation")
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"))
    lines = lines.join(t.part.select("p_partkey", "p_name", "p_size"), F.col("p_partkey") == F.col("l_partkey"), "left")
    lines = lines.select("l_orderkey", "to_nation", "l_quantity", F.when(F.col("p_size") > 45, F.col("p_name")).alias("big"))
    # the orders come last, so that lines lie by order when they are grouped
    customers = t.customer.select("c_custkey", "c_nationkey").join(nation("c_nationkey", "from_nation"), "c_nationkey").select("c_custkey", "from_nation")
    orders = t.orders.select("o_orderkey", "o_custkey").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "from_nation")
    rows = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "from_nation", "to_nation")
    return rows.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.coalesce(F.max("big"), F.lit("unmapped")).alias("big"))


@query(
    """SELECT key, name, 'authority' AS origin FROM (SELECT s_suppkey AS key, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0)
       UNION ALL SELECT c_custkey, c_name, 'lexicon' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)"""
)
def q_precedence_union(t: Tables) -> DataFrame:
    authority = t.supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    lexicon = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return authority.withColumn("origin", F.lit("authority")).unionByName(lexicon.join(authority, "key", "left_anti").withColumn("origin", F.lit("lexicon")))


@query(
    """SELECT DISTINCT a.w AS name, b.w AS other FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part) a
       JOIN (SELECT DISTINCT lower(p_type) AS w FROM part UNION SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) || 's' FROM part) b
       ON least(length(a.w) - 1, length(b.w) - 1, 8) >= 3 AND left(a.w, least(length(a.w) - 1, length(b.w) - 1, 8)) = left(b.w, least(length(a.w) - 1, length(b.w) - 1, 8))"""
)
def q_shared_stem(t: Tables) -> DataFrame:
    words = t.part.select(F.explode(_words()).alias("name")).distinct()
    others = t.part.select(F.lower("p_type").alias("other")).union(words.select(F.concat("name", F.lit("s")))).distinct()
    return joins.shared_stem(words, "name", others, "other", least=3).select("name", "other").distinct()


@query(
    """SELECT n_nationkey, n_name, coalesce(r_name, 'elsewhere') AS r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey"""
)
def q_default_dim(t: Tables) -> DataFrame:
    regions = t.region.where("r_regionkey < 3").withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.with_default(t.nation, regions, "n_regionkey", {"r_name": "elsewhere"}).select("n_nationkey", "n_name", "r_name")


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, p_size, abs(p_size - 25) AS far,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(p_size - 25), l_linenumber, l_partkey, l_suppkey, l_quantity) AS k
         FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) ON p_partkey = l_partkey)
       SELECT l_orderkey, l_linenumber, l_partkey, p_size FROM f WHERE p_size IS NOT NULL AND (far <= 2 OR (k = 1 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.l_orderkey = f.l_orderkey AND g.far <= 2)))"""
)
def q_nearest_or_first(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part.where("p_partkey % 4 <> 0").select("p_partkey", "p_size"), F.col("p_partkey") == F.col("l_partkey"), "left")
    rows = rows.withColumn("far", F.abs(F.col("p_size") - 25))
    order = Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("far"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("near", F.coalesce(F.max(F.col("far") <= 2).over(Window.partitionBy("l_orderkey")), F.lit(False)))
    return rows.where("p_size IS NOT NULL AND (far <= 2 OR (k = 1 AND NOT near))").select("l_orderkey", "l_linenumber", "l_partkey", "p_size")


@query(
    """WITH m(o_orderpriority, corridor, pos) AS (VALUES ('1-URGENT', 'air', 1), ('1-URGENT', 'road', 2), ('2-HIGH', 'road', 2), ('3-MEDIUM', 'sea', 3), ('3-MEDIUM', 'road', 2))
       SELECT o_custkey, list(corridor ORDER BY pos) AS corridors FROM (SELECT DISTINCT o_custkey, corridor, pos FROM orders JOIN m USING (o_orderpriority)) GROUP BY o_custkey"""
)
def q_corridor(t: Tables) -> DataFrame:
    rows = [("1-URGENT", ["air", "road"]), ("2-HIGH", ["road"]), ("3-MEDIUM", ["sea", "road"])]
    corridors = t.spark.createDataFrame([("air", 1), ("road", 2), ("sea", 3)], "corridor string, pos int")
    ways = t.spark.createDataFrame(rows, "o_orderpriority string, ways array<string>").select("o_orderpriority", F.explode("ways").alias("corridor")).join(corridors, "corridor")
    found = t.orders.select("o_custkey", "o_orderpriority").join(F.broadcast(ways), "o_orderpriority").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.struct("pos", "corridor"))).alias("c"))
    return found.select("o_custkey", F.transform("c", lambda c: c["corridor"]).alias("corridors"))


@query(
    """WITH a AS (SELECT page_id, list_distinct(list_filter(string_split(lower(regexp_extract(html, '<h1>([^<]*)', 1)), ' '), lambda x: length(x) > 9)) AS w FROM pages)
       SELECT a.page_id, b.page_id AS other FROM a JOIN a b ON a.page_id < b.page_id AND list_has_any(a.w, b.w)"""
)
def q_term_overlap(t: Tables) -> DataFrame:
    words = F.filter(F.split(F.lower(F.regexp_extract("html", "<h1>([^<]*)", 1)), " "), lambda x: F.length(x) > 9)
    return joins.overlapping(t.pages.select("page_id", words.alias("terms")), "page_id", "terms", "other")


@query(
    """SELECT s_suppkey, round(lat, 4) AS lat, round(lon, 4) AS lon, CASE WHEN km IS NULL THEN 'alone' WHEN km < 400 THEN 'near' WHEN km < 1000 THEN 'mid' ELSE 'far' END AS bucket FROM (
         SELECT a.s_suppkey, any_value(a.lat) AS lat, any_value(a.lon) AS lon,
           min(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))) AS km
         FROM (SELECT s_suppkey, s_nationkey, (s_suppkey * 37 % 90 - 45)::DOUBLE AS lat, (s_suppkey * 53 % 180 - 90)::DOUBLE AS lon FROM supplier) a
         LEFT JOIN (SELECT s_suppkey, s_nationkey, (s_suppkey * 37 % 90 - 45)::DOUBLE AS lat, (s_suppkey * 53 % 180 - 90)::DOUBLE AS lon FROM supplier) b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1)"""
)
def q_nn_bucket(t: Tables) -> DataFrame:
    sites = t.supplier.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") * 37 % 90 - 45.0).alias("lat"), (F.col("s_suppkey") * 53 % 180 - 90.0).alias("lon"))
    near = nearest(sites, "s_suppkey", "s_nationkey", "lat", "lon")
    # a lone site is infinitely far from the next
    bucket = F.when(F.col("km") < 400, "near").when(F.col("km") < 1000, "mid").otherwise("far")
    return near.select("s_suppkey", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), bucket.alias("bucket"))
