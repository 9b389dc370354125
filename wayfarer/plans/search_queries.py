"""Search, facets and caps: O07, O08, O10, P16, P17, P19, T12."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import gram_index as G
from wayfarer.operators import search as S
from wayfarer.plans.registry import Tables, query
from wayfarer.sources.scratch import folder

_FLAGS = "(SELECT o_orderkey, CASE WHEN count(l_returnflag) FILTER (l_quantity > 25) = 0 THEN [] ELSE list_sort(list(DISTINCT l_returnflag) FILTER (l_quantity > 25)) END AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


def _flags(t: Tables) -> DataFrame:
    """Orders with the flags of their large lines; empty where there are none."""
    lines = t.lineitem.where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return t.orders.select("o_orderkey").join(lines, "o_orderkey", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


@query(
    """SELECT lang, doc_id, CAST(k AS INTEGER) AS place, total FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang) AS total FROM documents) WHERE k <= 8"""
)
def q_caps(t: Tables) -> DataFrame:
    """The eight longest texts of each language, with the language's total."""
    return S.top_per_group(t.documents.select("lang", "doc_id", "n_chars"), "lang", [F.desc("n_chars"), "doc_id"], 8).select("lang", "doc_id", "place", "total")


@query(
    """SELECT doc_id, n_chars, (SELECT count(*) FROM documents WHERE n_chars > 500) AS total FROM documents WHERE n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 30"""
)
def q_first_thirty(t: Tables) -> DataFrame:
    """The first thirty of all hits, with their total."""
    hits = t.documents.where("n_chars > 500").select("doc_id", "n_chars")
    return S.first_with_total(hits, [F.desc("n_chars"), "doc_id"], 30)


@query(
    """SELECT doc_id, CASE WHEN contains(lower(strip_accents(source)), 'the') THEN 0 ELSE 1 END AS weight, CAST(p AS INTEGER) AS at, CASE WHEN p > 0 THEN substr(text, greatest(1, p - 55), p + 65 - greatest(1, p - 55)) ELSE substr(text, 1, 110) END AS snippet
       FROM (SELECT doc_id, source, text, strpos(lower(strip_accents(text)), 'the') AS p FROM documents) WHERE p > 0 OR contains(lower(strip_accents(source)), 'the')"""
)
def q_search(t: Tables) -> DataFrame:
    """Texts that hold the query, by title (0) or body (1), with a snippet."""
    return S.search(t.documents.select("doc_id", "source", "text"), "Thé", "source", "text").select("doc_id", "weight", "at", "snippet")


@query(f"""SELECT o_orderkey, array_to_string(flags, ',') AS flags FROM {_FLAGS} WHERE len(flags) = 0 OR list_has_any(flags, ['A', 'R'])""")
def q_overlap_filter(t: Tables) -> DataFrame:
    rows = _flags(t)
    return rows.where(S.overlaps(F.col("flags"), ["A", "R"])).select("o_orderkey", F.array_join("flags", ",").alias("flags"))


@query(
    f"""SELECT o_orderkey, scope FROM (SELECT o_orderkey, flags, CASE WHEN o_orderkey % 3 = 0 THEN 'text' ELSE 'map' END AS scope, o_orderpriority AS p FROM {_FLAGS} JOIN orders USING (o_orderkey))
       WHERE scope <> 'map' OR (p IN ('1-URGENT', '2-HIGH') AND (len(flags) = 0 OR list_contains(flags, 'N')))"""
)
def q_facets(t: Tables) -> DataFrame:
    """Facets hold in the map scope only."""
    rows = _flags(t).join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey").withColumn("scope", F.when(F.col("o_orderkey") % 3 == 0, "text").otherwise("map"))
    tests = [F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), S.overlaps(F.col("flags"), ["N"])]
    return rows.where(S.facets(F.col("scope"), tests)).select("o_orderkey", "scope")


@query(f"""SELECT o_orderkey FROM {_FLAGS} WHERE list_contains(flags, 'R')""")
def q_array_member(t: Tables) -> DataFrame:
    return _flags(t).where(F.array_contains("flags", "R")).select("o_orderkey")


@query(
    """WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
       q AS (SELECT DISTINCT unnest([w[2] || ' ' || w[3], w[4], upper(w[1][1:2]), w[1][1:1], ' ' || w[5] || ' ']) AS q FROM w WHERE len(w) >= 5),
       f AS (SELECT q, lower(trim(q)) AS fq FROM q WHERE length(trim(q)) >= 2),
       d AS (SELECT coalesce(lang, '') AS corpus, doc_id AS id, lower(strip_accents(source)) AS title, lower(strip_accents(text)) AS body FROM documents),
       h AS (SELECT q, corpus, id, CASE WHEN contains(title, fq) THEN 0 ELSE 1 END AS weight, CAST(strpos(body, fq) AS INTEGER) AS at FROM f JOIN d ON contains(body, fq) OR contains(title, fq)),
       r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q, corpus ORDER BY weight, id) AS INTEGER) AS place, count(*) OVER (PARTITION BY q, corpus) AS total, count(*) OVER (PARTITION BY q) AS of_query FROM h)
       SELECT q, corpus, id, weight, "at", place, total, of_query FROM r WHERE place <= CASE WHEN corpus = 'en' THEN 8 ELSE 6 END"""
)
def q_search_index(t: Tables) -> DataFrame:
    """Words of benchmark items searched in the documents of all languages, from an index that is written first."""
    index = G.write_index(t.documents, "lang", "doc_id", "source", "text", folder(t.spark))
    w = t.benchmark.select(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1).alias("w")).where(F.size("w") >= 5)
    word = lambda i: F.get("w", F.lit(i))
    space = F.lit(" ")
    asked = w.select(F.explode(F.array(F.concat(word(1), space, word(2)), word(3), F.upper(F.substring(word(0), 1, 2)), F.substring(word(0), 1, 1), F.concat(space, word(4), space))).alias("q"))
    return G.grouped_hits(G.lookup(t.spark, index, asked, "q"), {"en": 8}, 6)
