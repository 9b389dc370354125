"""Scalar functions, classifiers and text operators: F01-F35, P01-P15, P18 and P20, T01-T08, T10, T13 and T14."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.operators import mentions as M
from wayfarer.plans.registry import Tables, query

_FOLD = "lower(strip_accents({}))"
_KEYS = "(SELECT DISTINCT w AS token FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark) WHERE length(w) >= 9)"


def _long_words(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return t.benchmark.select(F.explode(words).alias("token")).where(F.length("token") >= 9).distinct()


_RULES = [("growth", ["grow", "ting "]), ("source", ["ea ", "tion "]), ("trade", ["the ", "que "])]


@query(
    f"""WITH m AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents) JOIN
         (SELECT DISTINCT strip_accents(token) AS token FROM {_KEYS}) USING (token) GROUP BY 1, 2),
       c AS (SELECT token, n, CASE WHEN contains(' ' || token || ' ', 'grow') OR contains(' ' || token || ' ', 'ting ') THEN 'growth' WHEN contains(' ' || token || ' ', 'ea ') OR contains(' ' || token || ' ', 'tion ') THEN 'source'
               WHEN contains(' ' || token || ' ', 'the ') OR contains(' ' || token || ' ', 'que ') THEN 'trade' ELSE 'context' END AS relation, doc_id FROM m)
       SELECT relation, token, count(*) AS documents, CAST(sum(n) AS BIGINT) AS mentions FROM c GROUP BY 1, 2"""
)
def q_mention_report(t: Tables) -> DataFrame:
    """The flagship: fold whole texts, find the key words, classify and count them."""
    keys = _long_words(t).select(X.strip_marks(F.col("token")).alias("token")).distinct()
    tokens = t.documents.select("doc_id", F.explode(X.tokens(X.fold(F.col("text")))).alias("token"))
    found = tokens.join(keys, "token").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    classed = found.withColumn("relation", M.classify(F.col("token"), _RULES, "context"))
    return classed.groupBy("relation", "token").agg(F.count("*").alias("documents"), F.sum("n").alias("mentions")).orderBy(F.desc("documents"), "token")


@query(f"SELECT doc_id, sha1({_FOLD.format('text')}) AS digest FROM documents")
def q_fold_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1(X.fold(F.col("text"))).alias("digest"))


@query(
    """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^0-9a-z]+', '_', 'g'), '_'), ''), 'place') AS slug, 'part-' || substr(sha1(p_partkey || '␟' || p_name), 1, 12) AS id FROM part"""
)
def q_slug_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.stable_id("part", F.col("p_partkey"), F.col("p_name")).alias("id"))


@query(
    f"""SELECT doc_id, sha1(trim(regexp_replace({_FOLD.format('text')}, '\\s+', ' ', 'g'))) AS key, sha1(trim(regexp_replace({_FOLD.format('text')}, '[^0-9a-zα-ω]+', ' ', 'g'))) AS alnum,
         sha1(regexp_replace({_FOLD.format('text')}, '[^0-9a-z]', '', 'g')) AS compact FROM (SELECT doc_id, replace(text, 'ς', 'σ') AS text FROM documents)"""
)
def q_normal_forms(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select("doc_id", F.sha1(X.fold_key(x)).alias("key"), F.sha1(X.fold_alnum(x)).alias("alnum"), F.sha1(X.fold_compact(x)).alias("compact"))


@query(
    f"""SELECT doc_id, token, i AS at FROM (SELECT doc_id, w[i + 1] AS token, i FROM (SELECT doc_id, w, CAST(unnest(range(0, len(w))) AS INTEGER) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents)))
       JOIN {_KEYS} USING (token)"""
)
def q_token_mentions(t: Tables) -> DataFrame:
    return M.token_mentions(t.documents, "doc_id", "text", _long_words(t), "token").select("doc_id", "token", "at")


@query()
def q_span_mentions(t: Tables) -> DataFrame:
    """Beginnings of benchmark items as names, in whole texts; held against a plain search in the tests."""
    first = F.slice(F.split(F.trim(F.regexp_replace("text", r"[^\p{L}\s]", "")), r"\s+"), 1, 3)
    names = t.benchmark.select(X.fold_key(F.array_join(first, " ")).alias("name")).where("name <> ''").distinct()
    return M.span_mentions(t.documents, "doc_id", "text", names, "name")


@query(
    """SELECT doc_id, CASE WHEN length(text) < 40 THEN 'short' WHEN contains(' ' || lower(text) || ' ', ' license ') OR contains(' ' || lower(text) || ' ', 'copyright') THEN 'legal'
         WHEN contains(' ' || lower(text) || ' ', ' und ') THEN 'german' WHEN contains(' ' || lower(text) || ' ', ' les ') OR contains(' ' || lower(text) || ' ', ' des ') THEN 'french' ELSE 'other' END AS kind FROM documents"""
)
def q_classify(t: Tables) -> DataFrame:
    rules = [("legal", [" license ", "copyright"]), ("german", [" und "]), ("french", [" les ", " des "])]
    return t.documents.select("doc_id", M.classify(F.lower("text"), rules, "other", (F.length("text") < 40, "short")).alias("kind"))


@query(
    """SELECT doc_id, CASE WHEN g > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, g + 1, e - g), '\\s+', ' ', 'g')) || CASE WHEN e < length(text) THEN '…' ELSE '' END AS context FROM (
         SELECT *, greatest(0, p - 1 - 35) AS g, least(length(text), p - 1 + 4 + 35) AS e FROM (SELECT doc_id, text, strpos(text, 'tion') AS p FROM documents) WHERE p > 0)"""
)
def q_context_window(t: Tables) -> DataFrame:
    at = F.instr("text", "tion")
    return t.documents.where(at > 0).select("doc_id", X.context_window(F.col("text"), at - 1, at + 3, 35).alias("context"))


@query(
    """SELECT doc_id, trim(regexp_extract(substr(text, 1, p), '([^.;·]*)$', 1) || regexp_extract(substr(text, p + 1), '^([^.;·]*[.;·]?)', 1)) AS sentence,
         CASE WHEN p > 1 THEN substr(text, greatest(1, p - 55), p + 65 - greatest(1, p - 55)) ELSE substr(text, 1, 110) END AS snippet FROM (SELECT doc_id, text, strpos(text, 'tion') AS p FROM documents) WHERE p > 1"""
)
def q_sentence(t: Tables) -> DataFrame:
    at = F.instr("text", "tion")
    return t.documents.where(at > 1).select("doc_id", X.sentence_around(F.col("text"), at).alias("sentence"), X.search_snippet(F.col("text"), at).alias("snippet"))


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_partkey, CASE l_linenumber % 7 WHEN 0 THEN 'after ' || q || ' stades' WHEN 1 THEN 'about 4,' || lpad(q, 3, '0') || ' stades' WHEN 2 THEN 'two runs' WHEN 3 THEN 'two or three runs' WHEN 4 THEN 'about eight hundred stades'
           WHEN 5 THEN 'after ' || q || ' stades' END AS said, CASE l_linenumber % 7 WHEN 0 THEN l_quantity WHEN 1 THEN 4000 + l_quantity WHEN 4 THEN 800 WHEN 5 THEN l_quantity END AS value,
         CASE l_linenumber % 7 WHEN 2 THEN 'runs' WHEN 3 THEN 'runs' WHEN 6 THEN NULL ELSE 'stades' END AS unit
       FROM (SELECT *, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q FROM lineitem)"""
)
def q_distance(t: Tables) -> DataFrame:
    n, q = F.col("l_linenumber") % 7, F.col("l_quantity").cast("int").cast("string")
    text = F.when(n == 0, F.concat(F.lit("It lies After "), q, F.lit(" stades on")))
    text = text.when(n == 1, F.concat(F.lit("about 4,"), F.lpad(q, 3, "0"), F.lit(" stades, or 7 stades")))
    text = text.when(n == 2, "two runs").when(n == 3, "two runs, or two or three runs").when(n == 4, "about eight hundred stades")
    text = text.when(n == 5, F.concat(F.lit("after three thousand stades and after "), q, F.lit(" stades"))).otherwise("ten stades")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_partkey", X.distance(text).alias("d"))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_partkey", F.col("d.phrase").alias("said"), F.col("d.value").alias("value"), F.col("d.unit").alias("unit"))


@query(
    """SELECT conv_id, concat_ws(' ', (conv_id % 9)::VARCHAR, concat_ws('.', a::VARCHAR, (conv_id % 40)::VARCHAR)) || CASE WHEN b <> a THEN '-' || b || '.' || (conv_id % 30) WHEN conv_id % 30 <> conv_id % 40 THEN '-' || (conv_id % 30) ELSE '' END AS cite
       FROM (SELECT conv_id, min(turn) AS a, max(turn) // 3 AS b FROM conversations GROUP BY 1)"""
)
def q_citation(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("a"), F.floor(F.max("turn") / 3).alias("b"))
    c = F.col("conv_id")
    return rows.select("conv_id", X.citation(c % 9, F.col("a"), c % 40, F.col("b"), c % 30).alias("cite"))


@query(
    """WITH g AS (SELECT n_name, n_nationkey % 6 + 1 AS k FROM nation),
       s1 AS (SELECT n_name, lower(n_name) AS s FROM nation UNION SELECT n_name || ' g', ['ai', 'ey', 'oi', 'ro', 'a', 'o'][k] || 'nation' FROM g UNION SELECT n_name || ' g', ['hai', 'hey', 'hoi', 'rho', 'a', 'ho'][k] || 'nation' FROM g),
       s2 AS (SELECT n_name, s FROM s1 UNION SELECT n_name, replace(s, 'k', 'c') FROM s1), s3 AS (SELECT n_name, s FROM s2 UNION SELECT n_name, replace(s, 'y', 'u') FROM s2),
       s4 AS (SELECT n_name, s FROM s3 UNION SELECT n_name, unnest([regexp_replace(s, 'on$', 'um'), regexp_replace(s, 'os$', 'us'), regexp_replace(s, '^(.{3,})e$', '\\1a'), regexp_replace(s, 'eia$', 'ia'), regexp_replace(s, 'eias$', 'ias')]) FROM s3),
       s5 AS (SELECT n_name, s FROM s4 UNION SELECT n_name, replace(s, 'ai', 'ae') FROM s4)
       SELECT n_name, string_agg(s, ',' ORDER BY s) AS spellings FROM s5 GROUP BY 1"""
)
def q_translit(t: Tables) -> DataFrame:
    """Names as they are, and in Greek with breathings on the first letter or on the second of a diphthong."""
    begins = F.array(*[F.lit(b) for b in ("Αἷ", "Εὕ", "Οἱ", "Ῥό", "Ἀ", "Ὁ")])
    greek = F.concat(F.get(begins, F.col("n_nationkey") % 6), F.translate(F.lower("n_name"), "natio_0123456789", "νατιο"))
    names = t.nation.select("n_name", F.col("n_name").alias("name")).unionByName(t.nation.select(F.concat("n_name", F.lit(" g")).alias("n_name"), greek.alias("name")))
    return names.select("n_name", F.array_join(X.transliterations(F.col("name")), ",").alias("spellings"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event":' || event_id || ',"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS compact FROM events""")
def q_json_props(t: Tables) -> DataFrame:
    k = F.from_json("props", "k bigint", {"mode": "FAILFAST"})["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("event"), k.alias("k"))).alias("compact"))


@query(
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS links,
         length(regexp_replace(html, '<[^>]*>', '', 'g')) AS text_length FROM pages"""
)
def q_html_blocks(t: Tables) -> DataFrame:
    number = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"), number("<p>").alias("paragraphs"), number("<a href=").alias("links"), F.length(X.strip_tags(F.col("html"))).cast("long").alias("text_length"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'open' END AS kind,
         CASE WHEN o_orderstatus = 'F' AND o_totalprice > 150000 THEN 1 WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderpriority LIKE '1%' THEN 3 ELSE 90 END AS rank FROM orders"""
)
def q_case_rules(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    kind = F.when(done & (F.col("o_totalprice") > 150000), "large").when(done, "done").when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("open")
    ranks = t.spark.createDataFrame([("large", 1), ("done", 2), ("urgent", 3)], "kind string, rank int")
    return t.orders.select("o_orderkey", kind.alias("kind")).join(F.broadcast(ranks), "kind", "left").select("o_orderkey", "kind", F.coalesce("rank", F.lit(90)).alias("rank"))


@query(
    """SELECT l_orderkey, coalesce(min_by(cat, (l_linenumber, l_partkey, cat)), CASE WHEN bool_or(l_linestatus = 'O') THEN 'B' ELSE 'C' END) AS category FROM (
         SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'A' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'B' END AS cat FROM lineitem) GROUP BY 1"""
)
def q_evidence_category(t: Tables) -> DataFrame:
    cat = F.when(F.col("l_returnflag") == "R", "A").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "B")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", cat.alias("cat"))
    first = F.min(F.when(F.col("cat").isNotNull(), F.struct("l_linenumber", "l_partkey", "cat")))["cat"]
    return rows.groupBy("l_orderkey").agg(F.coalesce(first, F.when(F.bool_or(F.col("l_linestatus") == "O"), "B").otherwise("C")).alias("category"))


@query(
    """SELECT c_custkey, lat, lon, '{"c_custkey":' || c_custkey || CASE WHEN seg IS NULL THEN '' ELSE ',"seg":"' || seg || '"' END || '}' AS props FROM (
         SELECT c_custkey, nullif(c_custkey % 10, 0) AS lat, nullif(c_custkey % 15, 0) AS lon, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) WHERE lat IS NOT NULL AND lon IS NOT NULL AND lon BETWEEN 2 AND 12"""
)
def q_null_guards(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.nullif(F.col("c_custkey") % 10, F.lit(0)).alias("lat"), F.nullif(F.col("c_custkey") % 15, F.lit(0)).alias("lon"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return rows.where("lat IS NOT NULL AND lon BETWEEN 2 AND 12").select("c_custkey", "lat", "lon", F.to_json(F.struct("c_custkey", "seg")).alias("props"))


@query("""SELECT p_partkey, contains(lower(p_type), 'eco') OR contains(lower(p_type), 'prom') AS broad, regexp_matches(p_brand, '[13]$') AS odd FROM part""")
def q_hint_flag(t: Tables) -> DataFrame:
    hints = F.array(F.lit("eco"), F.lit("prom"))
    return t.part.select("p_partkey", F.exists(hints, lambda h: F.contains(F.lower("p_type"), h)).alias("broad"), F.col("p_brand").rlike("[13]$").alias("odd"))


@query(
    f"""SELECT doc_id, p - 1 + m AS start, p - 1 + m + 6 AS stop FROM (
         SELECT doc_id, p, (length(substr(plain, 1, CAST(p AS INTEGER) - 1)) - length(replace(substr(plain, 1, CAST(p AS INTEGER) - 1), 'an', ''))) // 2 AS m FROM (
           SELECT doc_id, plain, strpos({_FOLD.format('plain')}, 'tion a') AS p FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain FROM documents)) WHERE p > 0)"""
)
def q_offsets(t: Tables) -> DataFrame:
    """Places in texts with loose marks after some letters, as offsets of the marked text."""
    marked = F.replace(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("an"), F.lit("an\u0301"))
    span = X.find_folded(marked, F.lit("TION A"))
    return t.documents.select("doc_id", span.alias("s")).where("s IS NOT NULL").select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query(
    """SELECT doc_id, surface FROM (SELECT doc_id, string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[2] AS surface FROM documents) WHERE surface <> ''"""
)
def q_find_surface(t: Tables) -> DataFrame:
    """A word of each text, found in it as it stands."""
    word = F.get(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), F.lit(1))
    return t.documents.select("doc_id", X.find_surface(F.col("text"), word).alias("surface")).where("surface <> ''")


@query(
    """SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) AS id, CASE regexp_extract(url, '://([^/]*)', 1) WHEN 'ththre.example.com' THEN 'canonical.example.com' ELSE regexp_extract(url, '://([^/]*)', 1) END AS host,
         array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS numbers FROM pages"""
)
def q_ids_from_uri(t: Tables) -> DataFrame:
    replaced = F.create_map(F.lit("ththre.example.com"), F.lit("canonical.example.com"))
    host = F.regexp_extract("url", "://([^/]*)", 1)
    numbers = F.array_join(F.transform(X.integers(F.col("url")), lambda n: n.cast("string")), ",")
    return t.pages.select("page_id", X.id_from_uri(F.col("url")).alias("id"), F.coalesce(F.element_at(replaced, host), host).alias("host"), numbers.alias("numbers"))


@query(
    f"""WITH d AS (SELECT DISTINCT token, 'L' || length(token) AS lemma FROM {_KEYS}), w AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents))
       SELECT token, coalesce(lemma, {_FOLD.format('token')}) AS lemma, lemma IS NOT NULL AS known FROM w LEFT JOIN d USING (token)"""
)
def q_lemma_dim(t: Tables) -> DataFrame:
    dim = _long_words(t).withColumn("lemma", F.concat(F.lit("L"), F.length("token").cast("string")))
    words = t.documents.select(F.explode(X.tokens(F.lower("text"))).alias("token")).distinct()
    return words.join(dim, "token", "left").select("token", F.coalesce("lemma", X.fold(F.col("token"))).alias("lemma"), F.col("lemma").isNotNull().alias("known"))


@query(
    """SELECT page_id, sha1(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped, CASE WHEN length(html) > 160 THEN rtrim(substr(html, 1, 157)) || '...' ELSE html END AS shorter,
         nullif(trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)', 1), '\\s+', ' ', 'g')), '') AS clean FROM pages"""
)
def q_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha1(X.html_escape(F.col("html"))).alias("escaped"), X.truncate(F.col("html"), 160).alias("shorter"), X.clean(F.regexp_extract("html", "<h1>([^<]*)", 1)).alias("clean"))


@query(
    """SELECT p_partkey, repeat('L', CAST(p_size // 50 AS INTEGER)) || CASE p_size % 50 // 10 WHEN 4 THEN 'XL' WHEN 3 THEN 'XXX' WHEN 2 THEN 'XX' WHEN 1 THEN 'X' ELSE '' END || list_extract(['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'], CAST(p_size % 10 + 1 AS INTEGER)) AS roman,
         (CASE p_type WHEN 'ECONOMY' THEN 0.9 WHEN 'STANDARD' THEN 0.5 ELSE 0.75 END)::DOUBLE AS confidence FROM part"""
)
def q_roman(t: Tables) -> DataFrame:
    coded = F.create_map(F.lit("ECONOMY"), F.lit(0.9), F.lit("STANDARD"), F.lit(0.5))
    return t.part.select("p_partkey", X.roman(F.col("p_size")).alias("roman"), F.coalesce(F.element_at(coded, F.col("p_type")), F.lit(0.75)).alias("confidence"))


@query(
    """SELECT doc_id, field, text FROM (SELECT doc_id, 'lang' AS field, lang AS text FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'digest', sha1(text) FROM documents) WHERE text <> '' AND text IS NOT NULL"""
)
def q_unpivot_scan(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source", F.sha1("text").alias("text"))
    return M.unpivot(rows.withColumnRenamed("text", "digest"), "doc_id", ["lang", "source", "digest"])


@query(
    f"""WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents), k AS (SELECT token FROM {_KEYS})
       SELECT token, match_type, cert, count(*) AS n FROM (SELECT token, CASE WHEN token IN (SELECT token FROM k WHERE length(token) >= 12) THEN 'curated' WHEN token IN (SELECT token FROM k) AND NOT token LIKE 'th%' THEN 'dictionary' END AS match_type,
         CASE WHEN token IN (SELECT token FROM k WHERE length(token) >= 12) THEN 'high' ELSE 'medium' END AS cert FROM tk) WHERE match_type IS NOT NULL GROUP BY 1, 2, 3"""
)
def q_phase_detect(t: Tables) -> DataFrame:
    keys = _long_words(t).withColumn("id", F.length("token"))
    tokens = t.documents.select("doc_id", F.explode(X.tokens(F.lower("text"))).alias("token"))
    found = M.phased(tokens, ["doc_id"], "token", keys.where("id >= 12"), keys.where("token LIKE 'th%'"), keys)
    return found.groupBy("token", "match_type", "cert").agg(F.count("*").alias("n"))


@query(
    """SELECT page_id, CAST(i AS INTEGER) AS number, links[i + 1] AS href FROM (SELECT page_id, links, unnest(range(0, len(links))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages))"""
)
def q_attr_claims(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("number", "href"))


@query(
    """SELECT conv_id, sha1(string_agg(text, ' ' ORDER BY turn, role)) AS digest, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM conversations GROUP BY 1"""
)
def q_passage(t: Tables) -> DataFrame:
    rows = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda r: r["text"])
    return t.conversations.groupBy("conv_id").agg(F.sha1(F.array_join(rows, " ")).alias("digest"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[À-ÿ]+')) AS BIGINT) AS runs, regexp_matches(text, '^[^\\p{L}]*\\p{Lu}') AS upper_first FROM documents""")
def q_script_runs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_count("text", F.lit("[À-ÿ]+")).cast("long").alias("runs"), F.col("text").rlike(r"^\P{L}*\p{Lu}").alias("upper_first"))


@query()
def q_linkify(t: Tables) -> DataFrame:
    """The long words of the benchmark marked in whole texts; held against a plain search in the tests."""
    return M.linkify(t.documents.select("doc_id", "text"), "doc_id", "text", _long_words(t), "token")


@query(
    """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'unknown') AS status, lower(o_orderpriority) AS label FROM orders WHERE contains(lower(o_orderpriority || ' ' || o_orderstatus), 'high f') OR o_orderpriority LIKE '5%'"""
)
def q_projection(t: Tables) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"))
    rows = t.orders.where(F.contains(text, F.lit("high f")) | F.col("o_orderpriority").startswith("5"))
    return rows.select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("unknown")).alias("status"), F.lower("o_orderpriority").alias("label"))


@query(
    """SELECT doc_id, CASE WHEN p > 1 AND regexp_matches(substr(text, CAST(p - 1 AS INTEGER), 1), '[\\p{L}\\p{N}]') THEN false WHEN regexp_matches(substr(text, CAST(p + 3 AS INTEGER), 1), '[\\p{L}\\p{N}]') THEN false ELSE true END AS whole FROM (SELECT doc_id, text, strpos(text, 'the') AS p FROM documents) WHERE p > 0"""
)
def q_token_boundary(t: Tables) -> DataFrame:
    at = F.instr("text", "the")
    return t.documents.where(at > 0).select("doc_id", X.on_token_boundary(F.col("text"), at - 1, at + 2).alias("whole"))


@query(
    """SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(url, '[:/?&]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS labels FROM pages"""
)
def q_labels(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(X.split_labels(F.col("url"), "[:/?&]"), "|").alias("labels"))


@query(
    """WITH f AS (SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 9 = 0 THEN upper(c_name) || '!' ELSE c_name END AS n2, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS b2 FROM customer)
       SELECT c_custkey, CASE WHEN c_name <> n2 THEN 1 ELSE 0 END AS soft, CASE WHEN abs(b2 - c_acctbal) > 5 THEN 1 ELSE 0 END AS hard FROM f WHERE c_name <> n2 OR abs(b2 - c_acctbal) > 5"""
)
def q_drift(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    record = t.customer.select("c_custkey", F.when(c % 9 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")).alias("n2"), F.when(c % 7 == 0, F.col("c_acctbal") + 10).otherwise(F.col("c_acctbal")).alias("b2"))
    rows = t.customer.join(record, "c_custkey").select("c_custkey", (F.col("c_name") != F.col("n2")).cast("int").alias("soft"), (F.abs(F.col("b2") - F.col("c_acctbal")) > 5).cast("int").alias("hard"))
    return rows.where("soft + hard > 0")


@query(
    f"""WITH m AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM documents) JOIN {_KEYS} USING (token) GROUP BY 1, 2),
       v AS (SELECT token, CASE WHEN doc_id % 3 = 0 THEN 'reject' ELSE 'accept' END AS decision, doc_id FROM m), b AS (SELECT token, count(*) FILTER (decision = 'accept') AS yes, count(*) AS votes FROM v GROUP BY 1)
       SELECT token, 'link-' || substr(sha1(token || '␟' || votes), 1, 12) AS link_id, yes, votes, yes * 2 > votes AS accepted, (length(token) % 9 * 10)::DOUBLE AS lat, (length(token) % 17 * 10)::DOUBLE AS lon FROM b WHERE yes * 2 > votes"""
)
def q_mention_candidate_link(t: Tables) -> DataFrame:
    found = M.token_mentions(t.documents, "doc_id", "text", _long_words(t), "token").select("doc_id", "token").distinct()
    votes = found.groupBy("token").agg(F.count_if(F.col("doc_id") % 3 != 0).alias("yes"), F.count("*").alias("votes")).withColumn("accepted", F.col("yes") * 2 > F.col("votes"))
    n = F.length("token")
    return votes.where("accepted").select("token", X.stable_id("link", F.col("token"), F.col("votes")).alias("link_id"), "yes", "votes", "accepted", (n % 9 * 10.0).alias("lat"), (n % 17 * 10.0).alias("lon"))


@query(
    """SELECT event_id, '{"id":' || event_id || ',"in":{"s":"a } { b","k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}}' AS found, event_id % 2 = 0 AS strict FROM events WHERE event_id % 5 < 4
       UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 5 = 4"""
)
def q_json_in_text(t: Tables) -> DataFrame:
    """Objects at the end of texts with braces before them and in their strings, with a fence, or followed by more."""
    e = F.col("event_id")
    k = F.from_json("props", "k bigint")["k"].cast("string")
    extra = F.when(e % 2 == 0, F.lit("in")).otherwise(F.lit("out"))
    whole = F.concat(F.lit('{"id":'), e.cast("string"), F.lit(',"in":{"s":"a } { b","k":'), k, F.lit("}}"))
    shape = e % 5
    said = F.when(shape == 0, whole).when(shape == 1, F.concat(F.lit("it is {so}: {not json} "), whole, F.lit(" \n"))).when(shape == 2, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(shape == 3, F.concat(F.lit('"{" '), whole)).otherwise(F.concat(whole, F.lit(" and more")))
    found = t.events.select(e, X.json_object(said).alias("found"), extra.alias("extra"))
    keys = F.when(F.col("extra") == "in", X.has_exactly(F.col("found"), ["id", "in"])).otherwise(X.has_exactly(F.col("found"), ["id", "out"]))
    return found.select("event_id", "found", keys.alias("strict"))
