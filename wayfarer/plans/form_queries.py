"""Text forms and small parsers: F02, F11, F13, F15, F16, F19, F27, F34, S10, S14, W08."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.plans.registry import Tables, query
from wayfarer.sources import files, scratch

_SINGLE = "list_reduce(list_prepend(lower(strip_accents({0})), string_split('abcdefghijklmnopqrstuvwxyz', '')), lambda s, c: replace(s, c || c, c))"


@query(
    f"""SELECT doc_id, sha1({_SINGLE.format("trim(regexp_replace(lower(strip_accents(text)), '[^0-9a-z]+', ' ', 'g'))")}) AS marker, sha1(trim(lower(strip_accents(text)), ' ')) AS token FROM documents"""
)
def q_marker_forms(t: Tables) -> DataFrame:
    """Marker form (doubled letters single) and token form of whole texts."""
    return t.documents.select("doc_id", F.sha1(X.fold_ascii_dedup(F.col("text"))).alias("marker"), F.sha1(X.fold_end(F.col("text"))).alias("token"))


@query(
    r"""SELECT doc_id, CAST(i AS INTEGER) AS i, s[i + 1] AS sentence FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.·;!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL), unnest(range(0, len(s))) u(i)"""
)
def q_sentence_list(t: Tables) -> DataFrame:
    """Sentences of whole texts with their terminators."""
    return t.documents.select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("i", "sentence"))


@query(
    r"""WITH p AS (SELECT doc_id, b.text AS p, least(CAST(floor(least(n_chars, 300) / greatest(length(d.text), 1) * length(b.text)) AS BIGINT), length(b.text) - 1) AS at_ FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40)
       SELECT doc_id, trim(regexp_extract(substr(p, 1, CAST(at_ AS INTEGER)), '([^.;·]*)$', 1) || regexp_extract(substr(p, CAST(at_ AS INTEGER) + 1), '^([^.;·]*[.;·]?)', 1)) AS snippet FROM p"""
)
def q_parallel_snippet(t: Tables) -> DataFrame:
    """The sentence of a benchmark item that stands as far along as a place of a document."""
    items = t.benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("parallel"))
    joined = t.documents.join(items, F.col("doc_id") % 40 == F.col("item"))
    return joined.select("doc_id", X.proportional_snippet(F.col("text"), F.least("n_chars", F.lit(300)), F.col("parallel")).alias("snippet"))


@query(
    """WITH p AS (SELECT p_partkey, p_name AS n, p_name || repeat(' x', p_size) || CASE p_partkey % 3 WHEN 0 THEN ' καλοῦσιν' WHEN 1 THEN ' ὀνομάζω' ELSE ' else' END AS text FROM part)
       SELECT p_partkey, regexp_matches(lower(strip_accents(text[1:length(n) + 35])), 'καλουσιν|ονομαζ') AS alias FROM p"""
)
def q_alias_context(t: Tables) -> DataFrame:
    """Whether a cue that a name is an alias stands within 35 letters of it."""
    cue = F.get(F.array(F.lit(" καλοῦσιν"), F.lit(" ὀνομάζω"), F.lit(" else")), (F.col("p_partkey") % 3).cast("int"))
    text = F.concat("p_name", F.expr("repeat(' x', p_size)"), cue)
    return t.part.select("p_partkey", X.alias_context(text, F.lit(0), F.length("p_name")).alias("alias"))


@query("""SELECT p_partkey, p_name AS name, p_size::VARCHAR AS size, CASE WHEN p_partkey % 2 = 0 THEN 'a: b' END AS note FROM part""")
def q_labelled_lines(t: Tables) -> DataFrame:
    """Lines with labels, read as a map: the first of a label counts, a value may hold a colon."""
    text = F.concat(F.lit("Name:  "), "p_name", F.lit("\nno label\n Size : "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "\nNote: a: b").otherwise(""), F.lit("\nName: other"))
    held = X.labelled_lines(text)
    return t.part.select("p_partkey", *[F.element_at(held, k).alias(k.lower()) for k in ("Name", "Size", "Note")])


@query(
    """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * CAST(floor(o_totalprice) AS BIGINT) // (1 + o_orderkey % 7 * o_orderkey % 90001) AS n FROM orders)
       SELECT o_orderkey, CASE WHEN n >= 1073741824 THEN format('{:,.1f}', n / 1073741824.0) || ' GB' WHEN n >= 1048576 THEN format('{:,.1f}', n / 1048576.0) || ' MB' WHEN n >= 1024 THEN format('{:,.1f}', n / 1024.0) || ' KB' ELSE n || ' B' END AS size FROM s"""
)
def q_file_size(t: Tables) -> DataFrame:
    whole = F.floor("o_totalprice").cast("long")
    n = F.call_function("div", whole * whole, 1 + F.col("o_orderkey") % 7 * F.col("o_orderkey") % 90001)
    return t.orders.select("o_orderkey", X.file_size(n).alias("size"))


@query(
    """WITH h AS (SELECT doc_id, text, strpos(lower(strip_accents(text)), 'the') AS p FROM documents), s AS (SELECT doc_id, CASE WHEN p > 0 THEN substr(text, greatest(1, p - 55), p + 65 - greatest(1, p - 55)) ELSE substr(text, 1, 110) END AS snippet FROM h)
       SELECT doc_id, CAST(nullif(strpos(lower(strip_accents(snippet)), 'the'), 0) - 1 AS INTEGER) AS "start", CAST(nullif(strpos(lower(strip_accents(snippet)), 'the'), 0) + 2 AS INTEGER) AS "end" FROM s"""
)
def q_highlight(t: Tables) -> DataFrame:
    """Where the query stands in the snippet that a search shows."""
    at = F.call_function("locate", X.fold(F.lit("Thé")), X.fold(F.col("text")))
    rows = t.documents.select("doc_id", X.search_snippet(F.col("text"), at).alias("snippet"))
    span = X.find_folded(F.col("snippet"), F.lit("Thé"))
    return rows.select("doc_id", span["start"].alias("start"), span["end"].alias("end"))


@query(
    """SELECT l_orderkey, l_linenumber, 'XI' AS volume, CAST(l_partkey AS INTEGER) AS page, l_linenumber AS line, CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_partkey + 1 ELSE l_partkey END AS INTEGER) AS end_page,
         CAST(CASE WHEN l_linenumber % 3 = 0 THEN 4 WHEN l_linenumber % 3 = 1 THEN l_linenumber + 2 ELSE l_linenumber END AS INTEGER) AS end_line FROM lineitem"""
)
def q_citation_parse(t: Tables) -> DataFrame:
    """Citations written in their shortest form and parsed again."""
    n, page = F.col("l_linenumber"), F.col("l_partkey")
    end_page, end_line = F.when(n % 3 == 0, page + 1).otherwise(page), F.when(n % 3 == 0, 4).when(n % 3 == 1, n + 2).otherwise(n)
    parsed = X.parse_citation(X.citation(F.lit("XI"), page, n, end_page, end_line))
    return t.lineitem.select("l_orderkey", "l_linenumber", parsed.alias("c")).select("l_orderkey", "l_linenumber", "c.volume", "c.page", "c.line", "c.end_page", "c.end_line")


@query(
    r"""SELECT page_id, tag, text FROM (SELECT page_id, 'h1' AS tag, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS text FROM pages UNION ALL SELECT page_id, 'p', 'a' || chr(10) || page_id FROM pages) WHERE text <> ''"""
)
def q_post_blocks(t: Tables) -> DataFrame:
    """Titles of pages and a paragraph as the blocks of posts, with nested elements inside and other paragraphs after them."""
    html = F.concat(F.lit('<div id="a"><div class="x post-content"><h1>'), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("</h1><div><p>a<br/><b>"), F.col("page_id").cast("string"), F.lit("</b></p></div></div><p>after</p></div><p>footer</p>"))
    return t.pages.select("page_id", F.explode(files.post_blocks(html)).alias("b")).select("page_id", "b.*")


@query("""SELECT p_name || ' ' || p_partkey AS line FROM part WHERE p_partkey % 3 > 0""")
def q_line_list(t: Tables) -> DataFrame:
    """Lines written and read again without blanks and comments."""
    path = scratch.folder(t.spark)
    line = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    third = F.col("p_partkey") % 6
    files.write_lines(t.part.select(F.when(third == 0, F.concat(F.lit("# "), line)).when(third == 3, "   ").otherwise(F.concat(F.lit("  "), line, F.lit(" "))).alias("value")), path)
    return files.read_lines(t.spark, path)
