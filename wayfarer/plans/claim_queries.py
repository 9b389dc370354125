"""Attributes written into TEI by offsets, and claims read back with their errors: S27, T08."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.plans.registry import Tables, query
from wayfarer.sources import edits as E

_CLAIMS = """
x AS (SELECT doc_id, i, lines[i] AS line, '<div type="textpart" subtype="chapter" n="' || i || '"><p>' || replace(replace(replace(replace(replace(lines[i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || '</p></div>' AS block
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) u(i)),
w AS (SELECT *, regexp_extract_all(line, '[a-z]{5,}')[2] AS s0 FROM x WHERE i <= 3),
c AS (
  SELECT doc_id, i AS chapter, (i - 1)::VARCHAR AS ord, CASE WHEN doc_id % 11 = 0 AND i = 2 THEN 'zzz' ELSE s0 END AS surface, i - 1 AS o FROM w WHERE s0 IS NOT NULL
  UNION ALL SELECT doc_id, 1, '7', s0[1:4], 7 FROM w WHERE s0 IS NOT NULL AND i = 1
  UNION ALL SELECT doc_id, 9999, '8', 'none', 8 FROM documents WHERE doc_id % 10 = 0
),
d AS (
  SELECT c.*, x.block, x.line, CASE WHEN doc_id % 13 = 0 THEN '' ELSE (doc_id % 120)::VARCHAR END AS pid, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'grows_in' END AS relation, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE ord END AS said_order,
    CASE WHEN doc_id % 19 = 0 THEN surface || ' & "more"' WHEN doc_id % 3 = 0 THEN upper(surface) ELSE '' END AS evidence, ['secure', 'low', 'else'][doc_id % 3 + 1] AS cert, CASE WHEN doc_id % 5 = 0 THEN 'b_note a_note' ELSE '' END AS warnings
  FROM c LEFT JOIN (SELECT doc_id AS xd, i, line, block FROM x) x ON xd = c.doc_id AND x.i = c.chapter
),
f AS (SELECT *, CASE WHEN block IS NOT NULL AND strpos(block, surface) > 0 THEN strpos(block, surface) END AS p, CASE WHEN block IS NULL THEN 'no chapter' WHEN strpos(block, surface) = 0 THEN 'no surface' END AS early FROM d),
k AS (SELECT a.*, b.p AS q, b.surface AS other FROM f a LEFT JOIN f b ON b.doc_id = a.doc_id AND b.chapter = a.chapter AND b.o <> a.o AND b.p IS NOT NULL),
r AS (
  SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN q < p AND q + length(other) > p THEN 'overlap' WHEN q = p AND length(other) > length(surface) THEN 'overlap' END AS reason,
    '<placeName' || CASE WHEN pid <> '' THEN ' ref="https://places/' || pid || '"' ELSE '' END || ' cert="' || cert || '" ingredient_key="m' || doc_id % 9 || '"' || CASE WHEN relation <> '' THEN ' relation="' || relation || '"' ELSE '' END || ' claim_order="' || said_order || '"'
      || CASE WHEN evidence <> '' THEN ' evidence_phrase="' || replace(replace(evidence, '&', '&amp;'), '"', '&quot;') || '"' ELSE '' END || CASE WHEN warnings <> '' THEN ' warnings="' || warnings || '"' ELSE '' END || '>' || surface || '</placeName>' AS element FROM k
),
e AS (SELECT doc_id, chapter, list({'p': p, 'n': length(surface), 'e': element} ORDER BY p) AS es FROM r WHERE reason IS NULL GROUP BY ALL),
b AS (
  SELECT x.doc_id, x.i, CASE WHEN es IS NULL THEN block WHEN len(es) = 1 THEN substr(block, 1, es[1].p - 1) || es[1].e || substr(block, es[1].p + es[1].n)
    ELSE substr(block, 1, es[1].p - 1) || es[1].e || substr(block, es[1].p + es[1].n, es[2].p - es[1].p - es[1].n) || es[2].e || substr(block, es[2].p + es[2].n) END AS block
  FROM x LEFT JOIN e ON e.doc_id = x.doc_id AND e.chapter = x.i
),
g AS (
  SELECT r.*, CASE WHEN evidence = '' THEN surface ELSE evidence END AS phrase, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS body, s_suppkey, s_name, s_nationkey, s_nationkey % 5 = 0 AS broad, CASE s_nationkey % 3 WHEN 0 THEN 'precise' WHEN 1 THEN 'rough' ELSE '' END AS precision
  FROM r LEFT JOIN supplier ON s_suppkey::VARCHAR = pid WHERE reason IS NULL
),
h AS (
  SELECT *, lower(strip_accents(body)) AS fb, CASE WHEN pid = '' THEN 'no reference' WHEN pid = '4' THEN 'deprecated reference' WHEN s_suppkey IS NULL THEN 'unknown place' WHEN relation = '' THEN 'no relation' WHEN said_order = 'x' THEN 'no numeric order'
    WHEN NOT contains(lower(strip_accents(body)), lower(strip_accents(phrase))) THEN 'evidence not in text' END AS bad FROM g
)
"""


def _written(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents as TEI with a chapter for each line, and claims on words of the first three lines, some of them faulty."""
    lines = F.split("text", "\n")
    chapter = lambda x, i: F.concat(F.lit('<div type="textpart" subtype="chapter" n="'), (i + 1).cast("string"), F.lit('"><p>'), X.html_escape(x), F.lit("</p></div>"))
    xml = F.concat(F.lit('<TEI><div type="textpart" subtype="book" n="1">'), F.array_join(F.transform(lines, chapter), ""), F.lit("</div></TEI>"))
    texts = t.documents.where("text IS NOT NULL").select("doc_id", xml.alias("xml"))
    d = F.col("doc_id")
    word = F.regexp_extract_all("line", F.lit("([a-z]{5,})"), 1)
    first = t.documents.select("doc_id", F.posexplode(F.slice(lines, 1, 3)).alias("i", "line")).withColumn("s0", F.get(word, F.lit(1))).where("s0 IS NOT NULL")
    row = lambda c, o, s: F.struct(c.cast("string").alias("chapter"), o.cast("int").alias("order"), s.alias("surface"))
    own = row(F.col("i") + 1, F.col("i"), F.when((d % 11 == 0) & (F.col("i") == 1), "zzz").otherwise(F.col("s0")))
    second = F.when(F.col("i") == 0, row(F.lit(1), F.lit(7), F.substring("s0", 1, 4)))
    claims = first.select("doc_id", F.explode(F.filter(F.array(own, second), lambda c: c.isNotNull())).alias("c")).select("doc_id", "c.*")
    nowhere = t.documents.where(d % 10 == 0).select("doc_id", F.lit("9999").alias("chapter"), F.lit(8).alias("order"), F.lit("none").alias("surface"))
    claims = claims.unionByName(nowhere).withColumn("book", F.lit("1"))
    pairs = [
        ("ref", F.when(d % 13 != 0, F.concat(F.lit("https://places/"), (d % 120).cast("string")))),
        ("cert", F.get(F.array(F.lit("secure"), F.lit("low"), F.lit("else")), (d % 3).cast("int"))),
        ("ingredient_key", F.concat(F.lit("m"), (d % 9).cast("string"))),
        ("relation", F.when(d % 7 != 0, "grows_in")),
        ("claim_order", F.when(d % 17 == 0, "x").otherwise(F.col("order").cast("string"))),
        ("evidence_phrase", F.when(d % 19 == 0, F.concat("surface", F.lit(' & "more"'))).when(d % 3 == 0, F.upper("surface"))),
        ("warnings", F.when(d % 5 == 0, "b_note a_note")),
    ]
    return E.annotate_claims(texts, "doc_id", "xml", claims, pairs)


def _read(t: Tables) -> tuple[DataFrame, DataFrame]:
    precision = F.get(F.array(F.lit("precise"), F.lit("rough"), F.lit("")), (F.col("s_nationkey") % 3).cast("int"))
    places = t.supplier.select(F.col("s_suppkey").cast("string").alias("place_id"), F.col("s_name").alias("title"), precision.alias("precision"), (F.col("s_nationkey") % 5 == 0).alias("broad"))
    return E.claims(_written(t)[0], "doc_id", "xml", places, ("4",))


@query(f"""WITH {_CLAIMS} SELECT doc_id, sha1('<TEI><div type="textpart" subtype="book" n="1">' || string_agg(block, '' ORDER BY i) || '</div></TEI>') AS xml FROM b GROUP BY 1""")
def q_attribute_edits(t: Tables) -> DataFrame:
    return _written(t)[0].select("doc_id", F.sha1("xml").alias("xml"))


@query(f"""WITH {_CLAIMS} SELECT doc_id, chapter::VARCHAR AS chapter, CAST(o AS INTEGER) AS "order", surface, reason FROM r WHERE reason IS NOT NULL""")
def q_edits_refused(t: Tables) -> DataFrame:
    return _written(t)[1].select("doc_id", "chapter", "order", "surface", "reason")


@query(
    f"""WITH {_CLAIMS} SELECT doc_id, chapter::VARCHAR AS chapter, 'tei-claim-' || substr(sha1('m' || doc_id % 9 || '␟' || doc_id || '.1.' || chapter || '␟' || said_order || '␟' || surface || '␟' || relation || '␟' || pid), 1, 12) AS claim_id, s_name AS place_label, surface,
         CAST(strpos(fb, lower(strip_accents(phrase))) - 1 AS INTEGER) AS evidence_start, CAST(strpos(fb, lower(strip_accents(surface))) - 1 AS INTEGER) AS place_start, CASE cert WHEN 'secure' THEN 1.0 WHEN 'low' THEN 0.45 ELSE 0.75 END::DOUBLE AS confidence,
         array_to_string(list_sort(list_concat(CASE WHEN warnings = '' THEN [] ELSE ['a_note', 'b_note'] END, CASE WHEN broad THEN ['broad_region_representative_point'] ELSE [] END, CASE WHEN precision = 'rough' THEN ['uncertain_coordinate_precision'] ELSE [] END)), ' ') AS warnings
       FROM h WHERE bad IS NULL"""
)
def q_claims(t: Tables) -> DataFrame:
    """Claims as they are read back from the annotated texts."""
    return _read(t)[0].select("doc_id", "chapter", "claim_id", "place_label", "surface", F.col("evidence_span.start").alias("evidence_start"), F.col("place_span.start").alias("place_start"), "confidence", F.array_join("warnings", " ").alias("warnings"))


@query(f"""WITH {_CLAIMS} SELECT doc_id, chapter::VARCHAR AS chapter, surface, bad AS reason FROM h WHERE bad IS NOT NULL""")
def q_claim_errors(t: Tables) -> DataFrame:
    return _read(t)[1].select("doc_id", "chapter", "surface", "reason")
