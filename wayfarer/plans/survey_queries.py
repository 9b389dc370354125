"""Spans in phases, sentence hits and unmatched names: T04, T05, A16."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.operators import survey as S
from wayfarer.plans.registry import Tables, query

_VERBS = {"movement": ["er", "the", "de"], "autopsy": ["und", "les"]}
_SPANS = """
w AS (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[a-z]+') AS w FROM benchmark),
one AS (SELECT item_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) u(i)),
cur AS (SELECT w[2] || ' ' || w[3] AS lemma, list_sort(list(DISTINCT 'b' || item_id)) AS ids FROM w WHERE len(w) >= 7 GROUP BY 1 UNION ALL SELECT w[5], list_sort(list(DISTINCT 'b' || item_id)) FROM w WHERE len(w) >= 7 GROUP BY 1),
exact AS (SELECT word AS lemma, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM one WHERE length(word) >= 6 GROUP BY 1),
lem AS (SELECT w[6] AS word, min(w[7]) AS lemma FROM w WHERE len(w) >= 7 GROUP BY 1),
away AS (SELECT w[1] AS word FROM w WHERE len(w) >= 7 UNION SELECT w[4] FROM w WHERE len(w) >= 7),
f AS (SELECT doc_id, text, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS form FROM documents WHERE text IS NOT NULL),
ph AS (
  SELECT doc_id, text, lemma, ids, string_split(form, lemma) AS gaps FROM f JOIN cur ON contains(lemma, ' ') AND contains(form, lemma)
),
p1 AS (
  SELECT doc_id, CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + (k - 1) * length(lemma) AS INTEGER) AS s, CAST(s + length(lemma) AS INTEGER) AS e, substr(text, s + 1, length(lemma)) AS surface, lemma, ids, 'curator' AS match_type, CASE WHEN len(ids) = 1 THEN 'secure' ELSE 'ambiguous' END AS cert
  FROM ph, unnest(range(1, len(gaps))) u(k)
),
pc AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+')) AS surface, unnest(range(1, 1 + len(regexp_extract_all(text, '\\p{L}+|[^\\p{L}]+')))) AS i FROM f),
tk AS (SELECT *, CAST(sum(length(surface)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS e, CAST(e - length(surface) AS INTEGER) AS s FROM pc),
big AS (SELECT t.*, lower(strip_accents(surface)) AS word FROM tk t WHERE regexp_matches(surface, '^\\p{L}') AND regexp_matches(strip_accents(surface), '^\\p{Lu}') AND regexp_matches(strip_accents(surface), '\\p{Ll}') AND length(strip_accents(surface)) >= 3),
free AS (SELECT b.*, coalesce(lem.lemma, b.surface) AS shown, lower(strip_accents(coalesce(lem.lemma, b.surface))) AS lemma FROM big b LEFT JOIN lem ON lem.word = b.word WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.doc_id = b.doc_id AND p1.s < b.e AND b.s < p1.e)),
jd AS (
  SELECT free.*, cur.ids AS c_ids, exact.ids AS x_ids, free.word IN (SELECT word FROM away) OR free.lemma IN (SELECT word FROM away) AS gone FROM free LEFT JOIN cur ON cur.lemma = free.lemma LEFT JOIN exact ON exact.lemma = free.lemma
),
spans AS (
  SELECT doc_id, s, e, surface, lemma, ids, match_type, cert FROM p1
  UNION ALL
  SELECT doc_id, s, e, surface, shown, coalesce(c_ids, x_ids), CASE WHEN c_ids IS NOT NULL THEN 'curator' WHEN len(x_ids) = 1 THEN 'greek' ELSE 'ambiguous' END, CASE WHEN len(coalesce(c_ids, x_ids)) = 1 THEN 'secure' ELSE 'ambiguous' END
  FROM jd WHERE c_ids IS NOT NULL OR (x_ids IS NOT NULL AND NOT gone)
)
"""


def _spans(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Benchmark words as names, stop words, persons and lemmas; documents as sentences."""
    w = t.benchmark.select("item_id", F.regexp_extract_all(X.fold(F.col("text")), F.lit("([a-z]+)"), 1).alias("w"))
    whole = w.where(F.size("w") >= 7)
    word = lambda i: F.get("w", F.lit(i))
    ids = lambda x: F.array_sort(F.collect_set(x)).alias("ids")
    named = F.explode(F.array(F.concat_ws(" ", word(1), word(2)), word(4))).alias("lemma")
    curated = whole.select("item_id", named).groupBy("lemma").agg(ids(F.concat(F.lit("b"), F.col("item_id").cast("string"))))
    exact = w.select("item_id", F.explode("w").alias("lemma")).where(F.length("lemma") >= 6).groupBy("lemma").agg(ids(F.col("item_id").cast("string")))
    lemmas = whole.groupBy(word(5).alias("word")).agg(F.min(word(6)).alias("lemma"))
    return S.phase_spans(t.documents.select("doc_id", "text"), "doc_id", "text", curated, exact, exact.where("false"), lemmas, whole.select(word(0).alias("word")), whole.select(word(3).alias("word")), r"\p{L}+")


@query(f"""WITH {_SPANS} SELECT doc_id, s AS "start", e AS "end", surface, lemma, array_to_string(ids, ',') AS ids, match_type, cert FROM spans""")
def q_phase_spans(t: Tables) -> DataFrame:
    return _spans(t)[0].withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH {_SPANS} SELECT surface, count(*) AS n FROM jd WHERE c_ids IS NULL AND x_ids IS NULL AND NOT gone GROUP BY 1""")
def q_unmatched_names(t: Tables) -> DataFrame:
    """Capitalised words that no list explains, with their counts."""
    return _spans(t)[1]


@query(
    f"""WITH {_SPANS}, m AS (SELECT doc_id, list(surface ORDER BY s, e) AS mentions FROM (SELECT doc_id, min(s) AS s, arg_min(e, s) AS e, arg_min(surface, s) AS surface FROM spans GROUP BY doc_id, lemma, list_sort(ids)) GROUP BY 1),
       v AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[a-z]+') AS held FROM documents),
       h AS (SELECT doc_id, list_filter(['de:movement', 'er:movement', 'les:autopsy', 'the:movement', 'und:autopsy'], lambda x: list_contains(held, split_part(x, ':', 1))) AS verbs FROM v)
       SELECT h.doc_id, coalesce(array_to_string(mentions, ','), '') AS mentions, coalesce(array_to_string(verbs, ','), '') AS verbs, mentions IS NOT NULL AND coalesce(len(verbs), 0) > 0 AS is_hit FROM h LEFT JOIN m USING (doc_id)"""
)
def q_sentence_hits(t: Tables) -> DataFrame:
    """Documents that hold both a place and a verb form."""
    found = S.sentence_hits(t.documents.select("doc_id", "text"), "doc_id", "text", _spans(t)[0], _VERBS, "a-z")
    verbs = F.transform("verbs", lambda v: F.concat(v["form"], F.lit(":"), v["category"]))
    return found.select("doc_id", F.coalesce(F.array_join("mentions.surface", ","), F.lit("")).alias("mentions"), F.array_join(verbs, ",").alias("verbs"), "is_hit")
