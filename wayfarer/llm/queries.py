"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.llm import ann, balltree, bpe, decontaminate, embdedup, html, jaccard, langid, licenses, linededup, lm, merkle, urlfilter
from wayfarer.llm._shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: five words, Jaccard 0.8."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements in every whole text."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE_SQL["op3_licenses"] = licenses.SQL


@query
def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from two thirds of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    filters = langid.train(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), filters).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a window of ten words of a benchmark item, and the items."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=3)
    n_items = F.size("items").cast("long")
    return found.select(
        F.col("doc").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        n_items.alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; digests of ids and bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated runs of lines that hold ten words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


ORACLE_SQL["op8_linededup"] = """
WITH l AS (
  SELECT doc_id, i, line, line_words,
         sum(line_words) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM (SELECT doc_id, i, lines[i] AS line,
               len(list_filter(regexp_split_to_array(lines[i], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS line_words
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
              FROM documents WHERE text IS NOT NULL))
),
w AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.upto - a.upto + a.line_words >= 10 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.i >= a.i AND b.upto - a.upto + a.line_words >= 10 GROUP BY b.doc_id, b.i
),
t AS (
  SELECT w.doc_id, s, e, array_to_string(list_slice(string_split(text, chr(10)), s, e), chr(10)) AS run
  FROM w JOIN documents d ON d.doc_id = w.doc_id
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY e - s, run ORDER BY doc_id, s) AS copy FROM t) WHERE copy > 1
),
g AS (SELECT doc_id, list(i) AS cut FROM gone GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN cut IS NULL THEN text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda x: NOT list_contains(cut, x)), lambda x: string_split(text, chr(10))[x]), chr(10)), '') END AS text,
       CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""


@query
def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPM and word unigram scores of every whole text, learned from nine tenths of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", langid.held_out(F.col("doc_id"), 10, 0).alias("held_out"))
    model = lm.train(docs.where("NOT held_out"))
    return lm.score_with_unigrams(docs, model)


@query
def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the lists as they stood when it was fetched (a day of 2024 by page number)."""
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))
    return urlfilter.evaluate(captures, urlfilter.list_entries(spark)).withColumn("fetched", F.col("fetched").cast("string"))


ORACLE_SQL["op10_urlfilter"] = urlfilter.SQL


@query
def op11_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every hundredth vector; every seventh row carries the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return balltree.mine(vectors, F.col("vec_id") % 100 == 0)


ORACLE_SQL["op11_balltree"] = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.v) = len(b.v)
),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf and its proof for every document; every seventh, by hash, is checked after its n_chars was changed."""
    c = F.col
    longer = F.when(F.crc32(c("doc_id").cast("string").cast("binary")) % 7 == 0, c("n_chars").cast("decimal(20,0)") + 1).otherwise(c("n_chars"))
    leaf = merkle.leaf_digest(c("doc_id"), c("source"), c("lang"), c("n_chars"), c("text"))
    changed = merkle.leaf_digest(c("doc_id"), c("source"), c("lang"), longer, c("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", leaf.alias("leaf"), changed.alias("changed"))
    proved = merkle.manifest(rows).withColumn("folded_root", merkle.fold(c("changed"), c("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(c("proof")).alias("proof_sha256"), "folded_root", (c("folded_root") == c("root")).alias("verified"))


ORACLE_SQL["op12_merkle"] = """
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents
),
f AS (
  SELECT doc_id, lang, n_chars, crc IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 AS hit,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS z
  FROM d
),
l AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
    sha256(a || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || z) AS changed
  FROM f
),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM l),
nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM p
  UNION ALL
  SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2, n
),
subroots AS (SELECT tree, level AS top, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM upper WHERE n > 1 GROUP BY level, place // 2, n
),
path AS (
  SELECT p.doc_id, p.leaf, p.changed, p.tree, s.subroot, s.place AS tree_place, s.top, 0 AS level, p.place, p.n, p.changed AS folded, '' AS proof FROM p JOIN subroots s USING (tree)
  UNION ALL
  SELECT q.doc_id, q.leaf, q.changed, q.tree, q.subroot, q.tree_place, q.top, q.level + 1,
    q.place // 2,
    (q.n + 1) // 2,
    CASE WHEN o.digest IS NULL THEN sha256(q.folded) WHEN q.place % 2 = 0 THEN sha256(q.folded || o.digest) ELSE sha256(o.digest || q.folded) END,
    q.proof || coalesce(o.digest, '')
  FROM path q LEFT JOIN nodes o ON o.tree = q.tree AND o.level = q.level AND o.place = xor(q.place, 1)
  WHERE q.level < q.top
),
path2 AS (
  SELECT doc_id, leaf, subroot, 0 AS level, tree_place AS place, (SELECT count(*) FROM subroots) AS n, folded, proof FROM path WHERE level = top
  UNION ALL
  SELECT q.doc_id, q.leaf, q.subroot, q.level + 1, q.place // 2, (q.n + 1) // 2,
    CASE WHEN o.digest IS NULL THEN sha256(q.folded) WHEN q.place % 2 = 0 THEN sha256(q.folded || o.digest) ELSE sha256(o.digest || q.folded) END,
    q.proof || coalesce(o.digest, '')
  FROM path2 q LEFT JOIN upper o ON o.level = q.level AND o.place = xor(q.place, 1)
  WHERE q.n > 1
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM path2, (SELECT digest AS root FROM upper WHERE n = 1) WHERE n = 1
"""


@query
def op13_embdedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every vector, within its label, at a cosine of 0.98."""
    return embdedup.dedup(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op13_embdedup"] = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98
),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) c ON c.a = vec_id
LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = vec_id
"""
