"""License scans by diagonal voting, in DataFrame operations only.

The words of each text give rolling hashes of ``K`` words.  They are joined to
the hashes of the license templates; a hit of text position p on template
position t whose words are the same, one by one, is a vote for the diagonal
p - t, so that spans stand on words and not on hashes.  Votes are added up per document,
template and diagonal; diagonals that lie within ``GAP`` words of each other
(words left out or put in) are merged into a span; a span stands if its votes
make up ``COVERED`` of the template's hashes and it is not spread over far more
words than the template has.

The explosion into hashes is narrow and is aggregated before anything is
shuffled, so that what travels is a row per document and diagonal.

Edge cases: null and empty texts have no words; texts shorter than ``K`` words
have no hashes and no labels; rows that repeat are scanned each (rows are told
apart by number, not by key); a template of fewer than ``K`` words is an error.
"""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 3
GAP = 4
COVERED = 0.6

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases whose exact places are counted, and their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Statements by which well-known licenses are recognised.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by", "licensed under a creative commons attribution 4.0 international license"),
]


def template_hashes(spark, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row per template position: ``hash``, ``template``, ``at``, ``label``, ``exact`` and ``size`` (hashes of the template)."""
    rows = []
    for number, (label, phrase, exact) in enumerate([(*x, True) for x in base] + [(*x, False) for x in templates]):
        words = re.findall(WORD, phrase.lower())
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {phrase!r}")
        rows += [(*words[i : i + K], number, i, label, exact, len(words) - K + 1) for i in range(len(words) - K + 1)]
    names = [f"w{i}" for i in range(K)]
    table = spark.createDataFrame(rows, ", ".join([f"{x} string" for x in names]) + ", template int, at int, label string, exact boolean, size int")
    return table.select(F.xxhash64(*names).alias("hash"), F.concat_ws(" ", *names).alias("gram"), "template", "at", "label", "exact", "size")


def scan(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, and ``spans``.

    A span has label, exact, start, stop (words from 0, stop not included) and
    covered (the part of the template's hashes that voted for it).
    """
    spark = docs.sparkSession
    templates = template_hashes(spark) if templates is None else templates
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase)
    words = F.array_remove(F.split(lower, BETWEEN), "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words.alias("words"))
    hashes = F.when(
        F.size("words") >= K,
        F.transform(F.sequence(F.lit(0), F.size("words") - K), lambda i: F.struct(F.xxhash64(*[F.get("words", i + j) for j in range(K)]).alias("hash"), F.concat_ws(" ", F.slice("words", i + 1, F.lit(K))).alias("gram"))),
    )
    # the words stay below the explosion: they would be carried along with every hash
    hashed = rows.select("row", "key", F.size("words").cast("long").alias("n_words"), hashes.alias("hashes"))
    rolled = hashed.select("row", "key", "n_words", F.posexplode_outer("hashes").alias("pos", "run")).select("row", "key", "n_words", "pos", "run.hash", "run.gram")
    # the templates are a fixed list of a few hundred positions
    voted = rolled.join(F.broadcast(templates), ["hash", "gram"], "left")
    per_row = ["row", "key", "n_words"]
    template = ["template", "label", "exact", "size"]
    diagonals = voted.groupBy(*per_row, *template, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("start"), (F.max("pos") + K).alias("stop"))
    along = Window.partitionBy(*per_row, *template).orderBy("diagonal")
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    spans = merged.groupBy(*per_row, *template, "span").agg(F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    covered = F.least(F.lit(1.0), F.col("votes") / F.col("size"))
    close = F.col("stop") - F.col("start") <= F.col("size") + K - 1 + 2 * GAP
    stands = F.when(F.col("exact"), F.col("votes") == F.col("size")).otherwise((covered >= COVERED) & close)
    span = F.struct("label", "exact", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), covered.alias("covered"))
    return spans.groupBy(*per_row).agg(F.array_sort(F.collect_list(F.when(stands, span))).alias("spans")).select(F.col("key").alias(key), "n_words", "spans")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, places, labels and a score from 0 to 1 (the best cover of a span; 0 without one)."""
    base = F.filter("spans", lambda s: s["exact"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["start"])
    return scanned.select(
        key,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0)).alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
),
p AS (
  SELECT row_number() OVER () AS template, label, is_exact, regexp_extract_all(phrase, '{WORD}') AS w
  FROM (SELECT *, true AS is_exact FROM (VALUES {_values(BASE)}) AS a(label, phrase)
        UNION ALL SELECT *, false FROM (VALUES {_values(TEMPLATES)}) AS b(label, phrase))
),
pk AS (
  SELECT template, label, is_exact, len(w) - {K - 1} AS size, t, list_slice(w, t + 1, t + {K}) AS gram
  FROM (SELECT *, unnest(range(0, len(w) - {K - 1})) AS t FROM p)
),
dk AS (
  SELECT doc_id, pos, list_slice(w, pos + 1, pos + {K}) AS gram FROM (SELECT *, unnest(range(0, len(w) - {K - 1})) AS pos FROM d WHERE len(w) >= {K})
),
v AS (
  SELECT doc_id, template, label, is_exact, size, pos - t AS diagonal, count(*) AS votes, min(pos) AS s, max(pos) + {K} AS e
  FROM dk JOIN pk USING (gram) GROUP BY ALL
),
m AS (
  SELECT *, sum(CASE WHEN is_exact OR apart IS NULL OR apart > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span
  FROM (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS apart FROM v)
),
s AS (
  SELECT doc_id, template, label, is_exact, size, span, sum(votes) AS votes, min(s) AS s, max(e) AS e FROM m GROUP BY ALL
),
g AS (
  SELECT * FROM s WHERE CASE WHEN is_exact THEN votes = size ELSE least(1.0, votes / size) >= {COVERED} AND e - s <= size + {K - 1 + 2 * GAP} END
)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words,
       CAST(count(*) FILTER (is_exact) AS BIGINT) AS n_base,
       CAST(min(s) FILTER (is_exact) AS BIGINT) AS first_word, CAST(max(s) FILTER (is_exact) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_exact), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
       CAST(coalesce(max(least(1.0, votes / size)) FILTER (label IS NOT NULL), 0) AS DOUBLE) AS score
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""
