"""Finding names in texts: spans, phases, relations and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.operators.trie import name_spans


def token_mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Names of one word: the lower-cased words of the texts met with the names, with their place."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return texts.select(key, F.posexplode(words).alias("at", name)).join(names, name)


def unpivot(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row for each field that is not empty: ``field`` and ``text``."""
    return df.unpivot(key, fields, "field", "text").where("text IS NOT NULL AND text <> ''")


def span_mentions(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, own: str | None = None) -> DataFrame:
    """Non-overlapping mentions of names (given in key form): more words first, then longer, then by text.

    A text is walked once over a trie of the names' words.  Only accepted spans take up their
    place.  A span is accepted if it touches no letters or digits, is none of
    the text's ``own`` names (an array column), begins with a capital, and
    stands in no alias context.  Yields key, name, surface, start, end (in the
    original text).
    """
    return name_spans(texts, key, text, names, name, own, X.ALIAS_CUES, 35)


def phased(tokens: DataFrame, key: list[str], token: str, curated: DataFrame, stop: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens by curated list, else by dictionary unless they are stop words; ``match_type`` and ``cert`` say how."""
    found = tokens.join(curated.select(F.col(token), F.col("id").alias("_a")), token, "left")
    found = found.join(stop.select(F.col(token), F.lit(True).alias("_stop")), token, "left").join(dictionary.select(F.col(token), F.col("id").alias("_b")), token, "left")
    free = F.col("_b").isNotNull() & F.col("_stop").isNull()
    kind = F.when(F.col("_a").isNotNull(), "curated").when(free, "dictionary")
    return found.withColumn("match_type", kind).where("match_type IS NOT NULL").select(*key, token, F.coalesce("_a", "_b").alias("id"), "match_type", F.when(F.col("match_type") == "curated", "high").otherwise("medium").alias("cert"))


def classify(text: Column, rules: list[tuple[str, list[str]]], default: str, guard: tuple[Column, str] | None = None) -> Column:
    """The first rule with a needle in the padded text; a guard goes before all rules."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    out = None if guard is None else F.when(guard[0], guard[1])
    for name, needles in rules:
        hit = F.contains(padded, F.lit(needles[0]))
        for n in needles[1:]:
            hit = hit | F.contains(padded, F.lit(n))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def linkify(texts: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Names in the text marked up as ``[[name]]``: leftmost first, then the longest; no overlaps; whole words only.

    Texts and names meet by a join on the name's first word, so that a text is
    searched for its own names only, by a pattern of its own.
    """
    folded = X.fold_key(F.col(name))
    raw = names.select(F.col(name).alias("_raw"), folded.alias("_name")).distinct()
    first = F.regexp_extract("_name", r"([\p{L}\p{N}]+)", 1)
    words = texts.select(key, F.explode(F.array_distinct(X.tokens(X.fold_key(F.col(text))))).alias("_word"))
    held = words.join(raw.withColumn("_word", first), "_word").groupBy(key).agg(F.array_sort(F.collect_set(F.struct((-F.length("_raw")).alias("n"), "_raw"))).alias("_held"))
    escaped = F.transform("_held", lambda r: F.regexp_replace(r["_raw"], r"([\\.\[\]{}()*+?^$|])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])("), F.array_join(escaped, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    joined = texts.join(held, key, "left")
    return joined.withColumn(text, F.when(F.col("_held").isNull(), F.col(text)).otherwise(F.regexp_replace(F.col(text), pattern, F.lit("[[$1]]")))).drop("_held")
