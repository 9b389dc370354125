"""Places and first-person verbs of sentences: spans in phases, deduplicated mentions, hits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.operators import grams as G
from wayfarer.operators import trie
from wayfarer.sources.scratch import written

# First-person verb forms without marks, by what they tell.
VERBS = {
    "movement": "επορευθην επλευσα εισεπλευσα ανεπλευσα απεπλευσα διεπλευσα παρεπλευσα αφικομην ηκον διηλθον επεδημησα διετριψα παρεγενομην παρην ανηλθον κατηλθον εξηλθον ηλθον επανηλθον απηλθον ωρμησα ανεβην κατεβην εχωρησα απεχωρησα εβαδισα εβαδιζον ηπειγομην".split(),
    "autopsy": "ειδον εθεασαμην εθεωρησα κατενοησα παρεθεασαμην εωρακα".split(),
    "acquisition": "εκομισα εκομισαμην ανεκομισα ελαβον ευρον εχρησαμην εσκευασαμην επριαμην εσκεψαμην εποιησαμην ηγαγον".split(),
}
# Letters of Greek words, and what joins two of them to one token.
GREEK = "Ͱ-Ͽἀ-῿"
TOKEN = rf"[{GREEK}]+(?:[ʼ'’][{GREEK}]+)*"

SPAN = ["start", "end", "surface", "lemma", "ids", "match_type", "cert"]


def phrases_and_words(texts: DataFrame, key: str, text: str, curated: DataFrame, pattern: str) -> DataFrame:
    """Curated names of several words in the key form of a text, inflected or not, at every place that the same name has not taken before; and the words of ``pattern`` that they leave free, have three letters, a large first and not only large ones.

    ``key``, ``start``, ``end`` (of the original text), ``surface``, ``name`` (null: a
    word) and ``word`` (its key form, null: a name).  A text is read once: a name is looked for only where
    the letters around its first space stand around a space of the text.
    """
    names = curated.where(F.contains("lemma", F.lit(" "))).select(F.col("lemma").alias("_name")).distinct()
    rows = texts.select(key, F.col(text).alias("_text")).where("_text IS NOT NULL")
    # at most one row more than may be held
    held = [r[0] for r in names.limit(trie.HELD_NAMES + 1).collect()]
    whole = None
    if len(held) <= trie.HELD_NAMES:
        whole = texts.sparkSession.sparkContext.broadcast(held)
        rows = rows.withColumn("_names", F.lit(None).cast("array<string>"))
    else:
        forms = rows.select(key, X.fold_key(F.col("_text")).alias("_form"))
        met = G.containing(forms, [key], "_form", names, "_name").groupBy(key).agg(F.collect_set("_name").alias("_names"))
        rows = rows.join(met, key, "left").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, phrases = regex.compile(pattern), trie.Phrases(whole.value) if whole else None
        for b in batches:
            for k, value, own in zip(b[key], b["_text"].to_pylist(), b["_names"].to_pylist(), strict=True):
                out = list((phrases or trie.Phrases(own)).spans(value))
                free = trie.Free([(s, e) for s, e, _ in out])
                out = [(s, e, value[s:e], n, None) for s, e, n in out]
                for m in word.finditer(value):
                    if not m[0].islower() and trie.is_large(m[0]) and free(m.start(), m.end()):
                        out.append((m.start(), m.end(), m[0], None, trie.key_form(m[0])))
                for at in range(0, len(out), 50_000):
                    columns = list(zip(*out[at : at + 50_000], strict=True))
                    some = [pa.array([k.as_py()] * len(columns[0]), b.schema.field(key).type), *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)]]
                    yield pa.RecordBatch.from_arrays(some, [key, "start", "end", "surface", "name", "word"])

    kind = texts.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, start int, end int, surface string, name string, word string")


def phase_spans(texts: DataFrame, key: str, text: str, curated: DataFrame, exact: DataFrame, variants: DataFrame, lemmas: DataFrame, stop: DataFrame, persons: DataFrame, pattern: str = TOKEN) -> tuple[DataFrame, DataFrame]:
    """Spans of places in three phases, and the capitalised tokens that none explains.

    First the curated names of several words, anywhere.  Then, of the tokens that
    they leave free, have three letters, a large first and not only large ones:
    those whose lemma is a curated name; else, unless token or lemma is a stop
    word or a person, those whose lemma has ``ids`` in ``exact`` or, in any
    Latin spelling (the first that has some), in ``variants``.  ``lemmas`` gives
    ``word`` and ``lemma``; ``stop`` and ``persons`` a ``word``; all others ``lemma``
    and ``ids``; keys are in key form.
    """
    met = written(phrases_and_words(texts, key, text, curated, pattern))
    cert = F.when(F.size("ids") == 1, "secure").otherwise("ambiguous")
    first = met.where("name IS NOT NULL").join(curated.select(F.col("lemma").alias("name"), "ids"), "name")
    first = first.select(key, "start", "end", "surface", F.col("name").alias("lemma"), "ids", F.lit("curator").alias("match_type"), cert.alias("cert"))
    words = met.where("name IS NULL").drop("name")
    # distinct surfaces are few beside the tokens
    known = words.select("surface", "word").distinct().join(lemmas.select("word", F.col("lemma").alias("_lemma")), "word", "left")
    known = known.withColumn("shown", F.coalesce("_lemma", "surface")).withColumn("lemma", X.fold_key(F.col("shown")))
    for name, table in (("_curated", curated), ("_exact", exact)):
        known = known.join(table.select("lemma", F.col("ids").alias(name)), "lemma", "left")
    spelled = known.where("_curated IS NULL AND _exact IS NULL").select("lemma", F.posexplode(X.transliterations(F.col("shown"))).alias("at", "name"))
    spelled = spelled.join(variants.select(F.col("lemma").alias("name"), F.col("ids").alias("_variant")), "name").groupBy("lemma").agg(F.min_by("_variant", "at").alias("_variant"))
    known = known.join(spelled, "lemma", "left")
    for name, table in (("_stop", stop), ("_person", persons)):
        table = table.select(F.col("word").alias("_w")).distinct()
        for column in ("word", "lemma"):
            known = known.join(table.select(F.col("_w").alias(column), F.lit(True).alias(f"{name}_{column}")), column, "left")
    left_out = F.coalesce("_stop_word", "_stop_lemma", "_person_word", "_person_lemma", F.lit(False))
    ids = F.coalesce("_curated", F.when(~left_out, F.coalesce("_exact", "_variant")))
    how = F.when(F.col("_curated").isNotNull(), "curator").when(F.col("_exact").isNotNull(), "greek").otherwise("latin")
    one = F.size(ids) == 1
    cert = F.when(one & how.isin("curator", "greek"), "secure").when(one, "probable").otherwise("ambiguous")
    kind = F.when(one | (how == "curator"), how).otherwise("ambiguous")
    known = known.select("surface", "word", "shown", ids.alias("ids"), kind.alias("match_type"), cert.alias("cert"), (ids.isNull() & ~left_out).alias("open"))
    known = written(known)
    judged = words.join(known, ["surface", "word"])
    spans = judged.where("ids IS NOT NULL").select(key, "start", "end", "surface", F.col("shown").alias("lemma"), "ids", "match_type", "cert")
    unmatched = words.join(known.where("open").select("surface", "word"), ["surface", "word"]).groupBy("surface").agg(F.count("*").alias("n"))
    return first.unionByName(spans), unmatched


def verb_hits(text: Column, verbs: dict[str, list[str]] | None = None, letters: str = GREEK) -> Column:
    """The verb forms that stand in a text as whole words, sorted, each with its category."""
    held = F.array_distinct(F.regexp_extract_all(X.fold(text), F.lit(f"([{letters}]+)"), 1))
    rows = [F.struct(F.lit(f).alias("form"), F.lit(c).alias("category")) for c, forms in (verbs or VERBS).items() for f in forms]
    return F.array_sort(F.filter(F.array(*rows), lambda r: F.array_contains(held, r["form"])))


def sentence_hits(sentences: DataFrame, key: str, text: str, spans: DataFrame, verbs: dict[str, list[str]] | None = None, letters: str = GREEK) -> DataFrame:
    """``sentences`` with ``mentions`` (each lemma with the same ids once, in text order), ``verbs`` and ``is_hit`` (both)."""
    same = spans.withColumn("_ids", F.array_sort("ids")).groupBy(key, "lemma", "_ids").agg(F.min(F.struct(*SPAN)).alias("m"))
    held = same.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("mentions"))
    out = sentences.join(held, key, "left").withColumn("verbs", F.coalesce(verb_hits(F.col(text), verbs, letters), F.array().cast("array<struct<form:string,category:string>>")))
    return out.withColumn("is_hit", F.col("mentions").isNotNull() & (F.size("verbs") > 0))
