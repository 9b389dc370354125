"""From raw documents to token ids, in five stages.

Each stage takes the rows that its predecessor kept, and its decisions take
effect: documents whose language is not recognised go, later copies of repeated
runs of lines are cut out of the texts, one document of each near-duplicate
group stays, documents that hold a passage of a benchmark item go, and what is
left is encoded.  All stages but the last return the columns of ``documents``.

Edge cases: documents with a null or letterless text go in the first stage; a
document that line dedup empties goes with its lines; of rows that share an id
one stays after the third stage; rows with a null id are never told apart from
their copies and stay; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.llm import bpe, decontaminate, jaccard, langid, linededup
from wayfarer.llm._shared import table, written

#: Least score with which a language counts as recognised.
SURE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised by filters learned from the labelled ones."""
    found = langid.predict(docs, langid.train(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; ``n_chars`` follows the text."""
    shorter = linededup.dedup_lines(docs).where("n_removed = 0 OR n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return shorter.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    first = jaccard.join(docs).where("doc_id = component_id").select("doc_id").distinct().withColumn("first", F.lit(True))
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    kept = docs.join(first, "doc_id", "left").withColumn("row", row)
    return kept.where("doc_id IS NULL OR (first AND row = 1)").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    return docs.join(found.select(F.col("doc").cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids of the byte-level vocabulary."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("bpe", encoding),
]

#: Language filters, components and merge replay are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
