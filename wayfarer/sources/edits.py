"""Edits of raw texts by offsets, attributes around spans, and claims read back from them with their errors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions import keyed
from wayfarer.functions import text as X
from wayfarer.sources.tei import batches, plain


def refused(edits: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The edits (``start``, ``end``) that can be made together, and those that share a place with one that begins before them (or is the longer of two that begin together)."""
    earlier = Window.partitionBy(key).orderBy("start", F.desc("end"), "order").rowsBetween(Window.unboundedPreceding, -1)
    # two insertions at one place share none
    seen = edits.withColumn("_until", F.max("end").over(earlier))
    crosses = F.coalesce(F.col("_until") > F.col("start"), F.lit(False))
    return seen.where(~crosses).drop("_until"), seen.where(crosses).drop("_until")


def apply_edits(texts: DataFrame, key: str, text: str, edits: DataFrame) -> DataFrame:
    """``texts`` after edits (``start``, ``end``, ``replacement``, ``order``) that do not overlap, all by offsets (from 0) into the raw text."""
    held = edits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "order", "replacement"))).alias("_edits"))
    raw = F.col(text)
    before = lambda e, i: F.substr(raw, F.when(i > 0, F.get("_edits", i - 1)["end"]).otherwise(0) + 1, e["start"] - F.when(i > 0, F.get("_edits", i - 1)["end"]).otherwise(0))
    pieces = F.transform("_edits", lambda e, i: F.concat(before(e, i), e["replacement"]))
    whole = F.concat(F.array_join(pieces, ""), F.substr(raw, F.element_at("_edits", -1)["end"] + 1))
    return texts.join(held, key, "left").withColumn(text, F.when(F.col("_edits").isNotNull(), whole).otherwise(raw)).drop("_edits")


def attributes(pairs: list[tuple[str, Column]]) -> Column:
    """`` name="value"`` for each pair in order whose value is neither null nor empty, escaped."""
    return F.concat(*[F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f' {n}="'), X.html_escape(v.cast("string")), F.lit('"'))).otherwise("") for n, v in pairs])


_HEAD = re.compile(r'<div type="textpart" subtype="(book|chapter)"(?: n="([^"]+)">)?')


def _blocks(x: str) -> Iterator[tuple[str | None, str, str, int]]:
    heads, book = list(_HEAD.finditer(x)), None
    for m, end in zip(heads, [*(h.start() for h in heads), len(x)][1:], strict=True):
        if m[2] and m[1] == "book":
            book = m[2]
        elif m[2]:
            yield book, m[2], x[m.start() : end], m.start()


def _read(texts: DataFrame, key: str, text: str, rows: Callable[[str], Iterator[tuple]], columns: dict[str, str], heavy: int) -> DataFrame:
    """A row for each that ``rows`` finds in a text, in the task that holds it."""
    kinds = {"string": pa.string(), "int": pa.int32()}

    def found(part: pa.RecordBatch) -> Iterator[tuple]:
        for k, x in zip(part.column(key), part.column(text), strict=True):
            k = k.as_py()
            yield from ((k, *row) for row in rows(x.as_py() or ""))

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in given:
            yield from batches(found(part), {key: part.schema.field(key).type} | {n: kinds[t] for n, t in columns.items()}, heavy)

    return texts.select(key, text).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in ({key: texts.schema[key].dataType.simpleString()} | columns).items()))


def chapter_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``book``, ``chapter``, ``block`` (raw, from its opening tag to the next chapter or book) and its ``at`` in the raw text."""
    return _read(texts, key, text, _blocks, {"book": "string", "chapter": "string", "block": "string", "at": "int"}, 3)


def annotate_claims(texts: DataFrame, key: str, text: str, claims: DataFrame, pairs: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Claims (``key``, ``book``, ``chapter``, ``surface``, ``order`` and columns of ``pairs``) as ``placeName`` elements around their surfaces, and the claims that found no place, with ``reason``.

    A claim takes the first place of its surface in the raw block of its chapter.
    All are edits of the raw text, so no claim is found in an attribute of another; of two
    that overlap the later one is refused.
    """
    blocks = chapter_blocks(texts, key, text)
    met = claims.join(blocks, [key, "book", "chapter"], "left").withColumn("_found", F.call_function("locate", F.col("surface"), F.col("block")))
    reason = F.when(F.col("block").isNull(), "no chapter").when((F.col("_found") == 0) | (F.col("surface") == ""), "no surface")
    met = met.withColumn("reason", reason)
    start = F.col("at") + F.col("_found") - 1
    edits = met.where("reason IS NULL").withColumns({"start": start, "end": start + F.length("surface")})
    edits = edits.withColumn("replacement", F.concat(F.lit("<placeName"), attributes(pairs), F.lit(">"), "surface", F.lit("</placeName>")))
    made, crossed = refused(edits, key)
    out = [key, "book", "chapter", "order", "surface", "reason"]
    errors = met.where("reason IS NOT NULL").select(out).unionByName(crossed.withColumn("reason", F.lit("overlap")).select(out))
    return apply_edits(texts, key, text, made.select(key, "start", "end", "replacement", "order")), errors


_ELEMENT = re.compile(r"(?s)<placeName\b[^>]*>.*?</placeName>")
_ATTRIBUTE = re.compile(r'([\w:.-]+)\s*=\s*"([^"]*)"')
_NOTE, _TAG, _SPACES = re.compile(r"(?s)<note\b.*?</note>"), re.compile("<[^>]*>"), re.compile(r"[ \t\n\f\r]+")
#: What is read of an element.
_SAID = ["ingredient_key", "relation", "ref", "claim_order", "cert", "evidence_phrase", "warnings"]


def _said(x: str) -> str:
    return _SPACES.sub(" ", plain(_TAG.sub("", _NOTE.sub("", x)))).strip(" ")


def _elements(x: str) -> Iterator[tuple]:
    """The claims of a text, with the places of evidence (else the surface) and surface in the text of their chapter."""
    for book, chapter, block, _ in _blocks(x):
        body = None
        for node, m in enumerate(_ELEMENT.finditer(block)):
            held = {n: plain(v) for n, v in _ATTRIBUTE.findall(_TAG.match(m[0])[0])}
            if held.get("ingredient_key"):
                body = body or keyed.Folded(_said(block))
                surface = _said(m[0])
                spans = [body.find(keyed.key_text(n).rstrip(" ")) or (None, None) for n in (held.get("evidence_phrase") or surface, surface)]
                yield (book, chapter, node, surface, *(held.get(n, "") for n in _SAID), *spans[0], *spans[1])


# Confidence by certainty.
CONFIDENCE = {"secure": 1.0, "high": 0.95, "probable": 0.85, "ambiguous": 0.65, "low": 0.45}


def claims(texts: DataFrame, key: str, text: str, places: DataFrame, deprecated: tuple[str, ...] = (), confidence: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Claims of annotated TEI (``placeName`` with ``ingredient_key``), and those that break a rule, with ``reason``: none stops the others.

    Offsets are those of the evidence phrase (else the surface) and of the surface in the
    chapter's text without notes and with white space collapsed.  ``places``: ``place_id``,
    ``title``, ``precision``, ``broad``.
    """
    columns = {"book": "string", "chapter": "string", "node": "int", "surface": "string", **dict.fromkeys(_SAID, "string"), **dict.fromkeys(["e0", "e1", "s0", "s1"], "int")}
    found = _read(texts, key, text, _elements, columns, 4)
    span = lambda a, b: F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("start"), F.col(b).alias("end")))
    found = found.select(
        key, "book", "chapter", "node", "surface", "ingredient_key", "relation", F.regexp_extract("ref", r"(\d+)/?$", 1).alias("place_id"), "claim_order",
        F.when(F.col("cert") == "", "secure").otherwise(F.col("cert")).alias("cert"), F.when(F.col("evidence_phrase") == "", F.col("surface")).otherwise(F.col("evidence_phrase")).alias("evidence"),
        F.filter(F.split("warnings", r"\s+"), lambda w: w != "").alias("warnings"), span("e0", "e1").alias("evidence_span"), span("s0", "s1").alias("place_span"),
    )
    found = found.join(places.select("place_id", "title", "precision", "broad", F.lit(True).alias("_known")), "place_id", "left")
    reason = (
        F.when(F.col("place_id") == "", "no reference").when(F.col("place_id").isin(*deprecated), "deprecated reference").when(F.col("_known").isNull(), "unknown place").when(F.col("relation") == "", "no relation")
        .when(~F.col("claim_order").rlike(r"^\d+$"), "no numeric order").when(F.col("evidence_span").isNull(), "evidence not in text").when(F.col("place_span").isNull(), "surface not in text")
    )
    found = found.withColumn("reason", reason)
    sure = confidence or CONFIDENCE
    table = F.create_map(*[F.lit(v) for pair in sure.items() for v in pair])
    more = F.array(F.when(F.col("broad"), "broad_region_representative_point"), F.when(F.coalesce("precision", F.lit("")).isin("", "precise"), None).otherwise("uncertain_coordinate_precision"))
    warned = F.array_sort(F.array_distinct(F.concat("warnings", F.filter(more, lambda w: w.isNotNull()))))
    claim_id = X.stable_id("tei-claim", F.col("ingredient_key"), F.concat_ws(".", F.col(key).cast("string"), "book", "chapter"), F.col("claim_order").cast("long"), F.col("surface"), F.col("relation"), F.col("place_id"))
    good = found.where("reason IS NULL").select(
        claim_id.alias("claim_id"), key, "book", "chapter", "ingredient_key", "relation", "place_id", F.col("title").alias("place_label"), F.col("claim_order").cast("long").alias("claim_order"), "surface", "evidence",
        "evidence_span", "place_span", "cert", F.coalesce(F.element_at(table, F.col("cert")), F.lit(0.75)).alias("confidence"), warned.alias("warnings"),
    )
    return good, found.where("reason IS NOT NULL").select(key, "book", "chapter", "node", "ingredient_key", "surface", "reason")
