"""TEI sentences: a text is read in one pass, and one longer than a segment in parts dealt to tasks, with what a reader would remember carried from part to part."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.sources.scratch import written

#: Letters of a text that are read in one pass; longer texts are cut and dealt out. The work of a task depends on it, the results do not.
SEGMENT = 1 << 20
#: Rows and letters of a batch that a task gives back.
_ROWS, _LETTERS = 20_000, 1 << 22

_PIECE = re.compile(r"(?sa)(?P<text>[^<]+)|<!--.*?-->|<!\[CDATA\[(?P<raw>.*?)\]\]>|<\?.*?\?>|<(?P<end>/?)(?:[\w.-]+:)?(?P<tag>[\w.-]*)[^>]*>")
#: What may hold a "<" that begins no piece.
_CLOSED = re.compile(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>")
_PART = re.compile(r"[^.;·]*[.;·]|[^.;·]+")
_ATTRIBUTE = re.compile(r"""\s([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_REFERENCE = re.compile(r"&(?:#([0-9]+)|#[xX]([0-9a-fA-F]+)|(lt|gt|quot|apos|amp));")
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
_WHITE = " \t\n\f\r"
#: Elements whose content is not said.
_SILENT = {"note", "pb", "lb"}


def _letter(m: re.Match) -> str:
    code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else ord(_NAMED[m[3]])
    return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else m[0]


def plain(x: str) -> str:
    """A text with its character references as characters; each is read once."""
    return _REFERENCE.sub(_letter, x) if "&" in x else x


def _page(tag: str) -> str:
    return next((plain(a if a is not None else b) for n, a, b in (m.groups() for m in _ATTRIBUTE.finditer(tag)) if n == "n"), "")


def _scan(xml: str, depth: int, page: str | None) -> tuple[list[tuple], str | None, int]:
    """``page``, ``line``, ``end_page``, ``end_line``, ``said``, ``ended`` of each sentence, or part of one at the end, and the last page and line.

    ``depth`` silent elements are open at the beginning.  Lines are counted from
    there while the page is the given one; a part without letters has no line.
    """
    rows, line = [], 0
    said, first = "", (None, None)
    for m in _PIECE.finditer(xml):
        kind = m.lastgroup
        if kind == "tag":
            if m["tag"] not in _SILENT:
                continue
            if m["end"]:
                depth -= 1
                continue
            if not depth and m["tag"] == "pb":
                page, line = _page(m[0]), 0
            elif not depth and m["tag"] == "lb":
                line += 1
            depth += not m[0].endswith("/>")
        elif kind and not depth:
            for part in _PART.findall(plain(m[0]) if kind == "text" else m["raw"]):
                if first[1] is None and part.strip(_WHITE):
                    first = page, line
                said += part
                if part[-1] in ".;·":
                    rows.append((*first, page, line, said, True))
                    said, first = "", (None, None)
    if said:
        rows.append((*first, page, line, said, False))
    return rows, page, line


def _depths(xml: str) -> tuple[int, int]:
    """By how much a part of a text changes the number of open silent elements, and the least it comes to on the way."""
    step = least = 0
    for m in _PIECE.finditer(xml):
        if m.lastgroup == "tag" and m["tag"] in _SILENT:
            step += -1 if m["end"] else not m[0].endswith("/>")
            least = min(least, step)
    return step, least


def _cut(xml: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` letters, cut only between pieces."""
    closed, at = _CLOSED.finditer(xml), 0
    span = (0, 0)
    while len(xml) - at > size and (to := xml.find("<", at + size)) >= 0:
        while span and span[1] <= to:
            span = next((m.span() for m in closed), None)
        to = span[1] if span and span[0] < to else to
        yield xml[at:to]
        at = to
    yield xml[at:]


_SPOKEN = {"number": pa.int64(), "page": pa.string(), "line": pa.int32(), "end_page": pa.string(), "end_line": pa.int32(), "said": pa.string(), "ended": pa.bool_()}


def batches(found: Iterator[tuple], kinds: dict[str, pa.DataType], heavy: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches that are bounded in rows and in the letters of the text at place ``heavy`` of a row."""
    held, letters = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))

    for row in found:
        held.append(row)
        letters += len(row[heavy] or "")
        if len(held) == _ROWS or letters > _LETTERS:
            yield batch()
            held, letters = [], 0
    if held:
        yield batch()


def _short(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences of texts that are read in one pass."""

    def read(part: pa.RecordBatch) -> Iterator[tuple]:
        for k, xml in zip(part.column(key), part.column(text), strict=True):
            k = k.as_py()
            for n, (page, line, *rest) in enumerate(_scan(xml.as_py(), 0, "")[0]):
                if line is not None:
                    yield (k, n, page, line, *rest)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in given:
            yield from batches(read(part), {key: part.schema.field(key).type} | _SPOKEN, 6)

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, number long, page string, line int, end_page string, end_line int, said string, ended boolean").drop("ended")


def _long(texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """The same of longer texts: their parts are read where they are dealt to, each from the least depth on that it comes to, and set right by what the parts before hold."""
    kind = texts.schema[key].dataType.simpleString()

    def cut(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in given:
            for k, xml in zip(part.column(key), part.column(text), strict=True):
                for seq, x in enumerate(_cut(xml.as_py(), size)):
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], k.type), pa.array([seq], pa.int32()), pa.array([x])], [key, "seq", "xml"])

    def read(part: pa.RecordBatch) -> Iterator[tuple]:
        for k, seq, xml in zip(part.column(key), part.column("seq"), part.column("xml"), strict=True):
            k, seq, xml = k.as_py(), seq.as_py(), xml.as_py()
            step, least = _depths(xml)
            rows, page, line = _scan(xml, -least, None)
            for n, row in enumerate(rows):
                yield (k, n, *row, seq, None, None)
            # what the part leaves behind; ``number``: the sentences that end in it
            yield (k, sum(r[5] for r in rows), page, line, None, None, None, None, seq, step, least)

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in given:
            yield from batches(read(part), {key: part.schema.field(key).type} | _SPOKEN | {"seq": pa.int32(), "step": pa.int32(), "least": pa.int32()}, 6)

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select(key, text).mapInArrow(cut, f"`{key}` {kind}, seq int, xml string").repartition(parts, key, "seq")
    rows = written(dealt.mapInArrow(run, f"`{key}` {kind}, number long, page string, line int, end_page string, end_line int, said string, ended boolean, seq int, step int, least int"))
    # parts of one text, in order
    order = Window.partitionBy(key).orderBy("seq")
    before, until, all_parts = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    states = rows.where("step IS NOT NULL").select(key, "seq", "number", "page", "line", "step", "least")
    # a part that lies in a note as a whole says nothing
    states = states.withColumn("live", F.coalesce(F.sum("step").over(before), F.lit(0)) + F.col("least") == 0)
    live = lambda c: F.when(F.col("live"), F.col(c))
    states = states.withColumns({"_before": F.coalesce(F.sum(live("number")).over(before), F.lit(0)), "_lines": F.coalesce(F.sum(live("line")).over(until), F.lit(0))})
    states = states.withColumn("_at", F.last(F.when(F.col("live") & F.col("page").isNotNull(), F.struct("page", (F.col("_lines") - F.col("line")).alias("lines"))), ignorenulls=True).over(until))
    states = states.withColumn("_now", F.struct(F.coalesce("_at.page", F.lit("")).alias("page"), (F.col("_lines") - F.coalesce("_at.lines", F.lit(0))).cast("int").alias("line")))
    states = states.withColumns({"_in": F.coalesce(F.lag("_now").over(order), F.struct(F.lit("").alias("page"), F.lit(0).alias("line"))), "_last": F.last("_now").over(all_parts)})
    spoken = rows.where("said IS NOT NULL").select(key, "seq", "number", "page", "line", "end_page", "end_line", "said", "ended").join(states.where("live").select(key, "seq", "_before", "_in", "_last"), [key, "seq"])
    place = lambda page, line: F.struct("seq", F.coalesce(page, "_in.page").alias("page"), (F.col(line) + F.when(F.col(page).isNull(), F.col("_in.line")).otherwise(0)).alias("line"))
    spoken = spoken.withColumns({"number": F.col("_before") + F.col("number"), "_first": F.when(F.col("line").isNotNull(), place("page", "line")), "_stop": F.when(F.col("ended"), place("end_page", "end_line"))})
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "said"))), lambda p: p["said"]), "")
    whole = spoken.groupBy(key, "number").agg(F.min("_first").alias("first"), F.max("_stop").alias("stop"), F.first("_last").alias("last"), said.alias("said")).where("first IS NOT NULL")
    done = lambda c: F.coalesce(F.col(f"stop.{c}"), F.col(f"last.{c}")).alias(f"end_{c}")
    return whole.select(key, "number", F.col("first.page").alias("page"), F.col("first.line").alias("line"), done("page"), done("line"), "said")


def sentences(texts: DataFrame, key: str, text: str, size: int = SEGMENT) -> DataFrame:
    """``key``, ``number`` (from 0 in each text), ``page``, ``line``, ``end_page``, ``end_line`` and ``sentence``: the rows of ``files.tei_sentences``.

    ``key`` must be unique and not null, texts well-formed.  The page is the last
    ``pb`` before a piece, the line the count of ``lb`` since that page, and a
    sentence ends where a piece ends in a stop.  What notes, ``pb`` and ``lb``
    hold is left out.  A text of more than ``size`` letters is shared out among
    tasks; others stay in the task that reads them, and nothing of them is
    shuffled.
    """
    rows = _short(texts.where(F.length(text) <= size), key, text).unionByName(_long(texts.where(F.length(text) > size), key, text, size))
    return rows.withColumn("sentence", F.trim(F.regexp_replace("said", r"[ \t\n\f\r]+", " "))).drop("said")
