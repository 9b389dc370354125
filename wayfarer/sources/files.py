"""File sources and sinks: CSV, JSON, lines, Markdown, HTML, XML, KML and GeoJSON, through Spark's readers and writers.

Readers take a path or glob of any file system Spark knows and return one row
per record; documents that must be walked as a whole (XML, KML, HTML) are read
one file per row and walked in a small function per file.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators.sorting import numbered

# ------------------------------------------------------------------ tables


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, plain or gzipped, all columns strings; fields may span lines and be of any length."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, field: str | None = None) -> DataFrame:
    """JSON documents: an array of records, or an object that holds them in ``field``."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if field is None:
        return reader.schema(schema).json(path)
    return reader.schema(f"`{field}` array<struct<{schema}>>").json(path).select(F.inline(field))


def read_json_map(spark: SparkSession, path: str, field: str, value: str, key: str = "key") -> DataFrame:
    """An object whose ``field`` maps keys to records of type ``value``: a row for each key."""
    found = spark.read.option("multiLine", True).schema(f"`{field}` map<string, {value}>").json(path)
    return found.select(F.explode(field).alias(key, "value"))


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per file; ``stem`` is the file's name without its ending; files that can't be read as the record are left out."""
    rows = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return rows.withColumn("stem", stem).where("_corrupt IS NULL").drop("_corrupt")


def parse_assigned(text: Column, schema: str) -> Column:
    """The JSON that a script assigns: ``var name = {...};``"""
    return F.from_json(F.regexp_replace(F.regexp_replace(text, r"^\s*(?:var|let|const)?\s*[\w.$]+\s*=\s*", ""), r";\s*$", ""), schema)


def enabled_sources(registry: DataFrame, existing: DataFrame) -> DataFrame:
    """Sources that are not switched off, each with its ``path``: the annotated one if it is among the ``existing`` paths."""
    there = existing.select(F.col("path").alias("annotated_path"), F.lit(True).alias("_there"))
    rows = registry.where(F.coalesce("enabled", F.lit(True))).join(there, "annotated_path", "left")
    return rows.withColumn("path", F.when(F.col("_there"), F.col("annotated_path")).otherwise(F.col("raw_path"))).drop("_there")


# ------------------------------------------------------------------ texts


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: ``path`` and ``text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")


def anchors(text: Column) -> Column:
    """The distinct ids of the elements of a page."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit('\\sid="([^"]+)"'), 1)))


def section_blocks(texts: DataFrame, text: str) -> DataFrame:
    """The blocks of a Markdown text that begin with ``## §n``: ``section`` and ``block`` (without its header)."""
    blocks = texts.withColumn("_block", F.explode(F.split(F.col(text), r"(?m)^(?=## §)")))
    section = F.regexp_extract("_block", r"^## §(\d+)", 1)
    return blocks.where(section != "").select(*[c for c in texts.columns if c != text], section.cast("int").alias("section"), F.regexp_replace("_block", r"^## §[^\n]*\n?|\s+$", "").alias("block"))


def marked_names(block: Column) -> Column:
    """The names between asterisks, without comments."""
    return F.regexp_extract_all(F.regexp_replace(block, r"(?s)<!--.*?-->", ""), F.lit(r"\*([^*\n]+)\*"), 1)


def post_blocks(html: Column) -> Column:
    """Headings and paragraphs of ``div.post-content``, up to the tag that closes it: ``tag`` and ``text``, ``br`` as a line end."""
    rest = F.regexp_extract(html, r'(?s)<div[^>]*class="[^"]*post-content[^"]*"[^>]*>(.*)', 1)
    # pieces that begin with a div's tag; depth 0 is outside for good
    step = lambda p: F.when(p.rlike(r"^<div\b"), 1).when(p.startswith("</div"), -1).otherwise(0)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("body"))
    inside = lambda a, p: F.struct(F.when(a["depth"] == 0, 0).otherwise(a["depth"] + step(p)).alias("depth"), F.when((a["depth"] == 0) | (a["depth"] + step(p) == 0), a["body"]).otherwise(F.concat(a["body"], p)).alias("body"))
    body = F.aggregate(F.split(rest, r"(?=<div\b|</div\b)"), start, inside, lambda a: a["body"])
    tag = F.regexp_extract_all(body, F.lit(r"(?s)<(h1|h2|p)\b[^>]*>.*?</\1>"), 1)
    inner = F.regexp_extract_all(body, F.lit(r"(?s)<(h1|h2|p)\b[^>]*>(.*?)</\1>"), 2)
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<br\s*/?>", "\n"), r"<[^>]*>", ""))
    return F.filter(F.zip_with(tag, inner, lambda a, b: F.struct(a.alias("tag"), plain(b).alias("text"))), lambda r: r["text"] != "")


# ------------------------------------------------------------------ XML


def _walked(texts: DataFrame, text: str, walk: Callable[[str], list[tuple]], columns: dict[str, str]) -> DataFrame:
    """A row for each record that ``walk`` finds in a text, beside the other columns."""
    keep = [c for c in texts.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keep).schema] + [f"{n} {t}" for n, t in columns.items()])
    kinds = {"string": pa.string(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i, value in enumerate(part.column(text).to_pylist()):
                rows = walk(value) if value else []
                if rows:
                    own = [part.column(c).take(pa.array([i] * len(rows))) for c in keep]
                    found = [pa.array(list(c), kinds[t]) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays(own + found, [*keep, *columns])

    return texts.mapInArrow(run, schema)


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _spoken(element: ET.Element) -> str:
    """The text of an element without its notes."""
    out = [element.text or ""]
    for child in element:
        if _name(child) != "note":
            out.append(_spoken(child))
        out.append(child.tail or "")
    return "".join(out)


def tei_chapters(texts: DataFrame, text: str) -> DataFrame:
    """Chapters of TEI documents: ``book``, ``chapter``, ``refs`` (of its place names, space-joined) and ``body`` without notes."""

    def walk(xml: str) -> list[tuple]:
        rows = []
        for book in (d for d in ET.fromstring(xml).iter() if _name(d) == "div" and d.get("subtype") == "book"):
            for chapter in (d for d in book.iter() if _name(d) == "div" and d.get("subtype") == "chapter"):
                refs = " ".join(p.get("ref", "") for p in chapter.iter() if _name(p) == "placeName")
                rows.append((book.get("n"), chapter.get("n"), refs, " ".join(_spoken(chapter).split())))
        return rows

    return _walked(texts, text, walk, {"book": "string", "chapter": "string", "refs": "string", "body": "string"})


def tei_sentences(texts: DataFrame, text: str) -> DataFrame:
    """Sentences of TEI documents with the page and line where they begin and end.

    ``pb`` sets the page and begins its lines anew, ``lb`` counts a line.  The
    state runs through a document from its start, so a document is one walk.
    """

    def walk(xml: str) -> list[tuple]:
        rows, page, line = [], "", 0
        said, start = "", None

        def say(value: str | None) -> None:
            nonlocal said, start
            for piece in re.split(r"(?<=[.;·])", value or ""):
                if piece.strip() and start is None:
                    start = (page, line)
                said += piece
                if re.search(r"[.;·]\s*$", piece) and said.strip():
                    rows.append((*start, page, line, " ".join(said.split())))
                    said, start = "", None

        def visit(element: ET.Element) -> None:
            nonlocal page, line
            kind = _name(element)
            if kind == "pb":
                page, line = element.get("n", ""), 0
            elif kind == "lb":
                line += 1
            elif kind != "note":
                say(element.text)
                for child in element:
                    visit(child)
                    say(child.tail)

        visit(ET.fromstring(xml))
        if said.strip():
            rows.append((*start, page, line, " ".join(said.split())))
        return rows

    return _walked(texts, text, walk, {"page": "string", "line": "int", "end_page": "string", "end_line": "int", "sentence": "string"})


def kml_features(texts: DataFrame, text: str) -> DataFrame:
    """Placemarks of KML documents: ``folder`` (path), ``name``, ``kind`` and ``coordinates`` (as text), a row for each geometry that has enough points."""
    least = {"Point": 1, "LineString": 2, "Polygon": 4}

    def walk(xml: str) -> list[tuple]:
        rows: list[tuple] = []

        def visit(node: ET.Element, folders: tuple[str, ...]) -> None:
            for child in node:
                if _name(child) in ("Folder", "Document"):
                    name = next((c.text or "" for c in child if _name(c) == "name"), "")
                    visit(child, (*folders, name.strip()) if _name(child) == "Folder" else folders)
                elif _name(child) == "Placemark":
                    name = next((c.text or "" for c in child if _name(c) == "name"), "").strip()
                    for shape in (s for s in child.iter() if _name(s) in least):
                        given = next((c.text or "" for c in shape.iter() if _name(c) == "coordinates"), "")
                        if len(given.split()) >= least[_name(shape)]:
                            rows.append((" / ".join(folders), name, _name(shape), " ".join(given.split())))

        visit(ET.fromstring(xml), ())
        return rows

    return _walked(texts, text, walk, {"folder": "string", "name": "string", "kind": "string", "coordinates": "string"})


def points(coordinates: Column) -> Column:
    """``lon,lat[,height] ...`` as an array of [lon, lat]."""
    pairs = F.transform(F.split(F.trim(coordinates), r"\s+"), lambda p: F.transform(F.slice(F.split(p, ","), 1, 2), lambda v: v.try_cast("double")))
    return F.filter(pairs, lambda p: (F.size(p) == 2) & ~F.exists(p, lambda v: v.isNull()))


def geometry(kind: Column, coordinates: Column) -> Column:
    """The GeoJSON geometry of a placemark, as JSON."""
    at = points(coordinates)
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.get(at, F.lit(0)).alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), at.alias("coordinates")))
    ring = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(at).alias("coordinates")))
    return F.when(kind == "Point", point).when(kind == "LineString", line).otherwise(ring)


# ------------------------------------------------------------------ sinks


def features(df: DataFrame, lat: str, lon: str, properties: list[str]) -> Column:
    """Rows as GeoJSON point features, as JSON; null properties are left out."""
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties")))


def write_lines(lines: DataFrame, path: str) -> None:
    """One column of text as files of lines."""
    lines.write.text(path)


def write_csv(df: DataFrame, path: str, fields: list[str], gzip: bool = False) -> None:
    """CSV with a header and these columns in this order."""
    df.select(*fields).write.option("header", True).option("escape", '"').option("compression", "gzip" if gzip else "none").csv(path)


def pretty(record: Column) -> Column:
    """A record as JSON over several lines."""
    return F.to_json(record, {"pretty": "true"})


def stamped(df: DataFrame, stamp: dict[str, str]) -> DataFrame:
    """A copy with a new stamp in front; stamps of before are dropped."""
    return df.select(*[F.lit(v).alias(k) for k, v in stamp.items()], *[c for c in df.columns if c not in stamp])


def annotated(text: Column, spans: Column) -> Column:
    """Text with ``placeName`` elements around its spans (array of start, end, ref, cert; from 0, not overlapping), from the last to the first."""
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    down = F.reverse(F.array_sort(spans))

    def wrap(so_far: Column, s: Column) -> Column:
        inner = F.substr(so_far, s["start"] + 1, s["end"] - s["start"])
        mark = F.concat(F.lit('<placeName ref="'), escape(s["ref"]), F.lit('" cert="'), escape(s["cert"]), F.lit('">'), inner, F.lit("</placeName>"))
        return F.concat(F.substr(so_far, F.lit(1), s["start"]), mark, F.substr(so_far, s["end"] + 1))

    return F.aggregate(down, text, wrap)


def report(title: str, df: DataFrame, cells: list[str], order: list) -> DataFrame:
    """A Markdown table as ordered lines (``number``, ``line``): header lines below 1, then a line for each row."""
    head = df.sparkSession.createDataFrame([(-3, f"# {title}"), (-2, ""), (-1, f"| {' | '.join(cells)} |"), (0, "|" + "---|" * len(cells))], "number int, line string")
    escaped = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cells]
    rows = numbered(df, order, "number").select("number", F.concat(F.lit("| "), F.concat_ws(" | ", *escaped), F.lit(" |")).alias("line"))
    return head.unionByName(rows)


def curator_block(section: Column, chunk: Column, prose: Column, hints: Column) -> Column:
    """The Markdown block of a section for curators: header, hints as a comment, and prose."""
    return F.concat(F.lit("## §"), section.cast("string"), F.lit(" — "), chunk, F.lit("\n<!-- hints: "), F.array_join(hints, ", "), F.lit(" -->\n"), prose, F.lit("\n"))
