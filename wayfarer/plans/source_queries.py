"""Sources and sinks, written from the tables and read again: S01-S04, S07-S09, S11-S13, S21-S26, S28-S30."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.plans.registry import Tables, query
from wayfarer.sources import files, scratch
from wayfarer.sources import tei as T


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, '"' || p_type || E'",\\n' || p_brand AS note FROM part""")
def q_roundtrip_csv(t: Tables) -> DataFrame:
    """Gzipped CSV with quotes, commas and line ends in a field."""
    path = scratch.folder(t.spark)
    note = F.concat(F.lit('"'), "p_type", F.lit('",\n'), "p_brand")
    files.write_csv(t.part.withColumn("note", note), path, ["p_partkey", "p_name", "note"], gzip=True)
    return files.read_csv(t.spark, path)


@query("""SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey""")
def q_roundtrip_json(t: Tables) -> DataFrame:
    """A document for each region, of records over several lines."""
    path = scratch.folder(t.spark)
    rows = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    whole = rows.groupBy("r_name").agg(F.collect_list(F.struct("n_nationkey", "n_name", "r_name")).alias("records"))
    files.write_lines(whole.select(files.pretty(F.struct("records"))).repartition(1), f"{path}/all")
    texts = files.read_texts(t.spark, f"{path}/all")
    # one object after the other: cut where an object begins at the margin
    each = texts.select(F.explode(F.filter(F.split("text", r"(?m)^(?=\{)"), lambda x: F.trim(x) != "")).alias("value"))
    return each.select(F.inline(F.from_json("value", "records array<struct<n_nationkey: int, n_name: string, r_name: string>>", {"mode": "FAILFAST"})["records"]))


@query("""SELECT 'k' || n_nationkey AS key, n_name, CAST(n_regionkey AS DOUBLE) AS lat FROM nation""")
def q_roundtrip_map(t: Tables) -> DataFrame:
    """An object that maps keys to records."""
    path = scratch.folder(t.spark)
    entry = F.struct(F.concat(F.lit("k"), "n_nationkey").alias("key"), F.struct("n_name", F.col("n_regionkey").cast("double").alias("lat")).alias("value"))
    files.write_lines(t.nation.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("places")))), path)
    return files.read_json_map(t.spark, path, "places", "struct<n_name: string, lat: double>").select("key", "value.*")


@query(
    """SELECT c_custkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat || ']},"properties":{"c_name":"' || c_name || '"' || CASE WHEN seg IS NULL THEN '' ELSE ',"seg":"' || seg || '"' END || '}}' AS feature
       FROM (SELECT c_custkey, c_name, c_custkey % 80 AS lat, nullif(c_custkey % 17, 0) AS lon, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) WHERE lon IS NOT NULL"""
)
def q_geojson(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    rows = t.customer.select("c_custkey", "c_name", (c % 80).alias("lat"), F.nullif(c % 17, F.lit(0)).alias("lon"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg")).where("lon IS NOT NULL")
    return rows.select("c_custkey", files.features(rows, "lat", "lon", ["c_name", "seg"]).alias("feature"))


@query(
    """SELECT n_name || ' / inner' AS folder, c_name AS name, 'Point' AS kind, '{"type":"Point","coordinates":[' || (c_custkey % 90) || '.5,' || (c_custkey % 45) || '.0]}' AS geometry FROM customer JOIN nation ON n_nationkey = c_nationkey"""
)
def q_kml(t: Tables) -> DataFrame:
    """A KML document for each nation: its customers as placemarks of a folder in a folder, and a line too short to count."""
    c = F.col("c_custkey")
    mark = F.concat(F.lit("<Placemark><name>"), "c_name", F.lit("</name><Point><coordinates>"), (c % 90).cast("string"), F.lit(".5,"), (c % 45).cast("string"), F.lit(",0</coordinates></Point></Placemark>"))
    marks = t.customer.groupBy("c_nationkey").agg(F.array_join(F.collect_list(mark), "").alias("marks"))
    rows = marks.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    short = F.lit("<Placemark><name>short</name><LineString><coordinates>1,2</coordinates></LineString></Placemark></Folder></Folder></Document></kml>")
    kml = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><name>'), "n_name", F.lit("</name><Folder><name>inner</name>"), "marks", short)
    found = files.kml_features(rows.select(kml.alias("text")), "text")
    return found.select("folder", "name", "kind", files.geometry(F.col("kind"), F.col("coordinates")).alias("geometry"))


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS book, CAST(turn AS VARCHAR) AS chapter, 'https://places.example.org/' || turn AS refs, trim(regexp_replace(text || ' end', '\\s+', ' ', 'g')) AS body FROM conversations"""
)
def q_tei_chapters(t: Tables) -> DataFrame:
    """A TEI document for each conversation: turns as chapters, with notes that fall out."""
    chapter = F.concat(F.lit('<div subtype="chapter" n="'), F.col("turn").cast("string"), F.lit('"><pb n="1"/><p>'), X.html_escape(F.col("text")), F.lit('<note>no <hi>no</hi></note> <placeName ref="https://places.example.org/'), F.col("turn").cast("string"), F.lit('">end</placeName></p></div>'))
    books = t.conversations.groupBy("conv_id").agg(F.array_join(F.collect_list(chapter), "").alias("chapters"))
    tei = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div subtype="book" n="'), F.col("conv_id").cast("string"), F.lit('">'), "chapters", F.lit("</div></body></text></TEI>"))
    return files.tei_chapters(books.select(tei.alias("text")), "text")


@query(
    """SELECT CAST(conv_id AS INTEGER) AS section, '<!-- hints: ' || hints || ' -->' || chr(10) || 'Turn *' || n || '* of *all*' AS block, n || ',all' AS names FROM (SELECT conv_id, string_agg(DISTINCT role, ', ' ORDER BY role) AS hints, count(*) AS n FROM conversations GROUP BY 1)"""
)
def q_markdown_blocks(t: Tables) -> DataFrame:
    """Curators' blocks written to files and cut out of them again."""
    path = scratch.folder(t.spark)
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("hints"), F.count("*").cast("string").alias("n"))
    prose = F.concat(F.lit("Turn *"), "n", F.lit("* of *all*"))
    files.write_lines(rows.select(files.curator_block(F.col("conv_id"), F.lit("chunk"), prose, F.col("hints"))), path)
    blocks = files.section_blocks(files.read_texts(t.spark, path).select("text"), "text")
    return blocks.select("section", "block", F.array_join(files.marked_names(F.col("block")), ",").alias("names"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(replace(html, ' href="/', ' id="'), '\\sid="([^"]+)"', 1))), '|') AS ids FROM pages""")
def q_anchors(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(files.anchors(F.replace(F.col("html"), F.lit(' href="/'), F.lit(' id="'))), "|").alias("ids"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_assigned_json(t: Tables) -> DataFrame:
    script = F.concat(F.lit("var points = "), "props", F.lit(";\n"))
    return t.events.select("event_id", files.parse_assigned(script, "k bigint")["k"].alias("k"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'annotated/' ELSE 'raw/' END || n_name AS path FROM nation WHERE n_nationkey % 3 <> 0 OR n_nationkey % 6 = 0""")
def q_registry(t: Tables) -> DataFrame:
    """Sources not switched off; the annotated file where there is one."""
    k = F.col("n_nationkey")
    registry = t.nation.select(k, F.concat(F.lit("raw/"), "n_name").alias("raw_path"), F.concat(F.lit("annotated/"), "n_name").alias("annotated_path"), F.when(k % 6 != 0, k % 3 != 0).alias("enabled"))
    there = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("annotated/"), "n_name").alias("path"))
    return files.enabled_sources(registry, there).select("n_nationkey", "path")


@query(
    """SELECT doc_id, sha1(substr(text, 1, CAST(p AS INTEGER) - 1) || '<placeName ref="a&amp;b" cert="high">tion</placeName>' || substr(text, CAST(p AS INTEGER) + 4)) AS digest FROM (SELECT doc_id, text, strpos(text, 'tion') AS p FROM documents) WHERE p > 0"""
)
def q_annotated(t: Tables) -> DataFrame:
    at = F.instr("text", "tion")
    span = F.struct((at - 1).alias("start"), (at + 3).alias("end"), F.lit("a&b").alias("ref"), F.lit("high").alias("cert"))
    return t.documents.where(at > 0).select("doc_id", F.sha1(files.annotated(F.col("text"), F.array(span))).alias("digest"))


@query(
    """SELECT CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS number, '| ' || n_name || ' | ' || n_regionkey || ' |' AS line FROM nation
       UNION ALL SELECT * FROM (VALUES (-3, '# Nations'), (-2, ''), (-1, '| n_name | n_regionkey |'), (0, '|---|---|')) v(number, line)"""
)
def q_report(t: Tables) -> DataFrame:
    """A Markdown table, as ordered lines."""
    return files.report("Nations", t.nation.select("n_name", "n_regionkey"), ["n_name", "n_regionkey"], [F.col("n_name")])


@query("""SELECT 'v2' AS version, n_nationkey, n_name FROM nation""")
def q_stamped(t: Tables) -> DataFrame:
    return files.stamped(files.stamped(t.nation.select("n_nationkey", "n_name"), {"version": "v1"}), {"version": "v2"})


@query(
    r"""WITH l AS (SELECT doc_id, i - 1 AS i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) u(i)),
       s AS (SELECT doc_id, i, j, parts[j] AS part FROM (SELECT doc_id, i, regexp_extract_all(line || ' ', '[^.;·]*[.;·]|[^.;·]+') AS parts FROM l), unnest(range(1, len(parts) + 1)) u(j)),
       e AS (SELECT *, 'p' || (i // 5) AS page, CAST(i % 5 + 1 AS INTEGER) AS line, regexp_matches(part, '[.;·]$') AS ends, regexp_matches(part, '\S') AS filled, last_value(i) OVER (PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM s),
       n AS (SELECT *, sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i, j) - ends::INT AS number FROM e)
       SELECT doc_id, arg_min(page, i * 100000 + j) FILTER (filled) AS page, arg_min(line, i * 100000 + j) FILTER (filled) AS line, coalesce(any_value(page) FILTER (ends), 'p' || (max(final) // 5)) AS end_page,
         coalesce(any_value(line) FILTER (ends), CAST(max(final) % 5 + 1 AS INTEGER)) AS end_line, trim(regexp_replace(string_agg(part, '' ORDER BY i, j), '\s+', ' ', 'g')) AS sentence
       FROM n GROUP BY doc_id, number HAVING bool_or(filled)"""
)
def q_tei_sentences(t: Tables) -> DataFrame:
    """Documents as TEI: a line break for each line, a page for every five, a note on every seventh."""
    mark = lambda x, i: F.concat(F.when(i % 5 == 0, F.concat(F.lit('<pb n="p'), F.floor(i / 5).cast("string"), F.lit('"/>'))).otherwise(""), F.lit("<lb/>"), X.html_escape(x), F.lit(" "), F.when(i % 7 == 0, "<note>of. <lb/>it; </note>").otherwise(""))
    body = F.array_join(F.transform(F.split("text", "\n"), mark), "")
    tei_texts = t.documents.select("doc_id", F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text>'), body, F.lit("</text></TEI>")).alias("xml"))
    return T.sentences(tei_texts, "doc_id", "xml").drop("number")
