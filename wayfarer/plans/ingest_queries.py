"""The section ingest: T09 with J06, F06, W06 and T03 in one run."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import ingest as I
from wayfarer.plans.registry import Tables, query

_SQL = """
WITH RECURSIVE
b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{8,}') AS w FROM benchmark),
auth AS (SELECT w[1] AS place_key, min(item_id) AS n, arg_min(w[2], item_id) AS display, arg_min(w[3], item_id) AS alias FROM b WHERE len(w) >= 5 GROUP BY w[1]),
pts AS (SELECT item_id AS point, w[4] || ' / ' || w[5] AS label, w[4] AS v1, w[5] AS v2 FROM b WHERE len(w) >= 5 AND item_id % 4 <> 0),
sec AS (
  SELECT coalesce(lang, 'none') AS route, doc_id AS section, 'd' || doc_id AS chunk, source AS original, regexp_extract_all(lower(text), '[a-z]{12,}') AS w, doc_id % 3 = 0 AS goods,
    CASE WHEN doc_id % 5 = 0 THEN 'About ' || (100 + doc_id % 50) || ' stades' WHEN doc_id % 5 = 1 THEN 'two runs' END AS phrase, text || coalesce('. ' || phrase, '') AS text
  FROM documents
),
authterm AS (SELECT place_key, n, 0 AS pos, display AS term FROM auth UNION ALL SELECT place_key, n, 1, alias FROM auth),
idx AS (SELECT term, arg_min(place_key, n * 10 + pos) AS known_key FROM authterm GROUP BY term),
spoken AS (
  SELECT route, section, i - 1 AS nth, section * 100000 + i - 1 AS o, w[i] AS label, CASE WHEN i % 3 = 1 THEN w[i + 1] END AS surface, (i - 1 + section) % 4 AS role FROM sec, unnest(range(1, len(w) + 1)) u(i)
),
first AS (SELECT label, min(o) AS o, arg_min(coalesce(surface, ''), o) AS surface, arg_min(role, o) AS role FROM spoken WHERE label NOT IN (SELECT term FROM idx) GROUP BY label),
node AS (SELECT row_number() OVER (ORDER BY o) AS k, *, CASE WHEN surface <> '' AND surface <> label AND surface NOT IN (SELECT term FROM idx) THEN surface END AS other FROM first),
walk AS (
  SELECT 0::BIGINT AS k, []::VARCHAR[] AS terms, (SELECT list(place_key) FROM auth) AS keys, NULL::VARCHAR AS key
  UNION ALL
  SELECT s.k, CASE WHEN s.key IS NULL THEN s.terms WHEN other IS NULL THEN list_append(s.terms, label) ELSE list_concat(s.terms, [label, other]) END, CASE WHEN s.key IS NULL THEN s.keys ELSE list_append(s.keys, s.key) END, s.key
  FROM (SELECT n.*, w.terms, w.keys, CASE WHEN list_contains(w.terms, label) THEN NULL WHEN NOT list_contains(w.keys, label) THEN label
               ELSE label || '_' || list_filter(range(2, 60), lambda i: NOT list_contains(w.keys, label || '_' || i))[1] END AS key
        FROM walk w JOIN node n ON n.k = w.k + 1) s
),
made AS (SELECT n.*, w.key FROM node n JOIN walk w ON w.k = n.k WHERE w.key IS NOT NULL),
newterm AS (SELECT term, arg_min(key, k) AS new_key FROM (SELECT label AS term, key, k FROM made UNION ALL SELECT other, key, k FROM made WHERE other IS NOT NULL) GROUP BY term),
cand AS (
  SELECT m.key, p.point, p.label AS point_label, c.name,
    CASE WHEN m.label = c.name THEN 1.0 WHEN list_contains(string_split(c.name, ' '), m.label) THEN 0.92
         ELSE 1 - levenshtein(m.label, c.name) / greatest(length(m.label), length(c.name)) + CASE WHEN starts_with(c.name, m.label[1:5]) OR starts_with(m.label, c.name[1:5]) THEN 0.08 ELSE 0 END END AS score
  FROM (SELECT * FROM made WHERE role IN (0, 2)) m CROSS JOIN pts p, unnest([v1 || ' ' || v2, v1, v2]) c(name)
),
best AS (SELECT key, arg_min(point_label, point) AS point_label FROM (SELECT *, max(score) OVER (PARTITION BY key) AS top FROM cand WHERE score >= 0.78) WHERE score = top GROUP BY key),
places AS (
  SELECT place_key, display, 0 AS new, n AS a, 0 AS b, n % 3 <> 0 AS mapped, NULL::VARCHAR AS point_label, [display, alias] AS terms FROM auth
  UNION ALL
  SELECT key, label, 1, o // 100000, o % 100000, point_label IS NOT NULL, point_label, CASE WHEN surface = '' THEN [label, label] ELSE [label, label, surface] END FROM made LEFT JOIN best USING (key)
),
said AS (
  SELECT s.*, coalesce(known_key, new_key) AS place_key, p.mapped, p.point_label, m.o IS NOT NULL AS creates
  FROM spoken s LEFT JOIN idx ON idx.term = label LEFT JOIN newterm t ON t.term = label LEFT JOIN made m ON m.o = s.o JOIN places p ON p.place_key = coalesce(known_key, new_key)
),
side AS (
  SELECT section, side, text, list_transform(regexp_extract_all(text, '\\S+(?:\\s+\\S+){0,5}'), lambda r: trim(r, ' .,;:··')) AS runs,
    list_transform(runs, lambda r: trim(regexp_replace(lower(strip_accents(r)), '[^0-9a-zα-ω]+', ' ', 'g'))) AS norms
  FROM (SELECT section, 0 AS side, text FROM sec UNION ALL SELECT section, 1, original FROM sec) WHERE text <> ''
),
term AS (SELECT place_key, new, a, b, mapped, i - 1 AS term_at, terms[i] AS term FROM places, unnest(range(1, len(terms) + 1)) u(i)),
hit AS (
  SELECT section, side, term, term AS surface FROM side JOIN (SELECT DISTINCT term FROM term) t ON contains(text, term)
  UNION ALL
  SELECT section, side, term, arg_min(run, i) FROM (SELECT section, side, text, runs[i] AS run, norms[i] AS norm, i FROM side, unnest(range(1, len(runs) + 1)) u(i)) JOIN (SELECT DISTINCT term FROM term) t ON norm = term
  WHERE NOT contains(text, term) GROUP BY ALL
),
met AS (SELECT section, side, surface, t.* FROM hit JOIN term t USING (term) WHERE new = 0 OR a <= section),
labelled AS (
  SELECT s.*, CASE WHEN contains(t.text, label) THEN label ELSE coalesce(t.runs[list_position(t.norms, label)], label) END AS in_text,
    CASE WHEN surface IS NULL THEN NULL WHEN contains(o.text, surface) THEN surface ELSE o.runs[list_position(o.norms, surface)] END AS in_original
  FROM said s LEFT JOIN side t ON t.section = s.section AND t.side = 0 LEFT JOIN side o ON o.section = s.section AND o.side = 1
),
everything AS (
  SELECT section, place_key, [0, nth, 0, 0, 0] AS rank, in_text AS surface, role = 0 AS main FROM labelled
  UNION ALL SELECT section, place_key, [0, nth, 0, 0, 1], in_original, role = 0 FROM labelled WHERE in_original IS NOT NULL
  UNION ALL SELECT section, place_key, [1, new, a, b, term_at * 2 + side], surface, false FROM met
),
mention AS (SELECT section, place_key, trim(surface) AS surface, min(rank) AS rank, arg_min(main, rank) AS main FROM everything WHERE trim(surface) <> '' GROUP BY ALL),
known AS (
  SELECT section, place_key, [0, nth, 0, 0] AS rank, mapped, role = 0 AS main FROM said UNION ALL SELECT section, place_key, [1, new, a, b], mapped, false FROM met
),
own AS (
  SELECT section, arg_min(place_key, rank) FILTER (main) AS dest, arg_min(mapped, rank) FILTER (main) AS dest_mapped, arg_min(place_key, rank) FILTER (mapped) AS near FROM known GROUP BY section
),
start AS (SELECT arg_min(place_key, [new, a, b]) AS key, arg_min(mapped, [new, a, b]) AS mapped, min([new, a, b]) AS rank FROM places),
f1 AS (
  SELECT s.*, dest, coalesce(dest, near) AS own, CASE WHEN dest IS NOT NULL THEN dest_mapped ELSE near IS NOT NULL END AS own_mapped,
    CASE WHEN phrase IS NOT NULL THEN chunk END AS said_chunk FROM sec s LEFT JOIN own o USING (section)
),
f2 AS (
  SELECT *, last_value(CASE WHEN own_mapped THEN own END IGNORE NULLS) OVER w AS last, last_value(phrase IGNORE NULLS) OVER w AS old_phrase, last_value(said_chunk IGNORE NULLS) OVER w AS old_chunk
  FROM f1 WINDOW w AS (PARTITION BY route ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
f3 AS (
  SELECT f2.*, coalesce(own, last, CASE WHEN start.rank[1] = 0 OR start.rank[2] <= section THEN start.key END) AS focus,
    CASE WHEN own IS NOT NULL THEN own_mapped WHEN last IS NOT NULL THEN true ELSE start.mapped AND (start.rank[1] = 0 OR start.rank[2] <= section) END AS stands FROM f2, start
),
led AS (
  SELECT route, place_key FROM said WHERE role = 0 AND mapped UNION SELECT route, focus FROM f3 WHERE dest IS NULL AND stands
),
kinds AS (
  SELECT m.*, f3.route, m.place_key IN (SELECT place_key FROM led WHERE led.route = f3.route) OR (stands AND focus = m.place_key) OR main AS on_route FROM mention m JOIN f3 USING (section)
),
legs AS (
  SELECT section, route, was, focus, coalesce(phrase, old_phrase) AS said, CASE WHEN phrase IS NOT NULL THEN chunk ELSE coalesce(old_chunk, chunk) END AS ref
  FROM (SELECT *, lag(focus) OVER (PARTITION BY route ORDER BY section) AS was FROM f3 WHERE stands) WHERE was <> focus
)
SELECT 'place' AS output, NULL::BIGINT AS section, place_key AS item, display AS a, CASE WHEN new = 0 THEN 'authority' ELSE coalesce('point ' || point_label, 'unmapped') END AS b, (place_key IN (SELECT place_key FROM led))::VARCHAR AS c FROM places
UNION ALL SELECT 'step', section, focus, CASE WHEN dest IS NOT NULL THEN p.display WHEN goods THEN 'Section ' || section || ': trade goods' ELSE coalesce(p.display, 'Section ' || section) END, CASE WHEN stands THEN 'stop' ELSE 'context' END,
  (SELECT count(*) FROM mention m WHERE m.section = f3.section)::VARCHAR FROM f3 LEFT JOIN places p ON p.place_key = focus
UNION ALL SELECT 'mention', section, place_key, surface, CASE WHEN on_route THEN 'main_route' ELSE 'off_route' END, (row_number() OVER (PARTITION BY section ORDER BY rank))::VARCHAR FROM kinds
UNION ALL SELECT 'leg', section, focus, was, coalesce(lower(said), 'inferred from section sequence'), ref FROM legs
UNION ALL SELECT 'report', section, place_key, label, CASE WHEN creates AND point_label IS NOT NULL THEN 'matched_point' WHEN creates THEN 'unmapped_new' ELSE 'matched_authority' END, coalesce(CASE WHEN creates THEN point_label END, '') FROM said
UNION ALL SELECT 'report', section, place_key, surface, 'fallback_mention', CASE WHEN side = 0 THEN 'translation' ELSE 'original' END FROM met
"""


@query(_SQL)
def q_section_ingest(t: Tables) -> DataFrame:
    """All outputs of one run: documents as sections, their long words as labels, first words of benchmark items as the authority, later ones as points."""
    item = t.benchmark.select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), 1).alias("w")).where(F.size("w") >= 5)
    word = lambda i: F.col("w")[i]
    first = item.groupBy(word(0).alias("place_key")).agg(F.min("item_id").alias("place_order"), F.min_by(word(1), "item_id").alias("display_name"), F.min_by(word(2), "item_id").alias("alias"))
    coordinate = F.when(F.col("place_order") % 3 != 0, F.col("place_order").cast("double"))
    authority = first.select("place_key", "place_order", "display_name", F.array("alias").alias("aliases"), F.array().cast("array<string>").alias("names"), F.lit("stop").alias("place_type"), coordinate.alias("lat"), coordinate.alias("lon"))
    points = item.select(F.col("item_id").alias("point"), F.concat_ws(" / ", word(3), word(4)).alias("label"), F.lit(1.0).alias("lat"), F.when(F.col("item_id") % 4 != 0, 2.0).alias("lon"))
    d = F.col("doc_id")
    phrase = F.when(d % 5 == 0, F.concat(F.lit("About "), (100 + d % 50).cast("string"), F.lit(" stades"))).when(d % 5 == 1, "two runs")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"), 1)
    roles = F.array(*[F.lit(r) for r in ("destination_port", "region", "route_or_intermediate_place", "source_place")])
    # the words are made once for each text, not once more for each of them
    labels = lambda all_: F.transform(all_, lambda w, i: F.struct(w.alias("label"), F.when(i % 3 == 0, F.get(all_, i + 1)).alias("surface"), F.get(roles, ((i + d) % 4).cast("int")).alias("role"), F.lit("").alias("note")))
    places = F.get(F.transform(F.array(words), labels), F.lit(0))
    text = F.concat("text", F.coalesce(F.concat(F.lit(". "), phrase), F.lit("")))
    sections = t.documents.select(F.coalesce("lang", F.lit("none")).alias("route"), d.alias("section"), F.concat(F.lit("d"), d.cast("string")).alias("chunk"), text.alias("text"), F.col("source").alias("original"), places.alias("places"), F.when(d % 3 == 0, F.array("source")).alias("goods"))
    similar = lambda a, b: 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    j = I.ingest(sections, authority, points, similar)
    is_new = F.col("rank.new") == 1
    source = F.when(~is_new, "authority").when(F.col("lat").isNotNull(), F.concat(F.lit("point "), F.regexp_extract("source", "'(.*)'", 1))).otherwise("unmapped")
    out = [
        j.places.select(F.lit("place").alias("output"), F.lit(None).cast("long").alias("section"), F.col("place_key").alias("item"), F.col("display_name").alias("a"), source.alias("b"), F.col("on_main_route").cast("string").alias("c")),
        j.steps.select(F.lit("step"), "section", "focus_key", "title", "type", F.col("n_mentions").cast("string")),
        j.mentions.select(F.lit("mention"), "section", "place_key", "surface", "kind", F.col("mention").cast("string")),
        j.legs.select(F.lit("leg"), "section", "to_key", "from_key", "distance_text", "ref"),
        j.report.select(F.lit("report"), "section", "place_key", "item", "kind", "detail"),
    ]
    whole = out[0]
    for o in out[1:]:
        whole = whole.union(o)
    return whole
