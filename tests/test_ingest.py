"""The section ingest against a plain loop over the sections, its keys, and the substring join it uses."""

import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.operators import gram_index, grams, ingest
from wayfarer.operators.sorting import carried
from wayfarer.sources import edits, files, tei

SECTIONS = f"route string, section long, chunk string, text string, original string, places {ingest.PLACE}, goods array<string>"
AUTHORITY = "place_key string, place_order long, display_name string, aliases array<string>, names array<string>, place_type string, lat double, lon double"
POINTS = "point long, label string, lat double, lon double"


def label_form(x):
    bare = "".join(c for c in unicodedata.normalize("NFD", x or "") if unicodedata.category(c) != "Mn")
    return re.sub(r"[^0-9a-zα-ω]+", " ", bare.lower()).strip()


def surface_in(text, surface):
    if not text or not surface:
        return None
    if surface in text:
        return surface
    runs = [m.strip(" .,;:·") for m in re.findall(r"\S+(?:\s+\S+){0,5}", text)]
    return next((r for r in runs if label_form(r) and label_form(r) == label_form(surface)), None)


def score(a, b):
    x, y = set(a.split()), set(b.split())
    if a == b:
        return 1.0
    if x <= y or y <= x:
        return 0.92 if x <= y else 0.86
    return SequenceMatcher(None, a, b).ratio() + (0.08 if b.startswith(a[:5]) or a.startswith(b[:5]) else 0)


def far(text):
    for pattern in (r"about\s+([0-9,]+)\s+stades", r"after\s+([0-9,]+)\s+stades", r"([0-9,]+)\s+stades"):
        if m := re.search(pattern, (text or "").lower()):
            return m[0], float(m[1].replace(",", "")), "stades"
    return ("two runs", None, "runs") if "two runs" in (text or "").lower() else None


class Loop:
    """The same, one section after the other."""

    def __init__(self, sections, authority, points):
        self.index, self.place, self.taken, self.line = {}, {}, set(), []
        for key, _, name, aliases, names, _, lat, _ in sorted(authority, key=lambda a: a[1]):
            self.add(key, [name, *(aliases or []), *(names or [])], name, lat is not None)
        self.points = sorted(points)
        self.steps, self.mentions, self.legs, self.new = [], [], [], {}
        self.main, self.kinds = {}, {}
        state = {}
        for section in sorted(sections, key=lambda s: s[1]):
            self.one(section, state.setdefault(section[0], {"last": None, "was": None, "far": None}))
        for route, section, surface, key, kind in self.kinds.values():
            self.mentions.append((route, section, surface, key, "main_route" if key in self.main.get(route, ()) else kind))

    def add(self, key, terms, name, mapped):
        self.taken.add(key)
        self.line.append(key)
        self.place[key] = [t for t in terms if t], name, mapped
        for t in terms:
            if label_form(t):
                self.index.setdefault(label_form(t), key)

    def resolve(self, section, label, surface, role):
        if (key := self.index.get(label_form(label))) is not None:
            return key
        base = re.sub(r"[^0-9a-z]+", "_", label_form(label)).strip("_") or "place"
        key, i = base, 2
        while key in self.taken:
            key, i = f"{base}_{i}", i + 1
        hit = None
        if role in ("destination_port", "route_or_intermediate_place") and label_form(label) != "egypt":
            best = max(((max(score(label_form(label), label_form(v)) for v in [n, *[p.strip(" ?") for p in re.split(r"[/,;()]+", n)]] if label_form(v)), -i) for i, n, _, _ in self.points), default=(0, 0))
            hit = best[0] >= 0.78
        self.add(key, [label, label, surface], label, bool(hit))
        self.new[key] = section, bool(hit)
        return key

    def one(self, row, state):
        route, section, chunk, text, original, places, goods = row
        seen, order, to, mentions = set(), [], [], []

        def mention(surface, key, kind):
            surface = (surface or "").strip()
            if surface and (surface, key) not in seen:
                seen.add((surface, key))
                mentions.append([surface, key, kind])

        for label, surface, role, _ in places or []:
            if not label_form(label):
                continue
            key = self.resolve(section, label, surface, role)
            order += [key] if key not in order else []
            kind = "main_route" if role == "destination_port" else "off_route"
            to += [key] if kind == "main_route" else []
            mention(surface_in(text, label) or label, key, kind)
            mention(surface_in(original, surface), key, kind)
        for key in self.line:
            hits = [x for t in self.place[key][0] for x in (surface_in(text, t), surface_in(original, t)) if x]
            order += [key] if hits and key not in order else []
            for x in hits:
                mention(x, key, "off_route")
        mapped = [k for k in order if self.place[k][2]]
        focus = to[0] if to else mapped[0] if mapped else state["last"] or (self.line[0] if self.line else None)
        stands = focus is not None and self.place[focus][2]
        if stands:
            state["last"] = focus
        for m in mentions:
            if stands and m[1] == focus:
                m[2] = "main_route"
        for key in [k for k in to if self.place[k][2]] if to else [focus] if stands else []:
            self.main.setdefault(route, []).append(key)
        name = self.place[focus][1] if focus else f"Section {section}"
        title = self.place[to[0]][1] if to else f"Section {section}: trade goods" if goods else name
        self.steps.append((route, section, "stop" if stands else "context", title, focus, len(mentions)))
        for surface, key, kind in mentions:
            self.kinds[section, surface, key] = route, section, surface, key, kind
        here = far(text)
        if stands and focus != state["was"]:
            if state["was"]:
                said = (here, chunk) if here else state["far"]
                self.legs.append((route, section, state["was"], focus, said[1] if said else chunk, *(said[0] if said else ("inferred from section sequence", None, None))))
            state["was"] = focus
        if here:
            state["far"] = here, chunk


NAMES = ["Adulis", "Barygaza", "Muza", "Kane", "Muziris", "Nelkynda", "Rhapta", "Opone", "Egypt", "Malao", "Mundus", "Mosyllon", "Azania", "Avalites", "Egypt 2", "Egypt!", "Kané", "Muza_2", "muza 2", "!!", "Ἄδουλι", "Okelis"]


def made_sections(seed, n=90):
    rng = np.random.default_rng(seed)
    pick = lambda: str(rng.choice(NAMES))
    rows = []
    for i in range(n):
        places = [(pick(), [pick(), "", None][rng.integers(3)], ["destination_port", "region", "route_or_intermediate_place", None][rng.choice(4, p=[0.15, 0.35, 0.3, 0.2])], "n") for _ in range(rng.integers(0, 4))]
        words = [["they", "sail", "beyond", "the", "gulf,", "to", "about 300 stades", "after 1,200 stades", "two runs", pick(), pick() + "ian"][rng.choice(11, p=[0.16] * 5 + [0.08, 0.01, 0.01, 0.01, 0.06, 0.03])] for _ in range(rng.integers(0, 30))]
        rows.append((["a", "b"][int(rng.integers(2))], 3 * i + 1, f"c{i}", " ".join(words) if rng.integers(9) else None, pick() if rng.integers(2) else None, places or None, ["ivory"] if rng.integers(4) == 0 else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ingest_equals_the_loop(spark, seed):
    sections = made_sections(seed)
    authority = [("adulis", 1, "Adulis", None, ["Ἄδουλι"], "emporion", 15.3, 39.7), ("muza", 2, "Mouza", ["Muzah"], None, "emporion", None, None), ("egypt_2", 3, "Aigyptos", [], [], "region", 30.0, 31.0)][: seed if seed < 3 else 3]
    points = [(1, "Mundu / Mosylon", 10.0, 45.0), (2, "Kane (port)", 14.0, 48.0), (3, "Malao", None, 1.0), (4, "Rhaptum", -7.0, 39.0)]
    loop = Loop(sections, authority, [p for p in points if p[2] is not None])
    j = ingest.ingest(spark.createDataFrame(sections, SECTIONS), spark.createDataFrame(authority, AUTHORITY), spark.createDataFrame(points, POINTS))
    made = {r.place_key: (r.rank.a, r.lat is not None) for r in j.places.where("rank.new = 1").collect()}
    assert made == loop.new
    assert sorted(r.place_key for r in j.places.where("on_main_route").collect()) == sorted({k for keys in loop.main.values() for k in keys})
    assert sorted(tuple(r) for r in j.steps.select("route", "section", "type", "title", "focus_key", "n_mentions").collect()) == sorted(loop.steps)
    assert sorted(tuple(r) for r in j.mentions.select("route", "section", "surface", "place_key", "kind").collect()) == sorted(loop.mentions)
    assert sorted((tuple(r) for r in j.legs.select("route", "section", "from_key", "to_key", "ref", "distance_text", "distance_value", "distance_unit").collect()), key=repr) == sorted(loop.legs, key=repr)
    places_in_order = [r.surface for r in j.mentions.where("section = 4").orderBy("mention").collect()]
    assert places_in_order == [surface for (section, surface, _) in loop.kinds if section == 4]


def test_ingest_of_nothing(spark):
    j = ingest.ingest(*(spark.createDataFrame([], t) for t in (SECTIONS, AUTHORITY, POINTS)))
    assert [t.count() for t in (j.places, j.steps, j.mentions, j.legs, j.report)] == [0] * 5


def test_keys_are_the_next_free_ones(spark):
    bases = ["a", "a", "b", "a_2", "a", "c_2_2", "b", "c", "c_2", "c_2", "c", "d"] + ["b"] * 9
    taken = ["a", "b_3", "b_2", "b_02", "c_2", "e", "b_1", "d_1", "b_10"]
    held, expected = set(taken), []
    for b in bases:
        now, i = b, 2
        while now in held:
            now, i = f"{b}_{i}", i + 1
        held.add(now)
        expected.append(now)
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bases)], "i int, base string")
    got = ingest.allocate(rows, "base", "i", spark.createDataFrame([(t,) for t in taken], "key string"), "key")
    assert [r.key for r in got.orderBy("i").collect()] == expected


def test_substring_join_equals_search(spark):
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("ab cdé"), n))
    texts = [(i, text(int(rng.integers(0, 60)))) for i in range(80)] + [(90, None), (91, "")]
    needles = {text(int(n)) for n in rng.integers(1, 6, 60)} | {"", "zz", "z", "zzz"}
    df = spark.createDataFrame([(n,) for n in needles] * 2, "needle string")
    got = grams.containing(spark.createDataFrame(texts, "id int, text string"), ["id"], "text", df, "needle")
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, n) for i, t in texts for n in needles if t and n and n in t)


def test_carried_values_cross_ranges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(9)) if rng.integers(40) == 0 else None) for i in rng.permutation(3000).tolist()]
    df = spark.createDataFrame(rows, "i int, v int")
    last, before, now = None, {}, {}
    for i, v in sorted(rows):
        before[i] = last
        last = last if v is None else v
        now[i] = last
    for current, expected in ((False, before), (True, now)):
        got = carried(df, [F.col("i")], {"last": F.col("v")}, current).collect()
        assert {r.i: r.last for r in got} == expected


@pytest.mark.parametrize("named", [2_000, 0])
def test_index_answers_like_a_scan(spark, monkeypatch, tmp_path, named):
    monkeypatch.setattr(gram_index, "NAMED", named)
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("aAb éz"), n))
    rows = [(i, ["x", "y", None][i % 3], text(int(rng.integers(0, 6))), text(int(rng.integers(0, 50)))) for i in range(120)] + [(500, "x", None, None), (501, "x", "", "ab")]
    asked = sorted({text(int(n)) for n in rng.integers(0, 7, 40)} | {"zzzzzzz", "b", "AB"})
    df = spark.createDataFrame(rows, "id int, corpus string, title string, body string")
    index = gram_index.write_index(df, "corpus", "id", "title", "body", f"file://{tmp_path}/index", split=2)
    got = gram_index.lookup(spark, index, spark.createDataFrame([(q,) for q in asked], "q string"), "q")
    plain = lambda x: (x or "").lower().replace("é", "e")
    expected = []
    for q in asked:
        f = plain(q.strip())
        for i, c, title, body in rows if len(f) >= 2 else []:
            if f in plain(title) or f in plain(body):
                expected.append((q, c or "", i, 0 if f in plain(title) else 1, plain(body).find(f) + 1))
    assert len(expected) > 200
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    first = gram_index.grouped_hits(got, {"x": 2}, 3).collect()
    assert all(r.place <= (2 if r.corpus == "x" else 3) for r in first)
    assert all(r.total == sum(e[:2] == (r.q, r.corpus) for e in expected) and r.of_query == sum(e[0] == r.q for e in expected) for r in first)


def test_tei_sentences_equal_the_walk(spark):
    rng = np.random.default_rng(9)
    parts = ["word ", "two. ", "; ", "end.", " a &amp; b&#183; c&#xe9;&lt; ", "<lb/>", '<pb n="7"/>', "<pb n='8&amp;9' />", "<note>out. <lb/><pb n='0'/><note>in</note> x</note>", "<hi rend='a'>mid", "</hi>", "\n", "·", "<!-- no. <lb/> -->", "<![CDATA[raw < a. b]]>", "<note/>", "<?pi x.?>"]
    docs = []
    for k in range(60):
        text, depth = "", 0
        for b in (parts[p] for p in rng.choice(len(parts), rng.integers(0, 40))):
            if b == "</hi>":
                if not depth:
                    continue
                depth -= 1
            depth += b.startswith("<hi")
            text += b
        docs.append((k, f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><t:text xmlns:t="x">{text}{"</hi>" * depth}</t:text></TEI>'))
    df = spark.createDataFrame([*docs, (99, None)], "k int, t string")
    walked = files.tei_sentences(df, "t").collect()
    got = tei.sentences(df, "k", "t").collect()
    plain = lambda rows: sorted(tuple(r[c] for c in ("k", "page", "line", "end_page", "end_line", "sentence")) for r in rows)
    assert len(walked) > 150
    assert plain(got) == plain(walked)


def test_tei_sentences_of_texts_in_parts(spark):
    """A text longer than a segment is cut and dealt out, within a note or a comment's neighbourhood too; each text counts for itself, and what pb and lb hold is no text."""
    rng = np.random.default_rng(10)
    parts = ["word ", "two. ", "; ", " \n", " a &amp;lt; b&#183; c&#38;lt; ", "<lb/>", "<lb></lb>", '<pb n="7"/>', "<pb ed=\" n='4'\" n='8'>no. </pb>", "<note>out. <lb/><pb n='0'/>", "</note>", "<hi>mid</hi>", "·", "<!-- no. <lb/> <note> -->", "<![CDATA[raw < a. <lb/>b]]>", "<note/>", "<?pi <note>.?>", "long words without a stop " * 3]
    docs = []
    for k in range(80):
        text, depth = "", 0
        for b in (parts[p] for p in rng.choice(len(parts), rng.integers(0, 60))):
            if b == "</note>" and not depth:
                continue
            depth += b.startswith("<note>") - (b == "</note>")
            text += b
        docs.append((f"d{k}", f"<TEI><text>{text}{'</note>' * depth}</text></TEI>"))
    df = spark.createDataFrame([*docs, ("none", None), ("empty", "<TEI/>")], "k string, t string")
    plain = lambda rows: sorted(tuple(r[c] for c in ("k", "page", "line", "end_page", "end_line", "sentence")) for r in rows)
    walked = plain(files.tei_sentences(df, "t").collect())
    assert len(walked) > 300
    whole = tei.sentences(df, "k", "t").collect()
    assert plain(whole) == walked
    assert all(r.number < 60 * 3 for r in whole)
    for size in (1, 40, 300):
        cut = tei.sentences(df, "k", "t", size).collect()
        assert plain(cut) == walked
        assert sorted(map(tuple, cut)) == sorted(map(tuple, whole))
    assert max(len(list(tei._cut(t, 40))) for _, t in docs) > 10 and all("".join(tei._cut(t, 40)) == t for _, t in docs)
    # what is read in one pass is not shuffled
    assert "Exchange" not in tei._short(df, "k", "t")._jdf.queryExecution().executedPlan().toString()


def test_claims_are_read_in_one_pass(spark):
    """A chapter without a number shifts no offsets, references are read once, and neither blocks nor claims of a text are shuffled."""
    head = '<div type="textpart" subtype='
    xml = f'<TEI>{head}"chapter">x Ilion</div>{head}"book" n="1">{head}"chapter" n="1"><p>Über  Ilion &#38;lt; <note>a\nb</note>é\u0301 sea</p></div>{head}"chapter">y</div>{head}"chapter" n="2"><p>to sea</p></div></div></TEI>'
    texts = spark.createDataFrame([(1, xml), (2, None), (3, "<TEI/>")], "k int, t string")
    assert {(r.k, r.book, r.chapter, xml[r["at"] :].startswith(r.block)) for r in edits.chapter_blocks(texts, "k", "t").collect()} == {(1, "1", "1", True), (1, "1", "2", True)}
    claims = spark.createDataFrame([(1, "1", "1", 0, "Ilion"), (1, "1", "2", 1, "sea"), (3, "1", "1", 2, "sea")], 'k int, book string, chapter string, `order` int, surface string')
    pairs = [("ref", F.lit("x/7")), ("ingredient_key", F.lit("m")), ("relation", F.lit("in")), ("claim_order", F.col("order")), ("evidence_phrase", F.when(F.col("order") == 0, "&lt; É sea"))]
    made, errors = edits.annotate_claims(texts, "k", "t", claims, pairs)
    text = {r.k: r.t for r in made.collect()}
    assert text[1].count("<placeName") == 2 and text[1].count(">Ilion</placeName>") == 1 and ">sea</placeName></p></div></div></TEI>" in text[1]
    assert [(r.k, r.reason) for r in errors.collect()] == [(3, "no chapter")]
    places = spark.createDataFrame([("7", "P", "precise", False)], "place_id string, title string, precision string, broad boolean")
    good, bad = edits.claims(made, "k", "t", places)
    assert bad.count() == 0
    got = {r.chapter: r for r in good.collect()}
    body = "Über Ilion &lt; é\u0301 sea"
    assert got["1"].evidence_span == (body.index("&"), len(body)) and got["1"].place_span == (5, 10) and got["2"].place_span == (3, 6)
    for df in (edits.chapter_blocks(texts, "k", "t"), edits.claims(texts, "k", "t", F.broadcast(places))[0]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange hashpartitioning" not in plan
