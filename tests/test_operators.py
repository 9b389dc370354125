"""Operators that SQL can't express, against plain Python, and the small cases of scalar rules, sources and streams."""

import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from wayfarer.functions import text as X
from wayfarer.operators import joins
from wayfarer.operators import mentions as M
from wayfarer.operators.sorting import numbered
from wayfarer.plans import catalog
from wayfarer.sources import files
from wayfarer.streaming import inputs


def values(spark, rows, *columns):
    """The columns over rows of one string ``x``, as lists."""
    return [tuple(r) for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(*columns).collect()]


def test_slugs_and_spellings_of_greek_names(spark):
    x = F.col("x")
    assert values(spark, ["Ἡρακλῆς", "Συήνη", "Θῆβαι Ψ", "", "  "], X.slug(x)) == [("erakles",), ("suene",), ("thebai_ps",), ("place",), ("place",)]
    got = [r[0] for r in values(spark, ["Πέργαμον", "Λυκία", "Ἀλεξάνδρεια", "Ῥώμη", "rome", ""], X.transliterations(x))]
    assert {"pergamon", "pergamum"} <= set(got[0]) and {"lykia", "lycia", "lukia", "lucia"} <= set(got[1])
    assert {"alexandreia", "alexandria"} <= set(got[2]) and {"rome", "roma", "rhome", "rhoma"} <= set(got[3])
    assert got[4] == ["roma", "rome"] and got[5] == []


def test_distances(spark):
    d = X.distance(F.col("x"))
    rows = ["About 4,000 stades on, after 7 stades", "some eight hundred stades", "after three thousand stades", "12 stades, about 3 stades", "two or three runs", "two runs", "ten stades", "about , stades"]
    assert values(spark, rows, d["value"], d["unit"]) == [(4000.0, "stades"), (None, None), (3000.0, "stades"), (3.0, "stades"), (None, "runs"), (None, "runs"), (None, None), (None, None)]


def test_offsets_with_loose_marks_and_white_space(spark):
    rows = ["école Rome", "  A \n\t RÓme", "none", "rome"]
    found = X.find_folded(F.col("x"), F.lit("Rome"))
    got = values(spark, rows, found["start"], found["end"])
    assert got == [(7, 11), (7, 11), (None, None), (0, 4)]
    surface = X.find_surface(F.col("x"), F.lit("Barygaza mart"))
    assert values(spark, ["the Barygaza mart.", "Barýgaza  mart,", "else", ""], surface) == [("Barygaza mart",), ("Barýgaza  mart",), (None,), (None,)]


def test_lemmas_and_labels(spark):
    assert values(spark, ["12 [note] περὶ ῥόδου· else", "Rose oil of the south coast. More"], X.derive_lemma(F.col("x"))) == [("περὶ ῥόδου",), ("Rose oil of the",)]
    assert values(spark, ["main_route", ""], X.human(F.col("x"))) == [("Main route",), ("",)]
    assert values(spark, ["a b&c"], X.query_escape(F.col("x"))) == [("a%20b%26c",)]


def folded(text):
    out = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return " ".join(out.lower().replace("ς", "σ").split())


def test_span_mentions_equal_a_plain_search(spark):
    texts = [(1, "From Rome to New  Rome and romE, Rome.", ["x"]), (2, "Néw Romé was Rome", ["rome"]), (3, "Romeo and rome", []), (4, None, None), (5, "Rome, ὀνομάζουσιν", []), (6, "NEW ROME-Rome", [])]
    docs = spark.createDataFrame(texts, "k int, text string, own array<string>")
    names = spark.createDataFrame([("rome",), ("new rome",), ("absent",)], "name string")
    got = sorted((r.k, r.name, r.surface, r.start, r.end) for r in M.span_mentions(docs, "k", "text", names, "name", "own").collect())
    assert got == [(1, "new rome", "New  Rome", 13, 22), (1, "rome", "Rome", 5, 9), (1, "rome", "Rome", 33, 37), (2, "new rome", "Néw Rome", 0, 8), (6, "new rome", "NEW ROME", 0, 8), (6, "rome", "Rome", 9, 13)]


def test_linkify_equals_a_plain_search(spark):
    words = ["theresa", "the", "there.a", "oth"]
    texts = ["the theresa other", "there.a therexa", "", None, "The the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: r.text for r in M.linkify(docs, "k", "text", spark.createDataFrame([(w,) for w in words], "name string"), "name").collect()}
    pattern = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    assert got == {i: t if t is None else re.sub(rf"(?<!\w)({pattern})(?!\w)", r"[[\1]]", t) for i, t in enumerate(texts)}


def test_best_match_loses_nothing_against_all_pairs(spark):
    labels = ["ab", "mun", "mundus port", "berenike", "xyz", "aualites"]
    points = [(1, "axb"), (2, "mundus"), (3, "berenice"), (4, "port"), (5, "avalites"), (5, "zyx"), (6, "mundus port of call")]
    got = joins.best_match(spark.createDataFrame([(x,) for x in labels], "label string"), "label", spark.createDataFrame(points, "point int, name string"), "point", "name", joins.seq_ratio)

    def score(a, b):
        if a == b:
            return 1.0
        if set(a.split()) <= set(b.split()):
            return 0.92
        if set(b.split()) <= set(a.split()):
            return 0.86
        return SequenceMatcher(None, a, b).ratio() + (0.08 if b.startswith(a[:5]) or a.startswith(b[:5]) else 0)

    expected = {}
    for a in labels:
        best = max((score(a, b), -p) for p, b in points)
        if best[0] >= 0.78:
            expected[a] = (-best[1], round(best[0], 9))
    assert {r.label: (r.point, round(r.score, 9)) for r in got.collect()} == expected and "ab" in expected


def test_numbered_is_the_sort_order(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), "id")
    got = numbered(rows, [F.col("v") % 50, F.col("v"), F.col("id")], "n").collect()
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == [v for _, v in sorted((r.v % 50, r.v) for r in got)] and sorted(r.n for r in got) == list(range(1, 3001))


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.1.json").write_text('{"x": 1,\n "y": "é"}')
    (tmp_path / "bad.json").write_text('{"x": ')
    assert [tuple(r) for r in files.read_json_files(spark, str(tmp_path), "x int, y string").collect()] == [(1, "é", "a.1")]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "lines.txt").write_text("  one \n\n# no\n two\n")
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "l")).collect()] == ["one", "two"]
    html = '<div class="x"><p>no</p></div><div class="post-content"><h1>Head</h1><p>a<br/>b <b>c</b></p><p> </p><h2>Two</h2></div>'
    assert [(r.tag, r.text) for r in values(spark, [html], files.post_blocks(F.col("x")))[0][0]] == [("h1", "Head"), ("p", "a\nb c"), ("h2", "Two")]
    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><body><pb n="3"/><lb/>One two<lb/> three. Four<note>no.</note> five;<pb n="4"/><lb/> six</body></TEI>'
    got = files.tei_sentences(spark.createDataFrame([(1, tei), (2, None)], "k int, t string"), "t").collect()
    assert [tuple(r) for r in got] == [(1, "3", 1, "3", 2, "One two three."), (1, "3", 2, "3", 2, "Four five;"), (1, "4", 1, "4", 1, "six")]


def plain_fires(events, quiet, cooldown, threshold):
    out, last, until, total = [], None, float("-inf"), 0.0
    for at, delta in events:
        since, last = (float("inf") if last is None else at - last), at
        if at < until:
            continue
        total = delta if since > quiet else total + delta
        if abs(total) > threshold:
            out.append((at, 1 if total > 0 else -1))
            total, until = 0.0, at + cooldown
    return out


def test_accumulator_in_batch_and_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")
    by_user = {}
    for r in events.orderBy("event_id").collect():
        by_user.setdefault(r.user_id, []).append((r.ts.timestamp(), r.value))
    expected = sorted((u, round(at), f) for u, rows in by_user.items() for at, f in plain_fires(rows, 172800, 86400, 150))
    batch = catalog.QUERIES["q_accumulate_fire"](spark, SF_DIR).select("user_id", F.round(F.col("ts").cast("timestamp").cast("double")).cast("long").alias("at"), "fired").collect()
    assert sorted(tuple(r) for r in batch) == expected and expected
    source = str(tmp_path / "in")
    # two batches in order of time: the state must carry over
    for i in (0, 1):
        events.where((F.col("event_id") > 500) == bool(i)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        done = inputs.fires_stream(stream, "user_id", "ts", "value", 172800, 86400, 150)
        done.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.user_id, round(r["at"]), r.fired) for r in got) == expected


@pytest.mark.parametrize("name", ["q_span_mentions", "q_linkify", "q_best_match_ratio"])
def test_queries_without_sql_find_something(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_offsets_keep_line_ends(spark):
    found = X.find_folded(F.col("x"), F.lit("b c"))
    assert values(spark, ["a\nb\nc", "é́\nb  c", "bc"], found["start"], found["end"]) == [(2, 5), (3, 7), (None, None)]
