"""Names over a trie against a search name by name."""

import re
import unicodedata

import numpy as np
import pytest

from wayfarer.operators import mentions, survey, trie


def letter_form(text):
    out, at = [], []
    for i, whole in enumerate(text):
        for c in unicodedata.normalize("NFD", whole):
            if unicodedata.category(c) == "Mn" or (c.isspace() and (not out or out[-1] == " ")):
                continue
            out.append(" " if c.isspace() else c.lower().replace("ς", "σ"))
            at.append(i)
    return "".join(out), at


def name_by_name(text, names, own):
    folded, at = letter_form(text)
    taken, rows = bytearray(len(folded)), []
    for n in sorted(set(names) - set(own), key=lambda n: (-len(n.split()), -len(n), n)):
        for m in re.finditer(f"(?=({re.escape(n)}))", folded):
            s, e = m.start(), m.start() + len(n)
            if (s and folded[s - 1].isalnum()) or (e < len(folded) and folded[e].isalnum()) or any(taken[s:e]):
                continue
            surface = text[at[s] : at[e - 1] + 1]
            around = letter_form(text[max(0, at[s] - 35) : at[e - 1] + 36])[0]
            if surface[0].upper() == surface[0] != surface[0].lower() and "καλουσιν" not in around:
                taken[s:e] = b"\1" * (e - s)
                rows.append((n, surface, at[s], at[e - 1] + 1))
    return rows


@pytest.mark.parametrize("held", [10**6, 0])
def test_spans_equal_a_search_name_by_name(spark, monkeypatch, held):
    monkeypatch.setattr(trie, "HELD_NAMES", held)
    rng = np.random.default_rng(6)
    words = ["rome", "Rome", "ROMÉ", "new", "New", "of", "Πόλις", "πόλεως", "καλοῦσιν", "x1", "b.c", "Róme", "-", ",", "Sée", "the", "Rome\u0301"]
    gaps = [" ", "  ", "\n", ", ", "-", "", ". "]
    texts = [(i, "".join(str(rng.choice(words)) + str(rng.choice(gaps, p=[0.6, 0.1, 0.05, 0.1, 0.05, 0.05, 0.05])) for _ in range(rng.integers(0, 30))), [str(rng.choice(["rome", "new rome", "x"]))]) for i in range(120)]
    names = ["rome", "new rome", "rome of", "new", "πολισ", "b.c", "the rome, new", "rome new rome", "see", "rome.", "x1", "of rome of", "-", "absent name"]
    df = spark.createDataFrame([*texts, (500, None, None), (501, "", [])], "k int, text string, own array<string>")
    got = mentions.span_mentions(df, "k", "text", spark.createDataFrame([(n,) for n in names * 2], "name string"), "name", "own")
    expected = [(k, *row) for k, text, own in texts for row in name_by_name(text, [n for n in names if n != "-"], own)]
    assert len(expected) > 150
    assert sorted((r.k, r.name, r.surface, r.start, r.end) for r in got.collect()) == sorted(expected)


GREEK_TEXTS = [
    (1, "Ἔπλευσα εἰς Κοίλην Συρίαν καὶ Ῥόδον. Γαληνός"),
    (2, "ἦλθον ΡΟΔΟΣ Ῥόδος Ῥόδος ἐν νεκρᾷ θαλάσσῃ κοιλη συριας"),
    (3, "Τότε Κύπρος, Λῆμνος Ἄδηλος Ἄδηλος· Ὦ"),
    (4, None),
    (5, ""),
]


def test_phases_verbs_and_hits(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    texts = make(GREEK_TEXTS, "k int, text string")
    curated = make([("κοιλη συρια", ["syria_coele"]), ("κοιλην συριαν", ["syria_coele"]), ("ληµνοσ".replace("µ", "μ"), ["lemnos", "lemnos_2"])], "lemma string, ids array<string>")
    exact = make([("ροδοσ", ["590031"]), ("τοτε", ["1"]), ("γαληνοσ", ["2"])], "lemma string, ids array<string>")
    variants = make([("cyprus", ["707498"]), ("kypros", ["7", "8"])], "lemma string, ids array<string>")
    lemmas = make([("ροδον", "Ῥόδος")], "word string, lemma string")
    word = lambda *w: make([(x,) for x in w], "word string")
    spans, unmatched = survey.phase_spans(texts, "k", "text", curated, exact, variants, lemmas, word("τοτε"), word("γαληνοσ"))
    got = sorted((r.k, r.surface, r.lemma, tuple(r.ids), r.match_type, r.cert) for r in spans.collect())
    assert got == sorted(
        [
            (1, "Κοίλην Συρίαν", "κοιλην συριαν", ("syria_coele",), "curator", "secure"),
            (1, "Ῥόδον", "Ῥόδος", ("590031",), "greek", "secure"),
            (2, "Ῥόδος", "Ῥόδος", ("590031",), "greek", "secure"),
            (2, "Ῥόδος", "Ῥόδος", ("590031",), "greek", "secure"),
            (2, "κοιλη συρια", "κοιλη συρια", ("syria_coele",), "curator", "secure"),
            (3, "Κύπρος", "Κύπρος", ("707498",), "latin", "probable"),
            (3, "Λῆμνος", "Λῆμνος", ("lemnos", "lemnos_2"), "curator", "ambiguous"),
        ]
    )
    held = dict(GREEK_TEXTS)
    assert all(held[r.k][r.start : r.end] == r.surface for r in spans.collect())
    assert {(r.surface, r.n) for r in unmatched.collect()} == {("Ἔπλευσα", 1), ("Ἄδηλος", 2)}
    hits = {r.k: ([m.surface for m in r.mentions or []], [tuple(v) for v in r.verbs], r.is_hit) for r in survey.sentence_hits(texts, "k", "text", spans).collect()}
    assert hits[1] == (["Κοίλην Συρίαν", "Ῥόδον"], [("επλευσα", "movement")], True)
    assert hits[2] == (["Ῥόδος", "κοιλη συρια"], [("ηλθον", "movement")], True)
    assert hits[3] == (["Κύπρος", "Λῆμνος"], [], False)
    assert hits[4] == hits[5] == ([], [], False)
