"""Nearest sites, as-of marks, JSON in noisy texts, breathings and blocks of posts."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.functions import text as X
from wayfarer.operators import json_schema, nearest
from wayfarer.sources import files
from wayfarer.streaming import inputs


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


def test_nearest_equals_all_pairs_at_poles_and_date_line(spark):
    rng = np.random.default_rng(3)
    sites = [(i, int(rng.integers(3)), float(lat), float(lon)) for i, (lat, lon) in enumerate(zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150), strict=True))]
    sites += [(200 + i, 1, float(lat), float(lon)) for i, (lat, lon) in enumerate([(90, 0), (89.9, 170), (-90, 10), (0, 179.99), (0, -179.99), (0.001, 0.001), (0.001, 0.002), (0, 0), (5, 5), (5, 5)])]
    sites += [(300, 7, 1.0, 1.0), (301, 8, None, 1.0), (302, None, 1.0, 1.0), (303, 9, 90.0, 0.0), (304, 9, -90.0, 0.0)]
    df = spark.createDataFrame(sites, "id int, nation int, lat double, lon double")
    got = {r.id: r.km for r in nearest.nearest(df, "id", "nation", "lat", "lon").collect()}
    for i, g, lat, lon in sites:
        others = [km((lat, lon), (o[2], o[3])) for o in sites if o[0] != i and o[1] == g and None not in (g, lat, lon, o[2], o[3])]
        assert got[i] == (pytest.approx(min(others), abs=1e-6) if others else None)


def test_marks_of_tied_and_null_lines(spark):
    rng = np.random.default_rng(4)
    lines = [(i, None if i % 50 == 0 else int(rng.integers(-5, 400))) for i in range(1500)] + [(2000 + i, 77) for i in range(800)]
    marks = [(int(m), k) for k, m in enumerate(rng.integers(0, 390, 30))] + [(77, 90), (77, 91), (None, 99)]
    got = inputs.active(spark.createDataFrame(lines, "i int, at int"), spark.createDataFrame(marks, "mark int, k int"), "at", "mark", "k").collect()
    assert len(got) == len(lines)
    held = [m for m in marks if m[0] is not None]
    for r in got:
        below = [m for m in held if r["at"] is not None and m[0] <= r["at"]]
        assert r.k == (max(below)[1] if below else None)


def last_object(text):
    s = text.strip()
    if s.startswith("```"):
        s = s.strip("`")
        s = (s[4:] if s.startswith("json") else s).strip()
    for i, c in enumerate(s):
        if c == "{":
            try:
                value, end = json.JSONDecoder().raw_decode(s[i:])
            except ValueError:
                continue
            if not s[i + end :].strip():
                return value
    return None


def test_json_objects_in_noisy_texts(spark):
    texts = ['{"a": 1}', 'said {so} {"a": {"b": "}{"}} ', '```json\n{"a": "x\\"}"}\n```', '{"a": 1} and more', "none", "", '{"a": [1, {"b": 2}]}', 'x {"a": "{", "c": 1}', '{"a": 1}{"b": 2}', '{broken} {"k": "\\\\"}', '{"a": "unclosed}', '} {"z": {}}', '"{" {"q": "\'"}']
    got = [json.loads(g[0]) if g[0] else None for g in values(spark, texts, X.json_object(F.col("x")))]
    assert got == [last_object(t) for t in texts]
    assert [g[0] for g in values(spark, ['{"b": 1, "a": 2}', '{"a": 1}', "x", None], X.has_exactly(F.col("x"), ["a", "b"]))] == [True, False, False, False]


def test_breathing_on_the_second_letter(spark):
    words = ["Αἷμος", "Εὕβοια", "Οἱ", "Ῥόδος", "Ἁλία", "Ἀθῆναι", "Αἰγύπτιος", "Ἄὕ", "ἀ"]
    assert [g[0] for g in values(spark, words, X.rough_breathing(F.col("x")))] == [True, True, True, True, True, False, False, False, False]
    assert "haimos" in values(spark, ["Αἷμος"], X.transliterations(F.col("x")))[0][0]


def test_blocks_end_with_their_post(spark):
    html = '<div class="a post-content"><h1>Head</h1><div><p>in</p><div><p>deep</p></div></div><p>last</p></div><div><p>footer</p></div>'
    ((rows,),) = values(spark, [html], files.post_blocks(F.col("x")))
    assert [(r.tag, r.text) for r in rows] == [("h1", "Head"), ("p", "in"), ("p", "deep"), ("p", "last")]


def test_nested_schema_rules(spark):
    schema = {
        "definitions": {"name": {"type": "string", "minLength": 2, "maxLength": 4}},
        "type": ["object", "null"],
        "properties": {
            "a": {"$ref": "#/definitions/name"},
            "n": {"type": "number", "minimum": 1.5},
            "list": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"properties": {"b": {"const": True}}, "required": ["b"]}},
            "any": {"anyOf": [{"type": "string"}, {"maximum": 3}]},
            "all": {"allOf": [{"type": "integer"}, {"enum": [1, 2, None]}]},
            "odd key": False,
        },
        "additionalProperties": {"type": "boolean"},
    }
    texts = ["null", "[]", '{"a": "x", "n": 1, "list": []}', '{"a": "abcde", "n": 2.5, "list": [{"b": true}, {"b": false}, {}]}', '{"any": 4, "all": 3, "more": true, "less": null}', '{"any": "x", "all": 2, "odd key": 1, "n": 2}', '{"a": null}', "{", None, '{"list": [1]}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted((r.i, r.path, r.rule) for r in json_schema.validate(df, "i", "t", schema).collect())
    assert got == [
        (1, "$", "type"),
        (2, "$.a", "minLength"), (2, "$.list", "minItems"), (2, "$.n", "minimum"),
        (3, "$.a", "maxLength"), (3, "$.list", "maxItems"), (3, "$.list[1].b", "const"), (3, "$.list[2].b", "required"),
        (4, "$.all", "enum"), (4, "$.any", "anyOf"), (4, "$.less", "type"),
        (5, "$.odd key", "false"),
        (6, "$.a", "type"),
        (7, "$", "json"),
    ]
    with pytest.raises(ValueError):
        json_schema.validate(df, "i", "t", {"properties": {"a": {"$ref": "#"}}})
