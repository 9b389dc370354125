"""Names met with texts over a trie of their words: a text is read once, whatever the number of names."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import keyed
from wayfarer.functions.text import marked_letters

#: A word is a run of letters, digits and the marks on them.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"
#: Names that every task may hold at once; of more, a text is given those whose first word it has.
HELD_NAMES = 200_000

_BARE = str.maketrans(*marked_letters())
_MARKS = regex.compile(r"\p{Mn}")
_PLAIN_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=1 << 16)
def key_form(word: str) -> str:
    """Folded, final sigma as sigma, white space collapsed."""
    bare = word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")
    return " ".join(bare.lower().replace("ς", "σ").split())


def words_at(texts: DataFrame, key: str, text: str, pattern: str = WORD) -> DataFrame:
    """``key``, ``i``, ``surface``, ``word`` (its key form), ``start`` and ``end`` of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = regex.compile(pattern)
        for b in batches:
            for k, value in zip(b[key], b[text].to_pylist(), strict=True):
                found = list(word.finditer(value)) if value else []
                for s in range(0, len(found), 50_000):
                    some = found[s : s + 50_000]
                    columns = [pa.array([k.as_py()] * len(some), b.schema.field(key).type), pa.array(range(s, s + len(some)), pa.int32()), pa.array([m[0] for m in some], pa.string()), pa.array([key_form(m[0]) for m in some], pa.string()), pa.array([m.start() for m in some], pa.int32()), pa.array([m.end() for m in some], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, [key, "i", "surface", "word", "start", "end"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, i int, surface string, word string, start int, end int")


class Trie:
    """Names (in key form) by their words; what stands before the first and after the last word is compared when all words have met."""

    def __init__(self, names: list[str]):
        self.root: dict = {}
        word = regex.compile(WORD)
        for name in names:
            found = list(word.finditer(name))
            if found:
                node = self.root
                for m in found:
                    node = node.setdefault(m[0], {})
                node.setdefault("", []).append((name, name[: found[0].start()], name[found[-1].end() :]))

    def hits(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Name, start and end in the text wherever a name stands with no letter or digit at its sides."""
        folded = text.translate(_BARE).lower().replace("ς", "σ")
        if len(folded) == len(text) and not _MARKS.search(text):
            yield from self._walk(text, folded)
        else:
            yield from self._walk_apart(text)

    def _walk(self, text: str, folded: str) -> Iterator[tuple[str, int, int]]:
        """Where each letter of the text is one of its key form, the next word is looked for only while a name goes on."""
        for m in _PLAIN_WORD.finditer(folded):
            node, last = self.root.get(m[0]), m
            while node is not None:
                yield from self._ends(text, node, m.start(), last.end())
                last = _PLAIN_WORD.search(folded, last.end())
                node = node.get(last[0]) if last else None

    def _walk_apart(self, text: str) -> Iterator[tuple[str, int, int]]:
        found = list(regex.finditer(WORD, text))
        words = [key_form(m[0]) for m in found]
        for i in range(len(found)):
            node, j = self.root.get(words[i]), i
            while node is not None:
                yield from self._ends(text, node, found[i].start(), found[j].end())
                j += 1
                node = node.get(words[j]) if j < len(words) else None

    def _ends(self, text: str, node: dict, start: int, end: int) -> Iterator[tuple[str, int, int]]:
        for name, before, after in node.get("", ()):
            a, b = _start(text, start, before), _end(text, end, after)
            if a is not None and b is not None and key_form(text[a:b]) == name:
                yield name, a, b


def _touches(text: str, at: int, step: int) -> bool:
    while 0 <= at < len(text) and unicodedata.category(text[at]) == "Mn":
        at += step
    return 0 <= at < len(text) and text[at].isalnum()


def _start(text: str, at: int, before: str) -> int | None:
    if not before:
        return at
    for a in range(at - 1, max(-1, at - 4 * len(before) - 8), -1):
        if not text[a].isspace() and key_form(text[a:at] + "x") == before + "x":
            return None if _touches(text, a - 1, -1) else a
    return None


def _end(text: str, at: int, after: str) -> int | None:
    if not after:
        # a loose mark on the last letter is not part of the span
        while unicodedata.category(text[at - 1]) == "Mn":
            at -= 1
        return at
    for b in range(at + 1, min(len(text), at + 4 * len(after) + 8) + 1):
        if not text[b - 1].isspace() and key_form("x" + text[at:b]) == "x" + after:
            return None if _touches(text, b, 1) else b
    return None


class Phrases:
    """Names of several words (in key form), by three letters at most on each side of their first space."""

    def __init__(self, names: list[str]):
        shapes: dict[tuple[int, int], dict[str, list]] = defaultdict(lambda: defaultdict(list))
        for name in names:
            at = name.index(" ")
            left, right = min(3, at), min(3, len(name) - at - 1)
            shapes[left, right][name[at - left : at + right + 1]].append((name, at))
        # which shapes some name has beside the two letters around the space
        self.shapes: dict[str, list] = defaultdict(list)
        for (left, right), grams in shapes.items():
            for around in {g[max(0, left - 1) : left + 2] for g in grams}:
                self.shapes[around].append((left, right + 1, grams))
        self.bare = any(0 in shape for shape in shapes)

    def near(self, form: str, at: int) -> list:
        if not self.bare:
            return self.shapes.get(form[at - 1 : at + 2], ()) if at else ()
        # names that begin or end with their only space
        around = {form[max(0, at - 1) : at + 2], form[at : at + 2], form[max(0, at - 1) : at + 1], " "}
        return [shape for a in around for shape in self.shapes.get(a, ())]

    def spans(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Start and end in the text, and name, wherever a name stands in its key form and has not met itself."""
        if not self.shapes:
            return
        form = keyed.key_text(text).rstrip(" ")
        places, taken = None, {}
        at = form.find(" ")
        while at >= 0:
            for left, right, names in self.near(form, at):
                for name, before in names.get(form[at - left : at + right], ()) if at >= left else ():
                    s = at - before
                    if s >= taken.get(name, 0) and form.startswith(name, s):
                        taken[name] = s + len(name)
                        places = places or keyed.Places(text)
                        yield places(s), places(s + len(name) - 1) + 1, name
            at = form.find(" ", at + 1)


class Free:
    """Whether a span meets none of some spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return not before or self.ends[before - 1] <= start


@lru_cache(maxsize=1 << 16)
def is_large(word: str) -> bool:
    """Three letters at least, the first a large one and some small, without their marks."""
    bare = keyed.bare(word)
    return len(bare) >= 3 and unicodedata.category(bare[0]) == "Lu" and any(unicodedata.category(c) == "Ll" for c in bare)


def longest_first(hits: list[tuple[str, int, int]], taken: list[tuple[int, int]] | None = None) -> Iterator[tuple[str, int, int]]:
    """Hits that share no place with one taken before: more words first, then longer, then by text and start."""
    held = sorted(taken or [])
    for name, a, b in sorted(hits, key=lambda h: (-len(h[0].split()), -len(h[0]), h[0], h[1])):
        at = bisect_left(held, (a, b))
        if not (at and held[at - 1][1] > a) and not (at < len(held) and held[at][0] < b):
            held.insert(at, (a, b))
            yield name, a, b


def name_spans(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, own: str | None, cues: list[str], width: int) -> DataFrame:
    """``key``, ``name``, ``surface``, ``start`` and ``end`` of mentions without overlaps: see ``mentions.span_mentions``."""
    names = names.select(F.col(name).alias("_name")).where("_name <> ''").distinct()
    rows = texts.select(key, F.col(text).alias("_text"), F.col(own).alias("_own") if own else F.array().cast("array<string>").alias("_own"))
    # at most one row more than may be held
    held = [r[0] for r in names.limit(HELD_NAMES + 1).collect()]
    whole = None
    if len(held) <= HELD_NAMES:
        whole = texts.sparkSession.sparkContext.broadcast(held)
        rows = rows.withColumn("_names", F.lit(None).cast("array<string>"))
    else:
        first = names.withColumn("_word", F.regexp_extract("_name", r"([\p{L}\p{N}]+)", 1)).where("_word <> ''")
        met = words_at(texts, key, text).select(key, F.col("word").alias("_word")).distinct().join(first, "_word").groupBy(key).agg(F.collect_set("_name").alias("_names"))
        rows = rows.join(met, key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(whole.value) if whole else None
        for b in batches:
            out = []
            for k, value, not_these, candidates in zip(*(b[c].to_pylist() for c in (key, "_text", "_own", "_names")), strict=True):
                if not value:
                    continue
                skip, fits = set(not_these or ()), []
                for n, s, e in (trie or Trie(candidates)).hits(value):
                    head = value[s]
                    if n not in skip and head.upper() == head != head.lower():
                        around = key_form(value[max(0, s - width) : e + width])
                        if not any(cue in around for cue in cues):
                            fits.append((n, s, e))
                out += [(k, n, value[s:e], s, e) for n, s, e in longest_first(fits)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (b.schema.field(key).type, pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [key, "name", "surface", "start", "end"])

    kind = texts.schema[key].dataType.simpleString()
    return rows.mapInArrow(scan, f"{key} {kind}, name string, surface string, start int, end int")
