"""Text normalisation, identifiers, windows, snippets and small parsers, as columns."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER_OR_DIGIT = r"[\p{L}\p{N}]"


@cache
def marked_letters() -> tuple[str, str]:
    """All single letters that decompose to a base and marks, and their bases: by the rules of Unicode."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def strip_marks(x: Column) -> Column:
    """Without diacritics: loose marks go, marked letters become their bases; one letter for one."""
    return F.translate(F.regexp_replace(x, r"\p{Mn}", ""), *marked_letters())


def fold(x: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(strip_marks(x))


def fold_key(x: Column) -> Column:
    """Key form: folded, final sigma as sigma, white space collapsed; punctuation stays."""
    return F.trim(F.regexp_replace(F.translate(fold(x), "ς", "σ"), r"\s+", " "))


def fold_alnum(x: Column) -> Column:
    """Label form: folded, whatever is no digit, Latin or Greek letter becomes one space."""
    return F.trim(F.regexp_replace(F.translate(fold(x), "ς", "σ"), "[^0-9a-zα-ω]+", " "))


def fold_ascii_dedup(x: Column) -> Column:
    """Marker form: ASCII letters and digits only, doubled letters single."""
    return F.regexp_replace(F.trim(F.regexp_replace(fold(x), "[^0-9a-z]+", " ")), r"([a-z])\1", "$1")


def fold_end(x: Column) -> Column:
    """Token form: folded and trimmed at the ends; inner white space stays."""
    return F.trim(fold(x))


def fold_compact(x: Column) -> Column:
    """Name form: ASCII letters and digits without spaces."""
    return F.regexp_replace(fold(x), "[^0-9a-z]", "")


# Greek letters in Latin, for identifiers.
LATIN = {"α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "ch", "ψ": "ps", "ω": "o"}
# Fixed value: the one letter that differs in spellings of names.
SPELLED = {"υ": "y"}


def _latin(x: Column, letters: dict[str, str]) -> Column:
    one = {a: b for a, b in letters.items() if len(b) == 1}
    y = F.translate(x, "".join(one), "".join(one.values()))
    for a, b in letters.items():
        if len(b) > 1:
            y = F.replace(y, F.lit(a), F.lit(b))
    return y


def slug(x: Column, empty: str = "place") -> Column:
    """ASCII slug with underscores; Greek letters are written in Latin."""
    y = _latin(F.replace(fold(x), F.lit("ß"), F.lit("ss")), LATIN)
    y = F.regexp_replace(F.regexp_replace(y, "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(y, F.lit("")), F.lit(empty))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first twelve hex digits of SHA-1 over the parts, joined by the unit separator symbol."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(F.concat_ws("␟", *[p.cast("string") for p in parts])), 1, 12))


def clean(x: Column) -> Column:
    """White space collapsed; empty and ``nan`` become null."""
    y = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when((y != "") & (F.lower(y) != "nan"), y)


def tokens(x: Column) -> Column:
    """The runs of letters and digits."""
    return F.regexp_extract_all(x, F.lit(f"({LETTER_OR_DIGIT}+)"), 1)


def find_folded(text: Column, needle: Column) -> Column:
    """Offsets (from 0, end not included) in the original text of the needle, both in key form; null if absent.

    A text is folded once; only what its key form leaves out (loose marks, runs
    of white space) is counted to place the hit.
    """

    @F.udf("start int, end int", useArrow=True)
    def found(x: str | None, key: str | None):
        from wayfarer.functions.keyed import find

        return find(x, key)

    return found(text, fold_key(needle))


def find_surface(text: Column, surface: Column) -> Column:
    """The surface as it stands in the text; else the run of six words at most whose label form is the same; else null."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(\S+(?:\s+\S+){0,5})"), 1), lambda r: F.regexp_replace(r, "^[ .,;:··]+|[ .,;:··]+$", ""))
    same = F.get(F.filter(runs, lambda r: (fold_alnum(r) == fold_alnum(surface)) & (fold_alnum(surface) != "")), F.lit(0))
    return F.when(F.contains(text, surface) & (surface != ""), surface).otherwise(same)


def on_token_boundary(text: Column, start: Column, end: Column) -> Column:
    """Whether no letter or digit touches the span from the outside."""
    before = F.when(start > 0, F.substr(text, start, F.lit(1))).otherwise("")
    after = F.substr(text, end + 1, F.lit(1))
    return ~before.rlike(LETTER_OR_DIGIT) & ~after.rlike(LETTER_OR_DIGIT)


def context_window(text: Column, start: Column, end: Column, width: int) -> Column:
    """The span with ``width`` characters on each side, white space collapsed, dots where it was cut."""
    left = F.greatest(F.lit(0), start - width)
    right = F.least(F.length(text), end + width)
    body = F.trim(F.regexp_replace(F.substr(text, left + 1, right - left), r"\s+", " "))
    return F.concat(F.when(left > 0, "…").otherwise(""), body, F.when(right < F.length(text), "…").otherwise(""))


def sentences(text: Column) -> Column:
    """Sentences with their terminators."""
    return F.filter(F.split(text, r"(?<=[.·;!?])\s+"), lambda s: s != "")


def sentence_around(text: Column, at: Column) -> Column:
    """The sentence that holds the position (from 0)."""
    before = F.regexp_extract(F.substr(text, F.lit(1), at), r"([^.;·]*)$", 1)
    after = F.regexp_extract(F.substr(text, at + 1), r"^([^.;·]*[.;·]?)", 1)
    return F.trim(F.concat(before, after))


def proportional_snippet(text: Column, at: Column, parallel: Column) -> Column:
    """The sentence of a parallel text that stands as far along as ``at`` in ``text``."""
    there = F.least(F.floor(at / F.greatest(F.length(text), F.lit(1)) * F.length(parallel)), F.length(parallel) - 1).cast("int")
    return sentence_around(parallel, there)


def search_snippet(body: Column, at: Column, before: int = 55, after: int = 65, first: int = 110) -> Column:
    """Characters around a hit (position from 1; 0: no hit, the beginning)."""
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substr(body, start, at + after - start)).otherwise(F.substr(body, F.lit(1), F.lit(first)))


def truncate(x: Column, n: int) -> Column:
    """At most n characters, the last three dots where it was cut."""
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substr(x, F.lit(1), F.lit(n - 3))), F.lit("..."))).otherwise(x)


def split_labels(x: Column, pattern: str = r"[:;\n]") -> Column:
    """Trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(x, pattern), lambda p: F.trim(p)), lambda p: p != "")


def html_escape(x: Column) -> Column:
    """The five characters that HTML reserves, as references."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def strip_tags(x: Column) -> Column:
    """Text without notes and markup."""
    return F.regexp_replace(F.regexp_replace(x, r"(?s)<note\b.*?</note>", ""), r"<[^>]*>", "")


_ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n: Column) -> Column:
    """Roman numeral of a positive integer."""
    out, rest = F.lit(""), n
    for value, sign in _ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def integers(x: Column) -> Column:
    """All runs of digits as integers."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"(\d+)"), 1), lambda d: d.cast("long"))


def id_from_uri(x: Column) -> Column:
    """The last segment of a URI, without query and fragment."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(x, "[?#].*$", ""), "/+$", ""), "/"), -1)


def citation(volume: Column, page: Column, line: Column, end_page: Column, end_line: Column) -> Column:
    """``vol page.line`` with the shortest form of the range's end."""
    start = F.concat_ws(" ", volume.cast("string"), F.concat_ws(".", page.cast("string"), line.cast("string")))
    end = F.when(end_page != page, F.concat_ws(".", end_page.cast("string"), end_line.cast("string"))).when(end_line != line, end_line.cast("string"))
    return F.concat_ws("-", start, end)


def parse_citation(x: Column) -> Column:
    """``volume``, ``page``, ``line``, ``end_page``, ``end_line`` of what ``citation`` writes; null where the text is no citation."""
    pattern = r"^(\S+) (\d+)\.(\d+)(?:[-–](?:(\d+)\.)?(\d+))?$"
    # all groups by one match, apart by a sign that no group can hold
    parts = F.split(F.regexp_replace(x, pattern, "$1\n$2\n$3\n$4\n$5\n"), "\n")
    number = lambda p, i: F.get(p, F.lit(i)).try_cast("int")
    row = lambda p: F.struct(F.get(p, F.lit(0)).alias("volume"), number(p, 1).alias("page"), number(p, 2).alias("line"), F.coalesce(number(p, 3), number(p, 1)).alias("end_page"), F.coalesce(number(p, 4), number(p, 2)).alias("end_line"))
    return F.when(x.rlike(pattern), F.get(F.transform(F.array(parts), row), F.lit(0)))


# Numbers in words, and patterns of distances in order of rank.
NUMBER_WORDS = {"eight hundred": 800.0, "three thousand": 3000.0, "four thousand": 4000.0}
DISTANCES = [r"about\s+([0-9,]+)\s+stades", r"after\s+([0-9,]+)\s+stades", r"([0-9,]+)\s+stades", r"about\s+(eight hundred|three thousand|four thousand)\s+stades", r"after\s+(eight hundred|three thousand|four thousand)\s+stades"]
RUNS = ["two or three runs", "two runs"]


def distance(x: Column) -> Column:
    """The distance phrase of the highest rank: ``phrase``, ``value`` (none for runs), ``unit``, and kilometres of 185 m stades."""
    low = F.lower(x)
    words = F.create_map(*[F.lit(v) for pair in NUMBER_WORDS.items() for v in pair])
    found = None
    for pattern in DISTANCES:
        said = F.regexp_extract(low, pattern, 1)
        value = F.coalesce(F.element_at(words, said), F.expr("try_cast(NULL AS double)") if "hundred" in pattern else F.replace(said, F.lit(","), F.lit("")).try_cast("double"))
        row = F.struct(F.regexp_extract(low, pattern, 0).alias("phrase"), value.alias("value"), F.lit("stades").alias("unit"))
        hit = value.isNotNull()
        found = F.when(hit, row) if found is None else found.when(hit, row)
    for phrase in RUNS:
        found = found.when(F.contains(low, F.lit(phrase)), F.struct(F.lit(phrase).alias("phrase"), F.lit(None).cast("double").alias("value"), F.lit("runs").alias("unit")))
    return F.struct(found["phrase"].alias("phrase"), found["value"].alias("value"), found["unit"].alias("unit"), F.bround(found["value"] * 0.185, 1).alias("km"))


# Endings that change between spellings of a name, with the least length.
ENDINGS = [("on", "um", 2), ("os", "us", 2), ("e", "a", 4), ("eia", "ia", 3), ("eias", "ias", 4)]


def rough_breathing(x: Column) -> Column:
    """Whether one of the first three signs of the decomposed name is the rough breathing: on the first letter, or on the second of a diphthong whose first has no mark."""
    apart = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in (*range(0x370, 0x400), *range(0x1F00, 0x2000))}
    rough = "".join(c for c, d in apart.items() if "\u0314" in d[:3])
    marked = "".join(c for c, d in apart.items() if len(d) > 1)
    return x.rlike(f"^(?:.\u0314|[{rough}]|[^{marked}][{rough}]|..\u0314)")


def transliterations(x: Column) -> Column:
    """All Latin spellings of a name, sorted: h for the rough breathing, c for k, u for y, other endings, ae for ai."""
    base = _latin(fold(x), LATIN | SPELLED)
    breathed = F.when(base.startswith("r"), F.concat(F.lit("rh"), F.substr(base, F.lit(2)))).when(base.rlike("^[aeiouy]"), F.concat(F.lit("h"), base)).otherwise(base)
    found = F.array_distinct(F.array(base, F.when(rough_breathing(x), breathed).otherwise(base)))
    swap = lambda a, b: lambda s: F.array(F.replace(s, F.lit(a), F.lit(b)))

    def endings(s: Column) -> Column:
        return F.array(*[F.when(s.endswith(a) & (F.length(s) >= n), F.concat(F.substr(s, F.lit(1), F.length(s) - len(a)), F.lit(b))).otherwise(s) for a, b, n in ENDINGS])

    for change in (swap("k", "c"), swap("y", "u"), endings, swap("ai", "ae")):
        # as an element of an array, so that what is found so far is made once and not for each time it is named
        found = F.get(F.transform(F.array(found), lambda so_far: F.array_distinct(F.concat(so_far, F.flatten(F.transform(so_far, change))))), F.lit(0))
    return F.array_sort(F.filter(found, lambda s: s != ""))


def derive_lemma(x: Column) -> Column:
    """The name an entry is about: without number and note in brackets, what brackets hold, else up to four words before the first stop."""
    y = F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*\d+\s+", ""), r"^\s*\[[^\]]{1,80}\]\s*", ""))
    inside = F.regexp_extract(y, r"^\[([^\]]{1,80})\]", 1)
    y = F.when(inside != "", inside).otherwise(y)
    y = F.regexp_replace(y, r"(?i)^[α-ωΑ-Ωϛϙϟʹ΄´'.\s]+περὶ\s+", "")
    words = F.filter(F.split(F.regexp_extract(y, r"^([^··.:]*)", 1), r"\s+"), lambda w: w != "")
    return F.regexp_replace(F.array_join(F.slice(words, 1, 4), " "), r"^[\[\] ,;·.]+|[\[\] ,;·.]+$", "")


# What says that a name is another name of the same thing.
ALIAS_CUES = ["καλουσιν", "καλειται", "προσαγορευ", "ονομαζ"]


def alias_context(text: Column, start: Column, end: Column, width: int = 35) -> Column:
    """Whether a cue that the name is an alias stands within ``width`` characters of the span."""
    around = fold_key(context_window(text, start, end, width))
    hit = F.lit(False)
    for cue in ALIAS_CUES:
        hit = hit | F.contains(around, F.lit(cue))
    return hit


def human(x: Column) -> Column:
    """An identifier as a label: underscores as spaces, the first letter large."""
    y = F.trim(F.replace(x, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substr(y, F.lit(1), F.lit(1))), F.substr(y, F.lit(2)))


def query_escape(x: Column) -> Column:
    """For the query part of a URL."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def labelled_lines(x: Column) -> Column:
    """Lines ``Label: value`` as a map; a label's first line counts."""
    pairs = F.filter(F.transform(F.split(x, r"\n"), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract(p, r"^[^:]+:(.*)$", 1)).alias("value"))), lambda p: p["key"] != "")
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


def file_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves one or more."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**power, F.concat(F.format_number(n / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def json_object(x: Column) -> Column:
    """The JSON object that ends a text, as text: what stands before it, and a fence of backticks around all, are left out; null if there is none.

    From each brace on, depth and quotes are followed letter by letter.  The first
    brace whose object closes at the end of the text, and whose content parses,
    counts.
    """
    y = F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))
    y = F.when(y.startswith("```"), F.regexp_replace(F.regexp_replace(F.regexp_replace(y, "^`+|`+$", ""), "^json", ""), r"^\s+|\s+$", "")).otherwise(y)
    # each part begins with a brace; an object that ends the text is the parts from its brace on
    parts = F.split(y, r"(?=\{)", -1)
    last = F.regexp_replace(y, r"^[^{]*", "")
    state = F.struct(F.lit(-1).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(False).alias("over"))

    def step(a: Column, c: Column) -> Column:
        quoted, escaped = a["quoted"], a["escaped"]
        depth = F.when(a["depth"] < 0, 1).when(~quoted & (c == "{"), a["depth"] + 1).when(~quoted & (c == "}"), a["depth"] - 1).otherwise(a["depth"])
        return F.struct(depth.alias("depth"), F.when((c == '"') & ~escaped, ~quoted).otherwise(quoted).alias("quoted"), (quoted & ~escaped & (c == "\\")).alias("escaped"), (a["over"] | (a["depth"] == 0)).alias("over"))

    def closes(s: Column) -> Column:
        return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), state, step, lambda a: (a["depth"] == 0) & ~a["quoted"] & ~a["over"])

    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ""))
    whole = F.filter(tails, lambda s: s.startswith("{") & F.endswith(s, F.lit("}")) & closes(s) & F.json_object_keys(s).isNotNull())
    return F.when(last != "", F.get(whole, F.lit(0)))


def has_exactly(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no others."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))
