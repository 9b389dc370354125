"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its tags with the path that leads to them, and
its words with the path of their element.  Tokens of a host that occur equally
often on every page have one occurrence vector and form an equivalence class.
A class that is large and frequent is valid if its tokens keep one order on all
pages and if it nests: all its occurrences lie in one gap of the class above.
The valid classes make the template; what is left between its tokens are the
slots, and the text in them is data.

The distinct pages of a host are dealt by the hash of their content to parts of
about ``PART``.  A part hands on what it finds: of each token that stands on
half of its pages the number of pages, a signature of its occurrence vector (made of a
sum over pages, so those of the parts together are that of the host), and
whether its class is valid here.  What is added up over the host decides: a
token is template if it stands on ``FREQUENT`` of all its distinct pages, is
valid in every part that knows it, and shares its signature with ``LARGE``
tokens.  (A token that frequent stands on less than half of a part of 256 pages
with a chance of 1e-14.)

The slots with data say where the main text is.  Over the host, the words of
all data slots outside side elements and links are added up, and those of them
in ``article`` or ``main`` elements: where these hold most, they are the main
slots, else all are; the main text is what lies below the lowest element above
all main slots.  Outside ``article`` and ``main`` a block that is template
through and through is left out; inside them nothing is, even if all pages
share it.  Menus, headers, footers, side bars, notices, adverts, forms,
scripts, styles and reader comments are left out wherever they stand: told by
element and role, and by class or id (inside an article only where the whole
name says so: ``ad-slot`` goes, ``social-science`` stays).  A page that has no
text at its host's place gives its own articles, or else its own data.

White space inside a block becomes one space, blocks are joined by an empty
line, character references are decoded.

Edge cases: null or empty html gives the empty text; tags may be unclosed,
badly nested or cut off; a host with fewer than ``PAGES`` distinct pages has no
template, and rests on its slots alone; a null or odd url counts as the host
''; rows that repeat are kept each, but copies count once in the deduction;
extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm._shared import written
from wayfarer.llm._text import SPACED, blocks, hashed_words, mix

#: Distinct pages in a part of a host.
PART = 256
#: Hosts, and bytes of their templates, that are broadcast at most.
BROADCAST_HOSTS, BROADCAST_BYTES = 100_000, 32_000_000
#: A class is large with so many tokens, and frequent on this part of the distinct pages, which must be so many.
LARGE, FREQUENT, PAGES = 3, 0.75, 5

# Names of HTML elements.
RAW = "script style noscript template textarea iframe svg math object canvas title select".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
ASIDE = set("nav header footer aside form menu dialog button".split())
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
NAMES = set(
    "nav navbar navigation menu sidebar aside footer header masthead breadcrumb breadcrumbs ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies respond widget pagination pager toolbar skip".split()
)

#: Inside an article a name counts if all its parts are such names or say nothing, and one is such a name.
INSIDE = NAMES - set("header masthead aside social signup login skip nav navigation menu".split()) | set("sidebar navbar".split())
GENERIC = set("list box area slot block section container wrapper wrap widget widgets bar button buttons link links form unit top bottom left right inner outer content post posts article articles page site entry item the and at x".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>%s)\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>" % "|".join(RAW), re.S | re.I
)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


class _Element:
    __slots__ = ("article", "aside", "main", "path", "tag")

    def __init__(self, tag: str, path: str, aside: bool, article: bool, main: bool):
        self.tag, self.path, self.aside, self.article, self.main = tag, path, aside, article, main


class Block:
    """A block of text: its element's path, its text, where it stands, and how much of it is links."""

    __slots__ = ("article", "aside", "linked", "main", "path", "pieces")

    def __init__(self, element: _Element):
        self.path, self.aside, self.article, self.main = element.path, element.aside, element.article, element.main
        self.pieces, self.linked = [], 0

    def text(self) -> str:
        return " ".join(unescape("".join(self.pieces)).split())


def _says_aside(name: str, inside: bool) -> bool:
    """Whether class and id call the element one that holds no main text."""
    if not inside:
        return not NAMES.isdisjoint(_PARTS.findall(name))
    for one in name.split():
        parts = set(_PARTS.findall(one))
        if parts & INSIDE and parts <= NAMES | GENERIC:
            return True
    return False


def _element(tag: str, rest: str, above: _Element) -> _Element:
    named = {k.lower(): (a or b or c).lower() for k, a, b, c in _NAMED.findall(rest)} if rest and not rest.isspace() else {}
    # without digits, which number elements and would make every path another
    name = _DIGITS.sub("", " ".join(x for x in (named.get("class"), named.get("id")) if x))
    role = named.get("role", "")
    article = above.article or (tag == "article" and not above.aside) or named.get("itemprop") == "articlebody"
    main = above.main or tag == "main" or role == "main"
    aside = above.aside
    if not aside and tag not in ("html", "body", "article", "main"):
        aside = (tag in ASIDE and not (tag == "header" and above.article)) or role in ROLES or _says_aside(name, above.article)
    elif not aside and tag == "article" and name:
        aside = not {"comment", "comments", "reply", "related", "ad", "ads", "promo", "sponsored"}.isdisjoint(_PARTS.findall(name))
        article = article and not aside
    return _Element(tag, f"{above.path}/{tag}" + (f".{name}" if name else ""), aside, article, main)


def parse(html: str) -> tuple[list[Block], list[str | Block]]:
    """The blocks of a page in order, and its tags (as paths) and blocks in order."""
    root = _Element("", "", False, False, False)
    stack, blocks, order = [root], [], []
    block: Block | None = None
    links = 0
    at = 0

    def say(text: str) -> None:
        nonlocal block
        if block is None:
            if not text or text.isspace():
                return
            top = next(e for e in reversed(stack) if e.tag in BLOCKS or not e.tag)
            last = stack[-1]
            if last.aside and not top.aside:
                top = last
            block = Block(top)
            order.append(block)
            blocks.append(block)
        block.pieces.append(text)
        if links:
            block.linked += len(text)

    for found in _TAG.finditer(html):
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag in VOID:
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                if any(e.tag in BLOCKS or e.aside != stack[depth - 1].aside for e in stack[depth:]):
                    block = None
                links -= sum(e.tag == "a" for e in stack[depth:])
                del stack[depth:]
            if tag in BLOCKS:
                block = None
            elif tag in ("td", "th"):
                say(" ")
            continue
        if tag in BLOCKS:
            block = None
            closing = CLOSES.get(tag, set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in closing:
                    links -= sum(e.tag == "a" for e in stack[i:])
                    del stack[i:]
                    if "p" not in (e.tag for e in stack):
                        break
                elif stack[i].tag in BLOCKS:
                    break
        elif tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    links -= sum(e.tag == "a" for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "tr"):
                    break
            say(" ")
        if tag in VOID:
            if tag in ("br", "wbr"):
                say(" " if tag == "br" else "")
            continue
        element = _element(tag, found["rest"], stack[-1])
        order.append(element.path)
        if found["rest"].endswith("/") and tag not in BLOCKS:
            continue
        if element.aside != stack[-1].aside:
            block = None
        stack.append(element)
        if tag == "a":
            links += 1
    if at < len(html):
        rest = html[at:]
        say(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^>]*\Z", rest) else rest)
    return blocks, order


class Part:
    """The tokens of some distinct pages of a host, end to end."""

    def __init__(self, pages: list[str], hashes: np.ndarray):
        parsed = [parse(html) for html in pages]
        self.blocks = [b for found, _ in parsed for b in found]
        words, self.bounds = hashed_words(pa.array([b.text() for b in self.blocks], pa.string()), SPACED)
        paths: dict[str, int] = {}
        hashed = lambda path: paths.get(path) or paths.setdefault(path, _path_hash(path))
        n_words = np.diff(self.bounds)
        #: The tokens of all blocks, end to end.
        self.words = mix(words ^ np.repeat(np.array([hashed(b.path) for b in self.blocks], np.uint64), n_words))
        # a tag is one token, a block as many as it has words: blocks come in the order of their words
        tags = [hashed(x) if isinstance(x, str) else None for _, order in parsed for x in order]
        is_tag = np.array([x is not None for x in tags], bool)
        lengths = np.ones(len(tags), np.int64)
        lengths[~is_tag] = n_words
        of_tag = np.repeat(is_tag, lengths)
        self.tokens = np.empty(len(of_tag), np.uint64)
        self.tokens[of_tag] = np.array([x for x in tags if x is not None], np.uint64)
        self.tokens[~of_tag] = self.words
        self.page = np.repeat(np.repeat(np.arange(len(pages)), [len(order) for _, order in parsed]), lengths)
        self.n = len(pages)
        self.hashes = hashes.astype(np.uint64)
        order = np.lexsort((self.page, self.tokens))
        tok, at = self.tokens[order], self.page[order]
        first = np.flatnonzero(np.append(True, (tok[1:] != tok[:-1]) | (at[1:] != at[:-1]))) if len(tok) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(tok))).astype(np.uint64)
        tok, at = tok[first], at[first]
        start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])) if len(tok) else np.zeros(0, np.int64)
        self.found = tok[start]
        self.pages = np.diff(np.append(start, len(tok)))
        #: The occurrence vector, as a sum over pages.
        self.signature = np.add.reduceat(mix(self.hashes[at] + mix(times)), start) if len(start) else np.zeros(0, np.uint64)
        self.once = np.maximum.reduceat(times, start) == 1 if len(start) else np.zeros(0, bool)

    def valid(self) -> np.ndarray:
        """Of the tokens on half of the pages, those whose class keeps one order and nests."""
        good = np.zeros(len(self.found), bool)
        often = np.flatnonzero(2 * self.pages >= max(2, self.n))
        order = often[np.argsort(self.signature[often], kind="stable")]
        cuts = np.flatnonzero(np.diff(self.signature[order].view(np.int64))) + 1
        classes = [c for c in np.split(order, cuts) if len(c) >= LARGE]
        at = np.searchsorted(self.found, self.tokens)
        frame = np.zeros(len(self.tokens), bool)
        # once on every page that holds them: the frame; others must repeat inside one of its gaps
        for c in sorted((c for c in classes if self.once[c].all()), key=lambda c: (-self.pages[c[0]], -len(c))):
            here = np.flatnonzero(np.isin(at, c))
            sequences = at[here].reshape(-1, len(c))
            if (sequences == sequences[0]).all():
                good[c] = True
                frame[here] = True
        before = np.maximum.accumulate(np.where(frame, np.arange(len(at)), -1)) if len(at) else at
        for c in classes:
            if not self.once[c].all():
                gaps = before[np.isin(at, c)]
                good[c] = len(np.unique(np.where(gaps >= 0, at[gaps], -1))) == 1
        return good


def _path_hash(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path)


def _word_tokens(path: str, words: np.ndarray) -> np.ndarray:
    return mix(words ^ np.uint64(_path_hash(path)))


def _lowest(low: str, high: str) -> str:
    """The lowest path above all those between two in order (each ends with a slash)."""
    return commonprefix([low, high]).rpartition("/")[0]


def extract_page(html: str | None, known: np.ndarray, place: str, hinted: bool) -> tuple[str, list[tuple[str, str]]]:
    """Main text, and the slots (path and text), of a page whose host has this template and main place."""
    found, _ = parse(html or "")
    data = [(b, b.text()) for b in found]
    data = [(b, t) for b, t in data if t]
    if len(known):
        words, bounds = hashed_words(pa.array([t for _, t in data], pa.string()), SPACED)
        left = [not np.isin(_word_tokens(b.path, words[bounds[i] : bounds[i + 1]]), known).all() for i, (b, _) in enumerate(data)]
    else:
        left = [True] * len(data)
    slots = [(b.path, t) for (b, t), x in zip(data, left, strict=True) if x]
    there = [(b, t, x) for (b, t), x in zip(data, left, strict=True) if not b.aside]
    articles = [t for b, t, _ in there if b.article] or [t for b, t, _ in there if b.main]
    main = articles if hinted else [t for b, t, x in there if x and (b.path + "/").startswith(place + "/")]
    return "\n\n".join(main or articles or [t for b, t, x in there if x and 2 * b.linked < len(t)]), slots


FOUND = "host string, token bigint, signature bigint, pages bigint, valid boolean, all bigint, hinted bigint, low string, high string, low_hinted string, high_hinted string"


def deduce(pages: DataFrame) -> DataFrame:
    """Of (host, h, html), h the hash of the html: a row for each host, with ``known`` (the template's tokens), ``place`` and ``hinted``."""

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[str, int]] = set()
        for batch in batches:
            new = []
            for i, x in enumerate(zip(batch.column("host").to_pylist(), batch.column("h").to_pylist(), strict=True)):
                if x not in met:
                    met.add(x)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    parts = pages.groupBy("host").agg(F.ceil(F.count_distinct("h") / PART).alias("parts")).where("parts > 1")
    # only where large hosts are too many to broadcast does a page travel to its host before its part
    few = parts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    dealt = pages.mapInArrow(unseen, pages.schema).join(F.broadcast(parts) if few else parts, "host", "left")
    dealt = dealt.withColumn("part", F.pmod("h", F.coalesce("parts", F.lit(1)))).drop("parts")

    def found(table: pa.Table) -> pa.Table:
        hashes, first = np.unique(table["h"].to_numpy(), return_index=True)
        part = Part([x or "" for x in table["html"].take(pa.array(first)).to_pylist()], hashes)
        valid = part.valid()
        often = np.flatnonzero(2 * part.pages >= max(2, part.n))
        known = part.found[valid] if part.n >= PAGES else part.found[:0]
        data = np.append(0, np.cumsum(~np.isin(part.words, known)))
        of_block = data[part.bounds[1:]] - data[part.bounds[:-1]]
        total, spans = [0, 0], [set(), set()]
        for b, n in zip(part.blocks, of_block.tolist(), strict=True):
            if n and not b.aside and 2 * b.linked < sum(map(len, b.pieces)):
                for k in range(1 + (b.article or b.main)):
                    total[k] += n
                    spans[k].add(b.path + "/")
        size = len(often)
        host = table["host"][0].as_py()
        columns = {"host": [host] * (size + 1), "token": [*part.found[often].view(np.int64).tolist(), None], "signature": [*part.signature[often].view(np.int64).tolist(), None], "pages": [*part.pages[often].tolist(), part.n], "valid": [*valid[often].tolist(), None]}
        for name, value in zip(("all", "hinted", "low", "high", "low_hinted", "high_hinted"), (*total, *(f(x) if x else None for x in spans for f in (min, max))), strict=True):
            columns[name] = [None] * size + [value]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(columns.items(), kinds, strict=True)})

    told = written(dealt.groupBy("host", "part").applyInArrow(found, FOUND), "tokens")
    hosts = told.where("token IS NULL").groupBy("host").agg(F.sum("pages").alias("n"), F.sum("all").alias("all"), F.sum("hinted").alias("hinted"), *[f(c).alias(c) for f, c in ((F.min, "low"), (F.max, "high"), (F.min, "low_hinted"), (F.max, "high_hinted"))])
    tokens = told.where("token IS NOT NULL").groupBy("host", "token").agg(F.bit_xor("signature").alias("signature"), F.sum("pages").alias("pages"), F.bool_and("valid").alias("valid"))
    tokens = tokens.join(hosts.select("host", "n"), "host").where((F.col("n") >= PAGES) & F.col("valid") & (F.col("pages") >= FREQUENT * F.col("n")))
    classes = tokens.groupBy("host", "signature").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= LARGE)
    known = classes.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("known"))
    place = F.struct(F.when(2 * F.col("hinted") > F.col("all"), True).otherwise(False).alias("by"), "low", "high", "low_hinted", "high_hinted")
    out = hosts.select("host", place.alias("x")).join(known, "host", "left")
    by = F.col("x.by")
    return written(out.select("host", F.coalesce("known", F.array().cast("array<bigint>")).alias("known"), by.alias("hinted"), F.when(by, F.col("x.low_hinted")).otherwise(F.col("x.low")).alias("low"), F.when(by, F.col("x.high_hinted")).otherwise(F.col("x.high")).alias("high")), "templates")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", slots: bool = False) -> DataFrame:
    """``key``, ``url`` and ``text`` of every page, and with ``slots`` the path and text of each slot."""
    kind = pages.schema[key].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    templates = deduce(rows.select("host", F.xxhash64("html").alias("h"), "html"))
    size = templates.agg(F.count("*").alias("n"), F.sum(60 + 8 * F.size("known")).alias("bytes")).first()
    few = size.n <= BROADCAST_HOSTS and (size.bytes or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(templates) if few else templates, "host", "left").drop("host")
    schema = f"key {kind}, url string, text string" + ", slots array<struct<path: string, text: string>>" * slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "html"):
            columns = [part.column(c).to_pylist() for c in ("html", "hinted", "low", "high")]
            known = part.column("known")
            found = []
            for i, (page, hinted, low, high) in enumerate(zip(*columns, strict=True)):
                tokens = np.array(known[i].as_py() or (), np.int64).view(np.uint64) if slots or not hinted else np.zeros(0, np.uint64)
                found.append(extract_page(page, tokens, _lowest(low, high) if low else "", bool(hinted)))
            out = [part.column("key"), part.column("url"), pa.array([t for t, _ in found], pa.string())]
            if slots:
                out.append(pa.array([[{"path": p, "text": t} for p, t in s] for _, s in found], pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))))
            yield pa.RecordBatch.from_arrays(out, ["key", "url", "text", "slots"][: len(out)])

    return joined.mapInArrow(run, schema).withColumnsRenamed({"key": key, "url": url})
