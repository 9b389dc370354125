"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns each block of documents into one row: the sorted word
hashes of the block, and for each the positions where it stands, so the index
is spread over the cluster by document.  ``search`` takes the windows of a
block of benchmark items to every index row.  In a row the windows whose words
are all there start from the postings of their rarest word, shifted by its
place in the window; what the shifted postings of the next rarest word lack is
dropped, until all words have agreed (exact phrases), or until too few words
stand within ``slop`` of their place (proximity matches).

The index is stored, with the postings of all words.  Items are cut into pieces
of ``PIECE`` windows, which share the words of a window with their neighbours;
repeated pieces of an item count once.  Benchmarks of any size are searched in
blocks of pieces of about ``QUERY_BYTES`` of word hashes: what is broadcast is
bounded by that, and the stored index is read once a block.

Words are hashed to 64 bits by a fixed function; A-Z are lower-cased first.

Edge cases: a null or empty text has no words, and so no matches; an item
without words has no window; an item of fewer than ``window`` words is one
window; an item whose id is null matches but is not named; rows that repeat
are matched each; documents may be longer than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm._shared import written
from wayfarer.llm._text import ALNUM, blocks, hashed_words

#: Bytes of the word hashes of a benchmark that are broadcast at once.
QUERY_BYTES = 4_000_000
#: Windows in a piece of an item.
PIECE = 2_000
#: Empty places around a row's words; larger than a window with its slop.
FRAME = 1 << 10
#: Postings that proximity matches start from at once.
CANDIDATES = 1_000_000

INDEX = "part bigint, docs array<string>, bounds binary, terms binary, begins binary, places binary"
MATCHES = "doc string, n_words bigint, part bigint, row bigint, exact array<struct<item: string, start: int, stop: int>>, near array<struct<item: string, start: int, stop: int>>"


def build_index(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per block of documents: their keys (as strings), where each one's words begin, and the postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            words, bounds = hashed_words(part.column("text"), ALNUM)
            order = np.argsort(words, kind="stable")
            terms, begins = np.unique(words[order], return_index=True)
            row = {
                "part": [0],
                "docs": [part.column("doc").to_pylist()],
                "bounds": [bounds.astype(np.int64).tobytes()],
                "terms": [terms.tobytes()],
                "begins": [np.append(begins, len(words)).astype(np.int64).tobytes()],
                "places": [order.astype(np.uint32).tobytes()],
            }
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("docs", pa.list_(pa.string())), *((x, pa.binary()) for x in ("bounds", "terms", "begins", "places"))]))

    return docs.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text")).mapInArrow(run, INDEX)


def pieces_of(items: DataFrame, window: int) -> DataFrame:
    """Distinct pieces of the items (item, text): ``item`` and ``words``, the hashes of at most PIECE + window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text"):
            words, bounds = hashed_words(part.column("text"), ALNUM)
            at, held = [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                for s in range(a, max(a + 1, b - window + 1), PIECE) if b > a else ():
                    at.append(i)
                    held.append(words[s : min(b, s + PIECE + window - 1)].tobytes())
            yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(at, pa.int64())), pa.array(held, pa.binary())], ["item", "words"])

    return items.mapInArrow(run, "item string, words binary").distinct()


class Windows:
    """The windows of some pieces of items: their words end to end, and where each window starts and stops."""

    def __init__(self, items: list[str | None], pieces: list[bytes], window: int):
        self.items = items
        words = [np.frombuffer(x, np.uint64) for x in pieces]
        bounds = np.append(0, np.cumsum([len(x) for x in words])).astype(np.int64)
        self.vocabulary, self.word = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)
        starts, stops, owners = [], [], []
        for i in range(len(items)):
            a, b = int(bounds[i]), int(bounds[i + 1])
            for s in range(a, max(a + 1, b - window + 1)):
                starts.append(s)
                stops.append(min(s + window, b))
                owners.append(i)
        self.starts, self.stops, self.owners = (np.array(x, np.int64) for x in (starts, stops, owners))


class _Row:
    """An index row as the words of a block of queries see it."""

    def __init__(self, windows: Windows, terms: np.ndarray, begins: np.ndarray, places: np.ndarray, bounds: np.ndarray):
        at = np.minimum(np.searchsorted(terms, windows.vocabulary), len(terms) - 1)
        there = terms[at] == windows.vocabulary
        self.count = np.where(there, begins[at + 1] - begins[at], 0)
        self.begin = begins[at]
        self.places, self.bounds = places, bounds
        #: The postings by place: which query word stands there, -1 if none; framed, so that no shift leaves it.
        self.word = np.full(int(bounds[-1]) + 2 * FRAME, -1, np.int32)
        for_places = np.full(len(terms), -1, np.int32)
        for_places[at[there]] = np.flatnonzero(there)
        self.word[places.astype(np.int64) + FRAME] = np.repeat(for_places, np.diff(begins))

    def starts(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The postings of each word less its offset, and which word each comes from."""
        n = self.count[words]
        of = np.repeat(np.arange(len(words)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.places[np.repeat(self.begin[words], n) + within].astype(np.int64) - offsets[of], of

    def stands(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each word stands at its place."""
        return self.word[at + FRAME] == words

    def stands_near(self, words: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray, slop: int) -> np.ndarray:
        """Whether each word stands within ``slop`` of its place and in its document, from ``first`` to before ``end``."""
        found = self.word[at + FRAME] == words
        found &= (at >= first) & (at < end)
        for d in range(1, slop + 1):
            found |= (self.word[at + FRAME - d] == words) & (at - d >= first) & (at - d < end)
            found |= (self.word[at + FRAME + d] == words) & (at + d >= first) & (at + d < end)
        return found


def search_row(windows: Windows, terms: np.ndarray, begins: np.ndarray, places: np.ndarray, bounds: np.ndarray, slop: int, missing: int) -> tuple[dict, dict]:
    """The exact and the near matches of one index row: {document number: [(item, start, stop)]}."""
    exact: dict[int, list] = {}
    near: dict[int, list] = {}
    if not len(terms) or not len(windows.starts):
        return exact, near
    row = _Row(windows, terms, begins, places, bounds)
    absent = np.append(0, np.cumsum(row.count[windows.word] == 0))
    lacking = absent[windows.stops] - absent[windows.starts]
    sizes = windows.stops - windows.starts
    for size in np.unique(sizes).tolist():
        some = np.flatnonzero((sizes == size) & (lacking == 0))
        phrases = _phrases(windows, row, some, size)
        for w, start in zip(*phrases, strict=True):
            _add(exact, windows, w, start, size, bounds)
        may_miss = min(missing, size - 2)
        if slop and may_miss > 0:
            some = np.flatnonzero((sizes == size) & (lacking <= may_miss))
            for w, start in zip(*_proximities(windows, row, some, size, slop, may_miss, phrases), strict=True):
                if not any(item == windows.items[windows.owners[w]] and a <= start - bounds[d] and start + size - bounds[d] <= b for d in [int(np.searchsorted(bounds, start, "right")) - 1] for item, a, b in exact.get(d, ())):
                    _add(near, windows, w, start, size, bounds)
    return exact, near


def _by_rarity(windows: Windows, row: _Row, some: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its words from the rarest, and their offsets."""
    words = windows.word[windows.starts[some][:, None] + np.arange(size)]
    order = np.argsort(row.count[words], axis=1, kind="stable")
    return np.take_along_axis(words, order, axis=1), order


def _phrases(windows: Windows, row: _Row, some: np.ndarray, size: int) -> tuple[list, list]:
    words, offsets = _by_rarity(windows, row, some, size)
    start, of = row.starts(words[:, 0], offsets[:, 0]) if len(some) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    good = _inside(start, size, row.bounds)
    start, of = start[good], of[good]
    for r in range(1, size):
        good = row.stands(words[of, r], start + offsets[of, r])
        start, of = start[good], of[good]
    return some[of].tolist(), start.tolist()


def _proximities(windows: Windows, row: _Row, some: np.ndarray, size: int, slop: int, may_miss: int, phrases: tuple[list, list]) -> tuple[list, list]:
    """The windows and starts of all proximity matches, but where the same window is a phrase within ``slop``."""
    at, starts = [], []
    words, offsets = _by_rarity(windows, row, some, size)
    # so many windows at a time as start from about ``CANDIDATES`` postings: what is held at once is bounded
    load = np.cumsum(row.count[words[:, : may_miss + 1]].sum(axis=1))
    cuts = np.flatnonzero(np.diff(load // CANDIDATES)) + 1
    for some_words, some_offsets, numbers in zip(np.split(words, cuts), np.split(offsets, cuts), np.split(some, cuts), strict=True):
        for r in range(may_miss + 1 if len(numbers) else 0):  # one of these words must be near its place
            start, of = row.starts(some_words[:, r], some_offsets[:, r])
            # where it stands off its place by up to slop, the others stand within twice that
            start, of = _enough(row, some_words, some_offsets, start, of, 2 * slop, may_miss, False)
            start, of = (start[:, None] + np.arange(-slop, slop + 1)).reshape(-1), np.repeat(of, 2 * slop + 1)
            good = _inside(start, size, row.bounds)
            start, of = _enough(row, some_words, some_offsets, start[good], of[good], slop, may_miss, True)
            at.append(numbers[of])
            starts.append(start)
    if not at:
        return [], []
    wide = int(row.bounds[-1]) + 2 * FRAME
    keys = np.unique(np.concatenate(at) * wide + np.concatenate(starts) + FRAME)
    whole = np.array(phrases[0], np.int64) * wide + np.array(phrases[1], np.int64) + FRAME
    keys = keys[~np.isin(keys, (whole[:, None] + np.arange(-slop, slop + 1)).reshape(-1))]
    number, start = keys // wide, keys % wide - FRAME
    order = np.lexsort((start, windows.owners[number]))
    return number[order].tolist(), start[order].tolist()


def _enough(row: _Row, words: np.ndarray, offsets: np.ndarray, start: np.ndarray, of: np.ndarray, slop: int, may_miss: int, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Those of the starts where all words of the window but ``may_miss`` stand within ``slop`` of their place, and ``within`` its document."""
    if within:
        doc = np.searchsorted(row.bounds, start, "right")
        first, end = row.bounds[doc - 1], row.bounds[np.minimum(doc, len(row.bounds) - 1)]
    else:
        first, end = np.full(len(start), -FRAME), np.full(len(start), row.bounds[-1] + FRAME)
    misses = np.zeros(len(of), np.int64)
    for other in range(words.shape[1]):
        misses += ~row.stands_near(words[of, other], start + offsets[of, other], first, end, slop)
        good = misses <= may_miss
        start, of, misses, first, end = start[good], of[good], misses[good], first[good], end[good]
    return start, of


def _inside(starts: np.ndarray, size: int, bounds: np.ndarray) -> np.ndarray:
    """Which of them lie within one document."""
    good = (starts >= 0) & (starts + size <= bounds[-1])
    return good & (np.searchsorted(bounds, starts, "right") == np.searchsorted(bounds, starts + size - 1, "right"))


def _add(to: dict, windows: Windows, w: int, start: int, size: int, bounds: np.ndarray) -> None:
    doc = int(np.searchsorted(bounds, start, "right")) - 1
    item = windows.items[windows.owners[w]]
    start -= int(bounds[doc])
    spans = to.setdefault(doc, [])
    if spans and spans[-1][0] == item and spans[-1][1] <= start <= spans[-1][2]:
        spans[-1] = (item, spans[-1][1], max(spans[-1][2], start + size))
    else:
        spans.append((item, start, start + size))


def search(index: DataFrame, windows: Windows, slop: int = 0, missing: int = 2) -> DataFrame:
    """One row per document of the index: its words, and spans of exact and near matches (word numbers from 0)."""
    query = index.sparkSession.sparkContext.broadcast(windows)
    span = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    schema = pa.schema([("doc", pa.string()), ("n_words", pa.int64()), ("part", pa.int64()), ("row", pa.int64()), ("exact", span), ("near", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for row in part.to_pylist():
                bounds, terms, begins, places = (np.frombuffer(row[x], t) for x, t in (("bounds", np.int64), ("terms", np.uint64), ("begins", np.int64), ("places", np.uint32)))
                exact, near = search_row(query.value, terms, begins, places, bounds, slop, missing)
                docs = row["docs"]
                spans = [[[{"item": a, "start": b, "stop": c} for a, b, c in found.get(i, ())] for i in range(len(docs))] for found in (exact, near)]
                yield pa.RecordBatch.from_pydict({"doc": docs, "n_words": np.diff(bounds), "part": [row["part"]] * len(docs), "row": np.arange(len(docs)), "exact": spans[0], "near": spans[1]}, schema=schema)

    return index.mapInArrow(run, MATCHES)


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, slop: int = 0, missing: int = 2) -> DataFrame:
    """One row per document: ``doc`` (key as string), ``n_words``, ``exact``, ``near``, ``n_hit``, ``items``.

    ``n_hit`` counts the words inside exact matches, ``items`` names the items
    with exact matches, sorted as strings.  With ``slop`` > 0, ``near`` holds
    windows of which all words but ``missing`` stand within ``slop`` words of
    their place, unless they lie inside an exact match of their item or the same
    window matches exactly within ``slop`` words.
    """
    pieces = written(pieces_of(items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text")), window), "pieces")
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // QUERY_BYTES))

    def block(i: int) -> Windows:
        rows = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == i).collect()
        return Windows([r.item for r in rows], [bytes(r.words) for r in rows], window)

    index = written(build_index(docs, key, text).withColumn("part", F.monotonically_increasing_id()), "postings")
    searched = [search(index, block(i), slop, missing) for i in range(n_blocks)]
    found = searched[0]
    if n_blocks > 1:
        for more in searched[1:]:
            found = found.unionByName(more)
        found = found.groupBy("part", "row").agg(F.first("doc").alias("doc"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("exact")).alias("exact"), F.flatten(F.collect_list("near")).alias("near"))
    ends = F.array_sort(F.transform("exact", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))))
    covered = F.aggregate(
        ends,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda so_far, x: F.struct(
            (so_far["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], so_far["reach"]))).alias("n"),
            F.greatest(so_far["reach"], x["stop"]).alias("reach"),
        ),
        lambda last: last["n"].cast("long"),
    )
    named = F.array_sort(F.array_distinct(F.filter(F.transform("exact", lambda x: x["item"]), lambda x: x.isNotNull())))
    return found.select("doc", "n_words", "exact", "near", covered.alias("n_hit"), named.alias("items"))
