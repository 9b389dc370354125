"""Language identification with bit-sliced Bloom filters.

``train`` counts the 4-byte grams of the labelled texts by language, over all
of them, and keeps for each language the grams that make up at least ``LEAST`` of
its grams (whatever the size of the corpus) and are not far more frequent in
another.  All languages share one Bloom filter that is
sliced by bit: each of its ``SLOTS`` places holds a mask with one bit for each
language, so that one look-up (the AND of ``HASHES`` masks) returns all
languages that contain a gram.  ``predict`` counts the bits of each language
over all grams of a whole text, takes from each count what the fill of that
language's slice leads one to expect by chance, and decides for the largest.

Texts are compared as lower-cased UTF-8 bytes in which every ASCII character
that is no letter is a space; grams across two spaces are left out, so runs of
symbols, digits and white space have no say.

Edge cases: a text that is null or has no letter is ``und`` with score 0; so is
every text where no label was learned.  A text with letters but without any
known gram gets the label that sorts first, with score 0.  Ties go to the label
that sorts first.  Rows with a null label or null text teach nothing.  The
model takes ``SLOTS`` bytes for each 8 languages, however much it learns from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.llm._text import blocks, mix, text_bytes

SLOTS = 1 << 20
HASHES = 3
#: A filter takes in the grams that make up this part of all grams of its language: 1 / LEAST of them at most.
LEAST = 2e-5
#: Bytes of text that a task looks at together.
PIECE = 300_000
#: A gram is a language's own if its share there is at least this part of its largest share.
OWN = 0.5

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_LETTER = regex.compile(r"\p{L}")


def _keys(padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte grams that have no two spaces in a row, as integers, and where they begin."""
    if len(padded) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    space = padded == 32
    twice = space[1:] & space[:-1]
    good = np.flatnonzero(~(twice[:-2] | twice[1:-1] | twice[2:]))
    wide = padded.astype(np.uint32)
    key = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    return key[good], good


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 4-byte grams of all texts as integers, and the text of each, in parts of about ``PIECE`` bytes at most."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    if len(data) > 2 * PIECE and n == 1:  # one long text: windows over its bytes, three shared by neighbours
        padded = np.concatenate([[32], _PLAIN[data], [32]]).astype(np.uint8)
        for start in range(0, len(padded) - 3, PIECE):
            key, _ = _keys(padded[start : start + PIECE + 3])
            yield key, np.zeros(len(key), np.int64)
        return
    text = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    padded[np.arange(len(data)) + 2 * text + 1] = _PLAIN[data]
    key, good = _keys(padded)
    yield key, np.searchsorted(offsets[1:] + 2 * np.arange(1, n + 1), good, "right")


def _slots(key: np.ndarray) -> list[np.ndarray]:
    h = mix(key.astype(np.uint64))
    return [((h >> np.uint64(20 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


class LanguageFilters:
    """The sliced filter: a table of ``SLOTS`` masks for each 8 languages."""

    def __init__(self, own: dict[str, np.ndarray]):
        self.labels = sorted(own)
        self.tables = [np.zeros(SLOTS, np.uint8) for _ in range(-(-len(self.labels) // 8))]
        for i, label in enumerate(self.labels):
            for slots in _slots(own[label].astype(np.uint32)):
                np.bitwise_or.at(self.tables[i // 8], slots, np.uint8(1 << (i % 8)))
        self.by_chance = np.array([np.count_nonzero(self.tables[i // 8] & (1 << (i % 8))) / SLOTS for i in range(len(self.labels))]) ** HASHES

    def hits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the count of its grams in each language, corrected for chance, and the number of its grams."""
        n = len(column)
        total = np.zeros(n)
        found = np.zeros((n, len(self.labels)))
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for key, text in grams(column):
            total += np.bincount(text, minlength=n)
            slots = _slots(key)
            for t, sliced in enumerate(self.tables):
                mask = sliced[slots[0]]
                for s in slots[1:]:
                    mask &= sliced[s]
                seen = np.bincount(text * 256 + mask, minlength=n * 256).reshape(n, 256)
                found[:, 8 * t : 8 * t + 8] += (seen @ bits)[:, : len(self.labels) - 8 * t]
        chance = self.by_chance
        return np.maximum(0, (found - total[:, None] * chance) / np.maximum(1e-9, 1 - chance)), total


def train(docs: DataFrame, label: str = "lang", text: str = "text") -> LanguageFilters:
    """Learn the filters from all rows of ``docs`` with a label and a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        for part in blocks(batches, "text", PIECE):
            names, of_text = np.unique(np.array(part.column("label").to_pylist(), np.str_), return_inverse=True)
            for key, of in grams(part.column("text")):
                for i, name in enumerate(names.tolist()):
                    parts = held.setdefault(name, [])
                    parts.append(np.unique(key[of_text[of] == i], return_counts=True))
                    if len(parts) > 15:
                        held[name] = [summed(parts)]
        for name, parts in held.items():
            keys, n = summed(parts)
            yield pa.RecordBatch.from_pydict({"label": pa.array([name]).take(pa.array(np.zeros(len(keys), np.int32))), "gram": keys.astype(np.int64), "n": n})

    rows = docs.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count, "label string, gram bigint, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    # a row for each language, of which the model holds a slice
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(totals), "label").withColumn("share", F.col("n") / F.col("total"))
    best = share.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("label", "share")).alias("of"))
    own = best.select("gram", "most", F.explode("of").alias("of")).where(F.col("of.share") >= OWN * F.col("most")).select("gram", "of.label", "of.share")
    chosen = own.where(F.col("share") >= LEAST).select("label", "gram").toPandas()
    return LanguageFilters({name: part.gram.to_numpy() for name, part in chosen.groupby("label")})


def predict(docs: DataFrame, filters: LanguageFilters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the part of all hits that the language has, above an even share.

    Score is 1 if only the language predicted was hit, and 0 if all were hit alike.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)
    kept = docs.drop("lang_pred", "score")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        n = len(known.labels)
        for part in blocks(batches, text, PIECE):
            column = part.column(text)
            lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in column.to_pylist()], bool)
            if n:
                hits, _ = known.hits(column)
                total = hits.sum(axis=1)
                share = hits.max(axis=1) / np.where(total > 0, total, 1)
                score = np.where(total > 0, (share - 1 / n) / (1 - 1 / n) if n > 1 else share, 0.0)
                names = np.where(lettered, np.array(known.labels, object)[hits.argmax(axis=1)], "und")
            else:
                score, names = np.zeros(len(column)), np.full(len(column), "und", object)
            score = np.where(names == "und", 0.0, np.clip(score, 0, 1))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names.tolist(), pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def held_out(key: Column, parts: int, which: int) -> Column:
    """Whether crc32 of the key as text leaves the remainder ``which`` (a null key counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == which
