"""Substring joins over n-grams: what is asked meets only the texts that hold a rare piece of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the run that a needle asks for (the most that it has), and needles that every task may hold at most.
RUNS, BROADCAST_ROWS = (16, 8), 400_000
#: Bits of a ``Sieve``, at most and for each number; letters of texts that are passed through it together.
BITS, PER_NUMBER, TOGETHER = 1 << 28, 24, 1 << 19
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_PROBES, _SIZED = (_SPREAD, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD), 0x165667B19E3779F9
_HEAD = 1 << 40


def grams(x: Column, size: int) -> Column:
    """All runs of ``size`` letters of a text, in order; none in a shorter one."""
    return F.coalesce(F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{size}}}))"), 1), F.array().cast("array<string>"))


def _hashes(code: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` letters: of its halves, which double."""
    out, done, width, part = None, 0, 1, code
    while done < size:
        if size & width:
            here = part[done : done + len(code) - size + 1]
            out = here if out is None else out + here * np.uint64(pow(_BASE, done, 1 << 64))
            done += width
        if done < size:
            part = part[:-width] + part[width:] * np.uint64(pow(_BASE, width, 1 << 64))
            width *= 2
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class _Held:
    """Needles of one length of run, by the run's number."""

    def __init__(self, size: int, pairs: list[tuple[str, str]]):
        self.size, self.by = size, {}
        numbers = _hashes(_codes("".join(g for _, g in pairs)), size)[::size]
        for number, (needle, gram) in zip(numbers.tolist(), pairs, strict=True):
            self.by.setdefault(number, []).append((needle, needle.index(gram)))
        # a table of bits, of which few are set
        self.shift = np.uint64(64 - max(12, (16 * len(self.by)).bit_length()))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[self._slots(numbers)] = True

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers * np.uint64(_SPREAD)) >> self.shift

    def found(self, text: str, code: np.ndarray) -> Iterator[str]:
        """Each needle that stands in the text, once."""
        if len(code) < self.size:
            return
        numbers = _hashes(code, self.size)
        at = np.flatnonzero(self.bits[self._slots(numbers)])
        open_, by = {}, self.by
        for number, p in zip(numbers[at].tolist(), at.tolist(), strict=True):
            left = open_.get(number)
            if left is None:
                left = open_[number] = list(by.get(number, ()))
            for one in list(left):
                if p >= one[1] and text.startswith(one[0], p - one[1]):
                    left.remove(one)
                    yield one[0]


def containing(texts: DataFrame, key: list[str], text: str, needles: DataFrame, needle: str) -> DataFrame:
    """``key`` and ``needle`` wherever the text contains the needle; empty needles are in no text.

    A needle asks for one of its runs of ``RUNS`` letters, the one that fewest
    needles share, or for itself if it is shorter; a text is searched for it only
    where this run stands.  Needles that are few enough go to all tasks, and each
    text is passed once.  Of more, only a ``Sieve`` goes to all tasks: what passes it
    in a text is joined to the needles.
    """
    asked = needles.select(needle).where(F.length(needle) > 0).distinct()
    if asked.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _sieved(texts, key, text, asked, needle)
    own = F.array(needle)
    for n in RUNS[::-1]:
        own = F.when(F.length(needle) >= n, F.array_distinct(grams(F.col(needle), n))).otherwise(own)
    pieces = asked.select(needle, F.explode(own).alias("gram"))
    shared = pieces.groupBy("gram").agg(F.count("*").alias("_n"))
    wanted = pieces.join(shared, "gram").groupBy(needle).agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"))
    return _passed(texts, key, text, [(r[0], r[1]) for r in wanted.select(needle, "gram").collect()], needle)


def _passed(texts: DataFrame, key: list[str], text: str, pairs: list[tuple[str, str]], needle: str) -> DataFrame:
    """``containing`` by needles (each with its run) that every task holds."""
    whole = texts.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[tuple[str, str]]] = {}
        for pair in whole.value:
            by_size.setdefault(len(pair[1]), []).append(pair)
        every = [_Held(n, some) for n, some in by_size.items()]
        for b in batches:
            rows, met = [], []
            for r, value in enumerate(b[text].to_pylist()):
                if value:
                    code = _codes(value)
                    for held in every:
                        before = len(met)
                        met.extend(held.found(value, code))
                        rows += [r] * (len(met) - before)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b[k].take(at) for k in key], pa.array(met, pa.string())], [*key, needle])

    held = texts.select(*key, text)
    schema = held.select(*key).schema.add(needle, "string")
    return held.mapInArrow(run, schema)


class Sieve:
    """A table of bits that lets all asked strings pass, and of others about two in a thousand while ``BITS`` suffice.

    A string is asked for by the number of its letters, and with ``heads`` also by those of
    its first 8, 16, 32 letters and so on (of fewer than 8: its first 1, 2 or 4).
    """

    def __init__(self, table: bytes, sizes: list[int]):
        self.table, self.sizes, self.shift = np.frombuffer(table, np.uint8), sizes, _shift(8 * len(table))

    def passes(self, numbers: np.ndarray) -> np.ndarray:
        """The places of the numbers whose bits are all set."""
        left = np.arange(len(numbers))
        for by in _PROBES:
            slots = (numbers[left] * np.uint64(by)) >> self.shift
            left = left[(self.table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return left

    def whole(self, strings: list[str]) -> list[int]:
        """The places of the strings that pass."""
        ends = np.cumsum([len(x) for x in strings], dtype=np.int64)
        sizes = np.diff(ends, prepend=0)
        return self.passes(_Sums(_codes("".join(strings))).numbers(ends - sizes, sizes)).tolist() if strings else []

    def parts(self, texts: list[str]) -> Iterator[tuple[int, str]]:
        """Each part of a text that passes, once, with the place of its text."""
        joined = "".join(texts)
        ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        sums, found = _Sums(_codes(joined)), set()
        for start, most in ((1, 2), (2, 4), (4, 8), (8, 1 << 62)):
            sizes = [n for n in self.sizes if start <= n < most]
            at = np.arange(len(joined) if sizes else 0)
            size = start
            while sizes and len(at):
                at = at[at + size <= len(joined)]
                at = at[self.passes(sums.numbers(at, size, _HEAD))]
                end = ends[np.searchsorted(ends, at, "right")]
                for n in (n for n in sizes if n < 2 * size):
                    here = at[at + n <= end]
                    here = here[self.passes(sums.numbers(here, n))]
                    found.update(zip(np.searchsorted(ends, here, "right").tolist(), (joined[p : p + n] for p in here.tolist()), strict=True))
                size *= 2
                sizes = [n for n in sizes if n >= size]
        yield from sorted(found)


class _Sums:
    """Sums along some letters, from which the number of any part follows."""

    def __init__(self, code: np.ndarray):
        powers, self.undo = _powers(_BASE, len(code) + 1), _powers(pow(_BASE, -1, 1 << 64), len(code) + 1)
        self.sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * powers[:-1], out=self.sums[1:])

    def numbers(self, at: np.ndarray, size: np.ndarray | int, head: int = 0) -> np.ndarray:
        """Numbers of the parts of ``size`` letters at these places, the same wherever they stand; others for heads than for whole strings."""
        return (self.sums[at + size] - self.sums[at]) * self.undo[at] ^ (np.asarray(size + head).astype(np.uint64) * np.uint64(_SIZED))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def _shift(bits: int) -> np.uint64:
    return np.uint64(65 - bits.bit_length())


def sieve(strings: DataFrame, name: str, heads: bool) -> Callable[[], Sieve]:
    """What makes, in a task, the ``Sieve`` of the strings (not null, not empty).

    Tasks make the table in blocks; the driver passes it on, ``BITS`` bits at most.
    """
    sizes = sorted(r[0] for r in strings.select(F.length(name)).distinct().collect()) if heads else []
    levels = F.greatest(F.lit(0), F.floor(F.log2(F.length(name))).cast("int") - 2) + 1 if heads else F.lit(0)
    numbers = strings.agg(F.sum(levels + 1)).first()[0] or 0
    bits = min(BITS, 1 << max(16, (PER_NUMBER * numbers - 1).bit_length()))
    shift = _shift(bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[0].to_pylist()
            size = np.array([len(x) for x in texts], np.int64)
            at, sums = np.cumsum(size) - size, _Sums(_codes("".join(texts)))
            own = [sums.numbers(at, size)]
            for n in [1 << k for k in range(int(size.max(initial=0)).bit_length())] if heads else []:
                has = (size >= n) & ((n >= 8) | (size < 2 * n))
                own.append(sums.numbers(at[has], n, _HEAD))
            every = np.unique(np.concatenate([(x * np.uint64(by)) >> shift for x in own for by in _PROBES]))
            yield pa.RecordBatch.from_arrays([pa.array(every.astype(np.int32))], ["slot"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            slot = np.sort(b[0].to_numpy())
            which, first = np.unique(slot >> 16, return_index=True)
            for k, own in zip(which.tolist(), np.split(slot & 0xFFFF, first[1:]), strict=True):
                np.bitwise_or.at(made.setdefault(k, np.zeros(1 << 13, np.uint8)), own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.tobytes() for x in made.values()], pa.binary())], ["block", "bits"])

    dealt = strings.select(name).mapInArrow(slots, "slot int").repartition(F.shiftright("slot", 16))
    table = bytearray(bits >> 3)
    for r in dealt.mapInArrow(blocks, "block int, bits binary").toLocalIterator():
        table[r[0] << 13 : (r[0] + 1) << 13] = r[1]
    held = strings.sparkSession.sparkContext.broadcast(bytes(table))
    return lambda: Sieve(held.value, sizes)


def _sieved(texts: DataFrame, key: list[str], text: str, asked: DataFrame, needle: str) -> DataFrame:
    """``containing`` by needles (distinct, not empty) of any number."""
    made = sieve(asked, needle, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing = made()
        for b in batches:
            values = b[text].to_pylist()
            total = np.cumsum([len(x or "") for x in values])
            # texts are taken together, up to TOGETHER letters or one text
            for group in np.split(np.arange(len(values)), np.flatnonzero(np.diff(total // TOGETHER)) + 1):
                some = [(r, values[r]) for r in group.tolist() if values[r]]
                if found := list(passing.parts([x for _, x in some])):
                    at = pa.array([some[r][0] for r, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([*[b[k].take(at) for k in key], pa.array([x for _, x in found], pa.string())], [*key, needle])

    held = texts.select(*key, text)
    parts = held.mapInArrow(run, held.select(*key).schema.add(needle, "string"))
    return parts.join(asked, needle, "left_semi").select(*key, needle)
