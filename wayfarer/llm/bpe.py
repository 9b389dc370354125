"""Byte-level BPE by corpus-level merge replay.

``encode_batch`` splits every text by the pattern, gathers the distinct pieces
of the block of texts at hand, and replays the merges on all of them together:
an inverted index leads from the rank of an adjacent token pair to its
positions in the pieces; ranks are taken in ascending order from a heap, every
position of the rank is merged in one vectorised step, and only the pairs of
the touched neighbours are looked up again.  Texts are then mapped piece by
piece.  Nothing is shuffled: a piece's ids depend on the piece alone.

Edge cases: null is encoded as the empty text (no ids); a text of any length is
encoded whole; rows that repeat are encoded each; extra columns are untouched,
and result columns are written last, so that a clashing name is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wayfarer.llm._text import blocks

#: Bytes of text whose distinct pieces are replayed together.
REPLAYED_BYTES = 2_000_000
#: Pieces whose ids a worker remembers from block to block; when full it starts anew.
REMEMBERED = 80_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` vocabulary file (base64 token and rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """The merges of a vocabulary, ready to be replayed on many pieces at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte_ids = np.full(256, -1, np.int64)
        for b in range(256):
            self.byte_ids[b] = ranks.get(bytes([b]), -1)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.never = np.int64(np.iinfo(np.int64).max)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        if not len(self.keys):
            return np.full(len(key), self.never)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], self.never)

    def one(self, piece: bytes) -> list[int]:
        """One piece, merge by merge from the lowest rank and the left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], self.never), i) for i in range(len(parts) - 1))
            if rank == self.never:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece (none of them empty)."""
        out: list[list[int] | None] = [None] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is None:
                todo.append(i)
            else:
                out[i] = [whole]
        if not todo:
            return out
        lengths = np.array([len(pieces[i]) for i in todo])
        data = np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)
        n = len(data)
        ids = np.append(self.byte_ids[data], -1)
        owner = np.repeat(np.arange(len(todo), dtype=np.int32), lengths)
        following = np.arange(1, n + 2, dtype=np.int32)  # next position in the piece; n: none
        following[np.cumsum(lengths) - 1] = n
        following[n] = n
        before = np.arange(-1, n, dtype=np.int32)  # previous position in the piece; -1: none
        before[np.cumsum(lengths) - lengths] = -1
        before = np.append(before, -1)
        alive = np.ones(n + 1, bool)
        pair = np.append(np.full(n, self.never), self.never)
        has = np.flatnonzero(following[:n] < n)
        pair[has] = self._pair_ranks(ids[has], ids[following[has]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: set[int] = set()  # pieces that ask for a lower rank again: done one by one

        def post(positions: np.ndarray, found: np.ndarray) -> None:
            good = found < self.never
            positions, found = positions[good], found[good]
            if not len(found):
                return
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for r, p in zip(found[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(p)

        post(has, pair[has])
        while heap:
            rank = heapq.heappop(heap)
            posted = index.pop(rank)
            at = np.sort(np.concatenate(posted)) if len(posted) > 1 else posted[0]
            at = at[alive[at] & (pair[at] == rank)]
            if not len(at):
                continue
            if len(at) > 1:
                at = _leftmost(np.unique(at), following)
            gone = following[at]
            ids[at] = rank
            after = following[gone]
            following[at] = after
            inner = after < n
            before[after[inner]] = at[inner]
            alive[gone] = False
            pair[gone] = self.never
            left = before[at]
            pair[at] = self.never
            pair[at[inner]] = self._pair_ranks(ids[at[inner]], ids[after[inner]])
            led = left >= 0
            pair[left[led]] = self._pair_ranks(ids[left[led]], ids[at[led]])
            touched = np.unique(np.concatenate([at[inner], left[led]]))
            lower = touched[pair[touched] < rank]
            if len(lower):
                odd.update(owner[lower].tolist())
            post(touched, pair[touched])
        rest = np.flatnonzero(alive[:n])
        cuts = np.cumsum(np.bincount(owner[rest], minlength=len(todo)))[:-1]
        for k, got in enumerate(np.split(ids[rest], cuts)):
            out[todo[k]] = self.one(pieces[todo[k]]) if k in odd else got.tolist()
        return out


def _leftmost(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of positions in ascending order, those that a walk from the left merges: no two overlap."""
    linked = np.append(False, following[at[:-1]] == at[1:])
    if not linked.any():
        return at
    begins = np.flatnonzero(~linked)
    within = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    return at[within % 2 == 0]


def _sha256(of: list[bytes], row: Sequence[int], between: bytes) -> str:
    return hashlib.sha256(between.join(map(of.__getitem__, row))).hexdigest()


def _lists(coded: list[list[int]], rows: list[array]) -> pa.Array:
    flat = [array("i", chain.from_iterable(map(coded.__getitem__, row))) for row in rows]
    offsets = np.append(0, np.cumsum([len(x) for x in flat])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens`` and, as asked, ``token_ids`` (array<int>) and the digests of ids and decoded bytes.

    ``path`` names a ``.tiktoken`` file that the driver reads; its ranks (about
    a megabyte) are broadcast.  Input rows that share pieces share the work
    within a block.  ``decode`` gives the bytes back.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    made = ["n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    kept = docs.drop(*made)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_tokens bigint"] + ["token_ids array<int>"] * ids + ["ids_sha256 string, decoded_sha256 string"] * digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, split = MergeReplay(ranks.value), regex.compile(pattern).findall
        number: defaultdict[str, int] = defaultdict()  # of each piece met, in order of meeting
        number.default_factory = number.__len__
        coded: list[list[int]] = []
        shown: list[bytes] = []
        decoded: list[bytes] = []
        for part in blocks(batches, text, REPLAYED_BYTES):
            if len(number) > REMEMBERED:
                number.clear()
                del coded[:], shown[:], decoded[:]
            rows = [array("I", map(number.__getitem__, split(t.as_py() or ""))) for t in part.column(text)]
            met = [p.encode() for p in islice(number, len(coded), None)]
            got = replay.encode(met)
            coded += got
            if digests:
                decoded += [b"".join(map(replay.tokens.__getitem__, x)) for x in got]
                shown += [",".join(map(str, x)).encode() for x in got]
            columns = dict(zip(part.schema.names, part.columns, strict=True))
            counts = np.array([len(x) for x in coded])
            columns["n_tokens"] = pa.array([int(counts[row].sum()) for row in rows], pa.int64())
            if ids:
                columns["token_ids"] = _lists(coded, rows)
            if digests:
                columns["ids_sha256"] = pa.array([_sha256(shown, row, b",") for row in rows])
                columns["decoded_sha256"] = pa.array([_sha256(decoded, row, b"") for row in rows])
            yield pa.RecordBatch.from_pydict(columns)

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of the ids, end to end; null ids give empty bytes.

    An id outside the vocabulary fails the job: the bytes would be wrong.
    """
    spark = encoded.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    kept = encoded.drop("decoded")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {r: t for t, r in ranks.value.items()}
        for part in batches:
            got = [b"".join(tokens[i] for i in row or ()) for row in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], [*part.schema.names, "decoded"])

    return kept.mapInArrow(run, schema)
