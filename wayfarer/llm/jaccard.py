"""N-gram Jaccard join with a token-group matrix.

Documents become sets of hashed word shingles; equal sets are one class.
Two sets link if 100 * |A and B| >= percent * |A or B|.  The result is the
components only: the links and their number are not returned, and most pairs
inside a component are never compared.

The token-group matrix has a row of bits for every set: tokens are put into
groups by their hash, four times as many groups as the set has tokens, and a
bit tells that the set holds a token of the group.  Each bit of A that B lacks
is a token that they don't share, so |A| less these bits bounds the overlap of
A with B, and with every member of a group whose rows were put together (OR).

1. A fixed order of tokens (``common`` ones last, then by hash) gives each set
   a prefix of |A| - ceil(t|A|) + 1 tokens; two sets that link share a token of
   their prefixes.  Which tokens count as common changes the work only, never
   the links: they are those most frequent within tasks, at most ``COMMON`` of
   them, and their list is what is broadcast.
2. Sets that share a prefix token are held against the smallest set of that
   token's list and the one with the most common tokens; pairs within the bound
   are compared token by token, and those that link partition the sets into
   groups (components).
3. Sets without a link are grouped by a token that many of them share.  Each
   group stores the union of its rows, in parts of members of like size: of at
   most about ``PART`` near copies, or ``LONE`` sets without a link, whose union
   would else hold a bit of every token group.  Sets that share a prefix token with a part query it, and
   only the parts whose bound reaches ceil(t|Q|) are opened: their members are
   held against the query by their own rows, then token by token.  The first
   such part of a group is opened first, the others only if it holds no link.

Sets of a group are never compared pair by pair among themselves, as they are
connected already; every pair of different groups that can link is decided, so
the components are exact.

Edge cases: null and empty texts have no shingles and stand alone; a text of
fewer words than a shingle has one shingle, the whole sequence; repeated rows
and equal sets are one class; a null key belongs to its class but names none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm._shared import bucketed, small, written
from wayfarer.llm._text import SPACED, blocks, hashed_words, mix, run_hashes
from wayfarer.llm.components import components

#: Tokens that are put last in the order: at most COMMON of them, which tasks have met so often.
#: A task counts a token of the LOW part of the hash range, where most prefixes lie, from the second set on.
COMMON, OFTEN, LOW = 1 << 20, 6, 1 << 61
#: Members in a part of a group: of linked sets, and of others; sizes in a part differ by this factor at most.
PART, LONE, STEP = 32, 4, 1.12
#: Bytes of text that become shingles together.
BLOCK = 500_000
_TOP = np.uint64(1) << np.uint64(63)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (63 bits) of each text."""
    words, bounds = hashed_words(column, SPACED)
    runs = run_hashes(words, k) >> np.uint64(1)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(run_hashes(words[a:b], b - a) >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(tokens: np.ndarray) -> int:
    """64 bits of a set, whatever the order of its tokens."""
    return int(mix(mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(tokens)))[0].astype(np.int64))


def _least(n: np.ndarray | int, percent: int):
    """The smallest overlap with which a set of n tokens can link: ceil(percent * n / 100)."""
    return -(-n * percent // 100)


def _links(both, n, m, percent: int):
    return 100 * both >= percent * (n + m - both)


def _ordered(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Tokens in the order of prefixes: the top bit set on common ones."""
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        tokens = np.sort(np.where(common[at] == tokens, tokens | _TOP, tokens))
    return tokens


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``key`` (long), ``n_shingles`` and ``component_id`` (smallest key reachable by links) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (its matrix row once a task), and one for each token that the task met often."""
        met, held, size = set(), [], 0

        def often() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            many = (n > 1) & ((tokens < LOW) | (n >= OFTEN))
            none = pa.nulls(int(many.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(n[many]), none, pa.nulls(len(none), pa.binary()), pa.array(tokens[many].astype(np.int64))], ["key", "n", "sig", "bits", "token"]).append_column("h", none)

        for part in blocks(batches, "text", BLOCK):
            found = shingle_sets(part.column("text"), k)
            sigs, bits = [], []
            for x in found:
                sig = _signature(x) if len(x) else None
                new = sig is not None and sig not in met
                if new:
                    met.add(sig)
                    held.append(x)
                    size += len(x)
                sigs.append(sig)
                bits.append(_bits(x).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(x) for x in found], pa.int64()), pa.array(sigs, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(len(found), pa.int64()), part.column("h")], ["key", "n", "sig", "bits", "token", "h"])
            if size > 4_000_000:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    both = written(rows.mapInArrow(sets, "key bigint, n bigint, sig bigint, bits binary, token bigint, h bigint"), "sets")
    seen = both.where("token IS NULL").select("key", F.col("n").cast("int").alias("n"), "sig", "h")
    classes = written(seen.where("n > 0").groupBy("n", "sig").agg(F.min("key").alias("class"), F.min("h").alias("h")), "classes")
    matrix = both.where("bits IS NOT NULL").select("sig", F.col("n").cast("int").alias("n"), "bits")
    common = both.where("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(COMMON)
    last = spark.sparkContext.broadcast(np.sort(common.select("token").toArrow()["token"].to_numpy().astype(np.uint64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for part in blocks(batches, "text", BLOCK):
            tokens, sigs, sizes, shared = [], [], [], []
            for x in shingle_sets(part.column("text"), k):
                n = len(x)
                if not n or (s := _signature(x)) in met:
                    continue
                met.add(s)
                ordered = _ordered(x, last.value)
                tokens.append(ordered[: n - _least(n, percent) + 1])
                shared.append(n - int(np.searchsorted(ordered, _TOP)))
                sigs.append(s)
                sizes.append(n)
            if tokens:
                lengths = [len(x) for x in tokens]
                # both counts in one number: what travels is a row for each token
                counts = (np.array(shared, np.int64) << 32) | np.array(sizes, np.int64)
                yield pa.RecordBatch.from_pydict({"token": np.concatenate(tokens).view(np.int64), "sig": np.repeat(np.array(sigs, np.int64), lengths), "counts": np.repeat(counts, lengths)})

    posted = rows.mapInArrow(prefixes, "token bigint, sig bigint, counts bigint")
    n = "cast(counts & 4294967295 AS int)"
    # of many copies with changes the one with the most common tokens has the fewest changes of its own
    ends = (("middle", "max(struct(counts, sig))"), ("head", f"min(struct({n} AS n, sig))"), ("tail", f"max(struct({n} AS n, sig))"), ("sets", "count(*)"))
    # dealt before the ends are put together, so that they don't travel
    lists = posted.repartition("token").select("*", *[F.expr(f"{x} OVER (PARTITION BY token) AS {name}") for name, x in ends])
    middle = F.struct(F.expr("cast(middle.counts & 4294967295 AS int)").alias("n"), "middle.sig")
    lists = written(lists.where("head <> tail").select("token", "sig", F.expr(n).alias("n"), middle.alias("middle"), "head", "sets").distinct(), "postings")

    involved = lists.select("sig", "n").distinct()
    matrix = bucketed(matrix.join(involved, ["sig", "n"], "left_semi").dropDuplicates(["sig", "n"]), "matrix", "sig", "n")
    # sizes rule out most pairs before any row of the matrix travels
    close = (F.col("n") * percent <= F.col("m") * 100) & (F.col("m") * percent <= F.col("n") * 100)
    ends = lists.select("sig", "n", F.explode(F.array("middle", "head")).alias("end"))
    stars = ends.select("sig", "n", F.col("end.sig").alias("to"), F.col("end.n").alias("m")).where("sig <> to").where(close).distinct()
    linked = compared(rows, classes, within_bound(stars, matrix, percent), k, percent)
    groups = components(linked.select(F.col("sig").alias("a"), F.col("to").alias("b")))
    # sets without a link are grouped by the token of their prefix that most sets have
    lead = lists.groupBy("sig", "n").agg(F.max_by("token", F.struct("sets", "token")).alias("lead"))
    grouped = lead.join(groups, F.col("sig") == F.col("node"), "left").select("sig", "n", F.coalesce("component", "lead").alias("grp"), F.col("component").isNotNull().alias("linked"))
    grouped = written(grouped, "groups")
    links = linked.unionByName(across_groups(rows, classes, lists, grouped, matrix, k, percent))
    named = classes.select("n", "sig", "class")
    edges = links.join(named.select(F.col("n"), "sig", F.col("class").alias("a")), ["n", "sig"]).join(named.select(F.col("n").alias("m"), F.col("sig").alias("to"), F.col("class").alias("b")), ["m", "to"])
    whole = components(edges.select("a", "b"))
    out = seen.drop("h").join(classes.drop("h"), ["n", "sig"], "left").join(whole, F.col("class") == F.col("node"), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "class", "key").alias("component_id"))


def _bits(tokens: np.ndarray) -> np.ndarray:
    """A row of the matrix: a bit for each of at least four times as many groups as there are tokens."""
    groups = 1 << max(6, (4 * len(tokens) - 1).bit_length())
    bits = np.zeros(groups, bool)
    bits[tokens & np.uint64(groups - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The row with fewer groups."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _bound(a: np.ndarray, n: int, b: np.ndarray) -> int:
    """The most tokens of the set with row ``a`` and size ``n`` that a set, or any set of a union, with row ``b`` can hold."""
    words = min(len(a), len(b))
    return n - int(np.bitwise_count(_folded(a, words) & ~_folded(b, words)).sum())


def _filter(held: DataFrame, columns: list[str], percent: int, test) -> DataFrame:
    """The rows of ``held`` whose binary columns ``a`` and ``b`` (rows of the matrix) pass the test."""
    kept = held.select(*columns, "a", "b")
    schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes = [part.column(c).to_pylist() for c in ("n", "m") if c in part.schema.names]
            good = [i for i, (a, b, *n) in enumerate(zip(part.column("a"), part.column("b"), *sizes, strict=True)) if test(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), *n)]
            yield part.select(columns).take(pa.array(good, pa.int64()))

    return kept.mapInArrow(run, schema)


def within_bound(pairs: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (sig, n, to, m) those that can link by their rows of the matrix.

    One row of each pair travels, with half its groups: enough to tell a set from another, if not from a union.
    """
    asked = matrix.withColumnRenamed("bits", "a").join(pairs, ["sig", "n"]).select("sig", "n", "to", "m", "a")

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = (np.frombuffer(a.as_buffer(), np.uint64) for a in part.column("a"))
            halves = pa.array([_folded(a, max(1, len(a) // 2)).tobytes() for a in rows], pa.binary())
            yield part.set_column(part.schema.get_field_index("a"), "a", halves)

    other = matrix.select(F.col("sig").alias("to"), F.col("n").alias("m"), F.col("bits").alias("b"))
    held = asked.mapInArrow(half, asked.schema).join(other, ["to", "m"])
    return _filter(held, ["sig", "n", "to", "m"], percent, lambda a, b, n, m: _links(min(_bound(a, n, b), _bound(b, m, a)), n, m, percent))


def compared(rows: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (sig, n, to, m) those that link, by their whole sets, made again from one text of each set."""
    spark = rows.sparkSession
    pairs = written(pairs, "pairs")
    wanted = pairs.select("sig", "n").unionByName(pairs.select(F.col("to").alias("sig"), F.col("m").alias("n"))).distinct()
    wanted = classes.join(wanted, ["sig", "n"], "left_semi").select("sig", "n", "h")
    mask = spark.sparkContext.broadcast(_bloom(wanted.select("h")))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for part in blocks((b.filter(pa.array(_maybe(mask.value, b.column("h").to_numpy(zero_copy_only=False)))) for b in batches), "text", BLOCK):
            sigs, held = [], []
            for x in shingle_sets(part.column("text"), k):
                if len(x) and (s := _signature(x)) not in met:
                    met.add(s)
                    sigs.append(s)
                    held.append(x.tobytes())
            yield pa.RecordBatch.from_pydict({"sig": pa.array(sigs, pa.int64()), "n": pa.array([len(x) // 8 for x in held], pa.int32()), "tokens": pa.array(held, pa.binary())})

    sets = rows.select("text", "h").mapInArrow(tokens_of, "sig bigint, n int, tokens binary").join(wanted.select("sig", "n"), ["sig", "n"], "left_semi").dropDuplicates(["sig", "n"])
    sets = bucketed(sets, "members", "sig", "n")
    held = pairs.join(sets.withColumnRenamed("tokens", "a"), ["sig", "n"]).join(sets.select(F.col("sig").alias("to"), F.col("n").alias("m"), F.col("tokens").alias("b")), ["to", "m"])
    return written(_filter(held, ["sig", "n", "to", "m"], percent, lambda a, b, n, m: _links(_overlap(a, b), n, m, percent)), "links")


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def _bloom(hashes: DataFrame, bits: int = 1 << 24) -> np.ndarray:
    """A filter of fixed size over the hashes ``h``; what it lets through in error is joined away later."""
    word = F.shiftright(F.col("h").bitwiseAND(bits - 1), 6)
    # the low bits of a hash choose the bit
    found = hashes.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return table


def _maybe(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.astype(np.int64) & (len(table) * 64 - 1)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def across_groups(rows: DataFrame, classes: DataFrame, lists: DataFrame, grouped: DataFrame, matrix: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (sig, n, to, m) between sets that share a prefix token and no component: of a set and a component, one at least if there is one."""
    group, cell = ["grp", "linked"], ["grp", "linked", "step", "part"]
    stepped = grouped.withColumn("step", F.floor(F.log(F.col("n")) / float(np.log(STEP))).cast("int"))
    inside = stepped.groupBy(*group, "step").agg(F.count("*").alias("inside"))
    sizes = inside.groupBy(*group).agg(F.sum("inside").alias("size"))
    most = F.when(F.col("linked"), PART).otherwise(LONE)
    parts = stepped.join(inside.join(sizes, group), [*group, "step"]).withColumn("part", F.pmod(F.xxhash64("sig", "n"), F.ceil(F.col("inside") / most))).drop("inside")
    ranges = parts.groupBy(*cell).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    parts = written(parts.join(ranges, cell), "parts")
    # a token all of whose sets lie in one part, or in one component, leads nowhere else
    placed = lists.select("token", "sig", "n").join(parts, ["sig", "n"]).repartition("token").withColumn("where", F.struct(*group, F.when(~F.col("linked"), F.struct("step", "part")).alias("place")))
    ends = [F.expr(f"{x}(where) OVER (PARTITION BY token) AS {x}_where") for x in ("min", "max")]
    posted = written(placed.select("*", *ends).where("min_where <> max_where").drop("where", "min_where", "max_where"), "elsewhere")
    fits = (F.col("n") * percent <= F.col("high") * 100) & (F.col("low") * percent <= F.col("n") * 100)
    # a set asks the parts that come after its own; inside a part without links its members are held against each other
    here = posted.select("token", "sig", "n", F.struct("linked", "size", "grp").alias("whole"), F.struct("step", "part").alias("place"))
    lone = posted.where("NOT linked").select("token", *cell, "low", "high", F.struct("linked", "size", "grp").alias("their"), F.struct("step", "part").alias("theirs")).distinct()
    later = ~F.col("whole.linked") & ((F.col("whole") < F.col("their")) | ((F.col("whole") == F.col("their")) & (F.col("place") < F.col("theirs"))))
    to_lone = here.join(lone, "token").where(later & fits).select("sig", "n", *cell)
    # nearly every part of a component holds the tokens that its members share: sets find the component by them, then all its parts of their size
    held_by = posted.where("linked").groupBy("token", *group, "step", "size").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    asked = here.join(held_by.withColumn("their", F.struct("linked", "size", "grp")), "token").where((F.col("whole") < F.col("their")) & fits)
    spans = parts.where("linked").select(*cell, "low", "high").distinct()
    to_linked = asked.select("sig", "n", *group, "step").distinct().join(spans, [*group, "step"]).where(fits).select("sig", "n", *cell)
    asks = written(to_lone.unionByName(to_linked).distinct(), "asks")

    cells = parts.select("sig", "n", *cell).join(matrix, ["sig", "n"])
    member = pa.list_(pa.struct([("to", pa.int64()), ("m", pa.int32()), ("bits", pa.binary())]))
    pair = pa.list_(pa.struct([("sig", pa.int64()), ("n", pa.int32()), ("to", pa.int64()), ("m", pa.int32())]))

    def union(table: pa.Table) -> pa.Table:
        held = [np.frombuffer(t.as_buffer(), np.uint64) for t in table["bits"]]
        words = min(map(len, held))
        whole = np.bitwise_or.reduce([_folded(x, words) for x in held])
        members = [dict(zip(("to", "m", "bits"), x, strict=True)) for x in zip(*(table[c].to_pylist() for c in ("sig", "n", "bits")), strict=True)]
        within = []
        for i, x in enumerate(members if not table["linked"][0].as_py() else ()):
            near = _possible(held[i], x["m"], members[i + 1 :], percent)
            within += [{"sig": x["to"], "n": x["m"], "to": y["to"], "m": y["m"]} for y in near]
        return pa.table({**{c: table[c][:1] for c in cell}, "b": pa.array([whole.tobytes()], pa.binary()), "members": pa.array([members], member), "within": pa.array([within], pair)})

    stored = bucketed(cells.groupBy(*cell).applyInArrow(union, "grp bigint, linked boolean, step int, part bigint, b binary, members array<struct<to: bigint, m: int, bits: binary>>, within array<struct<sig: bigint, n: int, to: bigint, m: int>>"), "unions", *cell)
    bounds = matrix.withColumnRenamed("bits", "a").join(small(asks), ["sig", "n"]).join(stored.drop("members", "within"), cell)
    reached = written(_filter(bounds, ["sig", "n", *cell], percent, lambda a, b, n: _bound(a, n, b) >= _least(n, percent)), "reached")

    def opened(asked: DataFrame) -> DataFrame:
        held = matrix.join(small(asked), ["sig", "n"]).join(stored.drop("b", "within"), cell).select("sig", "n", "bits", "members")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for sig, n, bits, members in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                    near = [x for x in members if n * percent <= x["m"] * 100 and x["m"] * percent <= n * 100]
                    good += [(sig, n, x["to"], x["m"]) for x in _possible(np.frombuffer(bits, np.uint64), n, near, percent)]
                yield pa.RecordBatch.from_pydict({c: pa.array([g[i] for g in good], kind) for i, (c, kind) in enumerate((("sig", pa.int64()), ("n", pa.int32()), ("to", pa.int64()), ("m", pa.int32())))})

        return held.mapInArrow(run, "sig bigint, n int, to bigint, m int")

    # parts of one component give the same answer: the first is opened first
    begun = reached.where("linked").groupBy("sig", "n", "grp").agg(F.min(F.struct("step", "part")).alias("first"))
    tried = reached.join(begun, ["sig", "n", "grp"], "left").withColumn("now", F.coalesce(~F.col("linked") | (F.struct("step", "part") == F.col("first")), F.lit(True)))
    within = stored.select(F.explode("within").alias("pair")).select("pair.*")
    first = compared(rows, classes, opened(written(tried.where("now").select("sig", "n", *cell), "now")).unionByName(within), k, percent)
    found = first.join(parts.where("linked").select(F.col("sig").alias("to"), F.col("n").alias("m"), "grp"), ["to", "m"]).select("sig", "n", "grp").distinct()
    rest = written(tried.where("NOT now").select("sig", "n", *cell).join(found, ["sig", "n", "grp"], "left_anti"), "rest")
    return first if rest.isEmpty() else first.unionByName(compared(rows, classes, opened(rest), k, percent))


def _possible(a: np.ndarray, n: int, members: list[dict], percent: int) -> list[dict]:
    """The members that can link with the set by their rows, a width of rows at a time."""
    out = []
    for width in {len(x["bits"]) for x in members}:
        same = [x for x in members if len(x["bits"]) == width]
        rows = np.stack([np.frombuffer(x["bits"], np.uint64) for x in same])
        words = min(len(a), rows.shape[1])
        folded = np.bitwise_or.reduce(rows.reshape(len(same), -1, words), axis=1)
        own = _folded(a, words)
        m = np.array([x["m"] for x in same])
        both = np.minimum(n - np.bitwise_count(own & ~folded).sum(axis=1, dtype=np.int64), m - np.bitwise_count(folded & ~own).sum(axis=1, dtype=np.int64))
        out += [same[i] for i in np.flatnonzero(_links(both, n, m, percent))]
    return out
