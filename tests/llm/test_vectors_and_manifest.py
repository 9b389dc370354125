"""Hard negatives, the Merkle manifest and near-duplicate vectors against brute force, with their edge cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.llm import balltree, embdedup, merkle

VECTORS = "vec_id long, embedding array<double>, label int, size int, row string, v string, anchor long, links long"


def vectors(spark, rows):
    """Vectors with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, 1, "x", "y", 3, 4) for i, v, label in rows], VECTORS)


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# -- hard negatives


def brute_negatives(rows, is_anchor, scale=256.0):
    held = {}
    for i, v, label in rows:
        if i is not None and label is not None and sound(v):
            row = (str(label), [math.floor(scale * x) for x in v])
            held[i] = min(held.get(i, row), row)
    out = []
    for a, (label, q) in held.items():
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, (other, v) in held.items() if i != a and len(v) == len(q))
        for p, pid, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(-n, nid) for n, nid, other in scored if other != label and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(a, pid, rank + 1, nid, -p, n) for rank, (n, nid) in enumerate(fits[:5])]
    return sorted(out)


def found_negatives(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def odd_vectors(rng, n, size=6):
    """Clustered vectors with ties, copies, repeated rows, shared ids, and every kind of row that takes no part."""
    centers = rng.standard_normal((5, size))
    rows = [(i, np.round(centers[rng.integers(5)] + 0.3 * rng.standard_normal(size), 1).tolist(), int(rng.integers(3))) for i in range(n)]
    rows += [(n + i, rows[0][1], int(rng.integers(3))) for i in range(40)]
    rows += rows[:3] + [(5, rows[7][1], 2)]
    rows += [(None, rows[0][1], 1), (900, None, 1), (901, rows[0][1], None), (902, [None] * size, 1), (903, [math.nan] * size, 1), (904, [math.inf] * size, 0)]
    rows += [(910, [0.0] * size, 1), (920, [], 1), (930, [], 2), (940, [1.0, 2.0], 0), (950, [2.0, 1.0], 1), (960, [-1.0, -2.0], 1)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed):
    for name, value in (("SHARD", 48), ("BLOCK", 8), ("ROUTED", 3)):
        monkeypatch.setattr(balltree, name, value)
    rows = odd_vectors(np.random.default_rng(seed), 400)
    found = balltree.mine(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    expected = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(expected) > 200
    assert found_negatives(found) == expected


def test_hard_negatives_with_large_scores_and_without_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(4) * 2.0**20).tolist(), i % 2) for i in range(60)]
    assert found_negatives(balltree.mine(vectors(spark, rows), F.col("vec_id") % 7 == 0)) == brute_negatives(rows, lambda i: i % 7 == 0)
    assert balltree.mine(vectors(spark, []), F.col("vec_id") % 7 == 0).count() == 0


def test_bounds_hold_every_row_and_prune():
    rng = np.random.default_rng(4)
    rows = rng.integers(-40, 40, (2, 16))[np.arange(600) % 2] + rng.integers(-3, 3, (600, 16))
    tree, queries = balltree.Tree(rows, np.arange(600)), rng.integers(-40, 40, (9, 16)).astype(float)
    exact = queries @ rows[tree.order].T
    for center, radius, (start, end, _, _) in zip(tree.centers, tree.radii, tree.spans, strict=True):
        least, most = balltree.bounds(queries, center, radius)
        assert (least[:, None] <= exact[:, start:end]).all() and (exact[:, start:end] <= most[:, None]).all()
    # two clusters: from the second level on a ball is far smaller than all rows
    assert np.median(tree.radii) < 0.2 * tree.radii[0]


# -- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(leaves, fan):
    """The root, and for each leaf its steps of (place, siblings)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // fan * fan : p // fan * fan + fan]
            paths[i].append((p % fan, run[: p % fan] + run[p % fan + 1 :]))
        at, level = [p // fan for p in at], [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)]
    return level[0], paths


def brute_manifest(rows, fan):
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([leaf for _, _, leaf in sorted(groups[g])], fan) for g in order]
    root, tops = brute_tree([t[0] for t in trees], fan)
    out = []
    for g, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for (has, key, leaf), path in zip(sorted(groups[g]), paths, strict=True):
            out.append((key if has else None, g, leaf, subroot, root, path + top))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fan", "part"), [(2, 4), (3, 7), (2, 20_000)])
def test_manifest_equals_brute_force(spark, monkeypatch, fan, part):
    monkeypatch.setattr(merkle, "PART", part)
    monkeypatch.setattr(merkle, "REACH", 4)
    monkeypatch.setattr(merkle, "SHARE", 50)
    rng = np.random.default_rng(fan)
    rows = [(int(rng.integers(200)), ["en", "de", "", "é", None][int(rng.integers(5))], sha(str(i % 250))) for i in range(301)] + [(None, "en", sha("n")), (None, None, sha("m")), (7, "lone", sha("l")), (8, "en", sha("t")), (8, "en", sha("t"))]
    df = spark.createDataFrame([(*r, 1, "p", "q", "r") for r in rows], "doc_id long, lang string, leaf string, size int, tree string, proof string, key string")
    found = merkle.manifest(df, fan=fan)
    assert found.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()
    got = [(r.doc_id, r.lang, r.leaf, r.subroot, r.root, [(s["at"], s["others"]) for s in r.proof]) for r in found.collect()]
    assert sorted(got, key=repr) == brute_manifest(rows, fan)


def test_manifest_of_nothing_and_of_one_row(spark):
    schema = "doc_id long, lang string, leaf string"
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(1, None, "ab")], schema)).collect()
    assert (one.subroot, one.root, one.proof) == ("ab", "ab", [])


def test_leaf_digest_tells_nulls_and_borders(spark):
    rows = spark.createDataFrame([(1, None, "é"), (1, "", "é"), (1, "a", "bc"), (1, "ab", "c")], "i long, a string, b string")
    got = [r[0] for r in rows.select(merkle.leaf_digest(F.col("i"), F.col("a"), F.col("b"))).collect()]
    assert got == [sha("1:1-2:é"), sha("1:10:2:é"), sha("1:11:a2:bc"), sha("1:12:ab1:c")]


# -- near-duplicate vectors


def brute_dedup(rows, least=0.98):
    good = [i is not None and label is not None and sound(v) and any(v) for i, v, label in rows]
    scaled = [np.array(v) / np.abs(v).max() if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    unit = [v / np.linalg.norm(v) if v is not None else None for v in scaled]
    near = [[b for b in range(len(rows)) if b != a and good[a] and good[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least] for a in range(len(rows))]
    smallest = [r[0] for r in rows]
    while True:
        now = [min([smallest[a], *[smallest[b] for b in near[a]]]) if near[a] else smallest[a] for a in range(len(rows))]
        if now == smallest:
            return sorted(((r[0], len(n), c, r[0] == c) for r, n, c in zip(rows, near, smallest, strict=True)), key=repr)
        smallest = now


@pytest.mark.parametrize(("seed", "tile"), [(1, 16), (2, 1024)])
def test_embedding_dedup_equals_brute_force(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(embdedup, "TILE", tile)
    monkeypatch.setattr(embdedup, "SHARE", 200)
    rng = np.random.default_rng(seed)
    rows, size = [], 24
    for group, copies in enumerate([120, 40, 20, 10, 5, 5, 2, 2] + [1] * 60):
        center = rng.standard_normal(size)
        spread = [0.02, 0.17][group % 2]  # the wider ones link only in part
        rows += [(len(rows) + int(rng.integers(2)) * 1000, (center + spread * rng.standard_normal(size)).tolist(), int(rng.integers(2))) for _ in range(copies)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(30)] + [rows[3], (2100, (3 * np.array(rows[3][1])).tolist(), rows[3][2])]
    rows += [(None, rows[0][1], 0), (2200, None, 0), (2201, rows[0][1], None), (2202, [0.0] * size, 0), (2203, [math.nan] * size, 0), (2204, [None] * size, 0), (2205, [], 0)]
    rows += [(2300, [1e200, 1e200], 0), (2301, [1e-200, 1.01e-200], 0), (2302, [-1.0, 1.0], 0), (2303, [2.0], 1), (2304, [5.0], 1), (2305, [-5.0], 1)]
    got = sorted((tuple(r) for r in embdedup.dedup(vectors(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    assert [g[:3] for g in got] == [b[:3] for b in brute_dedup(rows)]
    assert all(g[3] == (g[0] == g[2]) for g in got)


def test_embedding_dedup_of_nothing(spark):
    assert embdedup.dedup(vectors(spark, [])).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    size = 48
    a = rng.standard_normal((400, size))
    b = 0.98 * a / np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((400, size))
    side -= (side * b).sum(1, keepdims=True) / (b * b).sum(1, keepdims=True) * b
    b += math.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)  # at the threshold, each to its partner
    signs, factors = embdedup.encode(a, 96)
    guess, floor = embdedup.estimates(signs, factors, b, 0.98)
    assert abs(guess.diagonal().mean() - 0.98) < 0.005
    assert (guess.diagonal() >= floor).all()
    others = guess[~np.eye(400, dtype=bool)]
    assert abs(others.mean()) < 0.01 and (others >= floor.max()).mean() < 0.001
