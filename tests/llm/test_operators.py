"""The operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter
from datetime import date

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from wayfarer.llm import ann, bpe, decontaminate, html, jaccard, langid, licenses, linededup, lm, urlfilter

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sig long, part long, row string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def made(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x") for i, t in rows], DOCS)


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words, n))


def near_copies(rng, n_groups=6):
    """Texts with exact copies, chains of small changes, nulls, and a passage that many share."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "one two three"), (7, "x " * 3000)]
    shared = prose(rng, 60)
    for g in range(n_groups):
        text = prose(rng, int(rng.integers(40, 200))).split()
        for _ in range(8):
            rows.append((10 + len(rows), " ".join(text)))
            text = list(text)
            for _ in range(int(rng.integers(0, 3))):
                text[int(rng.integers(len(text)))] = str(rng.choice(WORDS))
    rows += [(1000 + i, prose(rng, 40) + " " + shared + " " + prose(rng, 30)) for i in range(12)]
    return rows + rows[8:11]


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows):
    sets, label = [shingles(t) for _, t in rows], [i for i, _ in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    same = [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] == rows[b][0]]
    while True:
        was = list(label)
        for a, b in links + same:
            label[a] = label[b] = min(label[a], label[b])
        if was == label:
            return sorted((rows[i][0], len(sets[i]), label[i]) for i in range(len(rows)))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed):
    rows = near_copies(np.random.default_rng(seed))
    found = jaccard.join(made(spark, rows).repartition(5)).collect()
    assert sorted(tuple(r) for r in found) == brute_components(rows)


def test_jaccard_with_a_hot_group(spark, monkeypatch):
    """One text in many changed copies: more than a part holds, and borderline sets outside the group."""
    monkeypatch.setattr(jaccard, "PART", 4)
    monkeypatch.setattr(jaccard, "LONE", 2)
    rng = np.random.default_rng(3)
    base, rows = prose(rng, 120).split(), []
    for i in range(120):
        text = list(base)
        for at in rng.choice(120, int(rng.integers(0, 6)), replace=False):
            text[at] = f"new{rng.integers(1e6)}"
        rows.append((i + 1, " ".join(text)))
    found = jaccard.join(made(spark, rows).repartition(7)).collect()
    assert sorted(tuple(r) for r in found) == brute_components(rows)


def test_jaccard_on_an_empty_table(spark):
    assert jaccard.join(made(spark, [])).collect() == []


def test_bpe_equals_tiktoken_and_decodes(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rng = np.random.default_rng(5)
    alphabet = list("aabcde  \n'stré ü1234ß漢字😀\t.,-")
    rows = [(i, "".join(rng.choice(alphabet, int(rng.integers(0, 80))))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "a" * 5000), (303, " " * 999 + "x"), (304, "<|endoftext|>"), (304, "<|endoftext|>"), (305, "ab" * 2000)]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coded = bpe.encode(made(spark, rows).withColumn("n_tokens", F.lit(-1)), path, public_tokenizers.PATTERN, digests=True)
    got = bpe.decode(coded, path).select("doc_id", "text", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = own.encode_ordinary(r.text or "")
        assert (r.token_ids, r.n_tokens) == (ids, len(ids))
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest()


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    few = WORDS[:12]
    items = [(f"i{i}", prose(rng, int(rng.integers(5, 30)), few)) for i in range(15)] + [("i_none", None), ("i_empty", "..."), ("short", "w1 w2 w3"), (None, prose(rng, 15))]
    rows = [(i, prose(rng, 60, few)) for i in range(20)] + [(50, None), (51, ""), (52, "w1-W2, w3"), (52, "w1-W2, w3")]
    rows += [(60 + i, prose(rng, 30) + " " + t.upper() + "! " + prose(rng, 30)) for i, (_, t) in enumerate(items) if t]
    expected = []
    for key, text in rows:
        words, hit, named = alnum(text), set(), set()
        for item, t in items:
            w = alnum(t)
            n = min(10, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            for at in range(len(words) - n + 1) if windows else ():
                if tuple(words[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    named |= {item} - {None}
        expected.append((str(key), len(words), len(hit), tuple(sorted(named))))
    table = spark.createDataFrame(items, "item_id string, text string")
    for size, piece in ((decontaminate.QUERY_BYTES, decontaminate.PIECE), (600, 7)):  # at once, and in blocks of pieces of items
        monkeypatch.setattr(decontaminate, "QUERY_BYTES", size)
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        found = decontaminate.decontaminate(made(spark, rows), table, slop=2)
        assert sorted((r.doc, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()) == sorted(expected)


def test_decontamination_finds_near_matches_and_takes_empty_tables(spark):
    passage = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12"
    items = spark.createDataFrame([("x", passage)], "item_id string, text string")
    docs = made(spark, [(1, "q " + passage.replace("c3 ", "c3 extra ") + " q"), (2, "a1 b2 q q q q q q q j10")])
    found = {r.doc: r for r in decontaminate.decontaminate(docs, items, slop=2).collect()}
    assert found["1"].n_hit == 0 and found["1"].near and not found["2"].near
    assert decontaminate.decontaminate(made(spark, []), items).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(docs, items.limit(0)).collect())


def test_near_matches_equal_brute_force_at_every_offset(spark, monkeypatch):
    """Words 4-13 of an item with words 7 and 9 replaced, its last words, and windows drawn at random."""
    monkeypatch.setattr(decontaminate, "CANDIDATES", 50)
    rng = np.random.default_rng(17)
    items = {"whole": [f"a{i}" for i in range(23)], "few": list(rng.choice(WORDS[:8], 14)), "short": ["s1", "s2", "s3", "s4", "s5"]}
    rows = []
    for words in items.values():
        size = min(10, len(words))
        for at in range(len(words) - size + 1):
            quoted = words[at : at + size]
            for i in rng.choice(size, 2, replace=False):
                quoted[i] = "changed"
            rows.append(f"q {' '.join(quoted)} q")
    rows += ["q " + " ".join("changed" if i in (7, 9) else w for i, w in enumerate(items["whole"]) if 4 <= i <= 13) + " q"]
    # what a document lacks may not be borrowed from those beside it
    rows += ["a0 a1 a2 a3 a4 a5 a6 x y z", "a7 a8 a9 q", *(prose(rng, 40, WORDS[:8]) for _ in range(8))]
    docs = made(spark, list(enumerate(rows))).coalesce(1)
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id string, text string"), slop=2).collect()
    for r in found:
        text, expected = rows[int(r.doc)].split(), set()
        for item, words in items.items():
            size = min(10, len(words))
            inside = [(x.start, x.stop) for x in r.exact if x.item == item]
            for w in range(len(words) - size + 1):
                whole = [s for s in range(len(text) - size + 1) if text[s : s + size] == words[w : w + size]]
                for s in range(len(text) - size + 1):
                    there = sum(words[w + i] in text[max(0, s + i - 2) : s + i + 3] for i in range(size))
                    if there >= size - 2 and not any(abs(s - x) <= 2 for x in whole) and not any(a <= s and s + size <= b for a, b in inside):
                        expected |= {(item, i) for i in range(s, s + size)}
        assert {(x.item, i) for x in r.near for i in range(x.start, x.stop)} == expected, r.doc
    assert {x.item for r in found for x in r.near} == set(items)


def brute_lines(rows, least):
    """Every run of whole lines with enough words that occurs before goes."""
    places = sorted({(k, t) for k, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0]))
    cut = [t.split("\n") for _, t in places]
    gone, seen = [set() for _ in places], {}
    for d, lines in enumerate(cut):
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                run = tuple(lines[s:e])
                if sum(len(x.split()) for x in run) >= least:
                    if seen.setdefault(run, (d, s)) != (d, s):
                        gone[d] |= set(range(s, e))
    return {p: ("\n".join(x for i, x in enumerate(lines) if i not in g), len(g)) for p, lines, g in zip(places, cut, gone, strict=True)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linededup_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    lines = [prose(rng, int(rng.integers(0, 7))) for _ in range(14)]
    rows = [(i, "\n".join(rng.choice(lines, int(rng.integers(1, 12))))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, lines[0]), (104, "\n".join(lines * 3)), (105, prose(rng, 30)), (106, prose(rng, 12))]
    rows += [(107, rows[-2][1]), rows[-1], rows[3]]
    got = linededup.dedup_lines(made(spark, rows).repartition(4), min_words=10).select("doc_id", "text", "n_removed", "source").collect()
    expected = brute_lines(rows, 10)
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got) == Counter((k, *expected[k, t]) if t is not None else (k, None, 0) for k, t in rows)
    assert linededup.dedup_lines(made(spark, [])).collect() == []


def test_repeated_runs_cover_what_dedup_removes(spark):
    rng = np.random.default_rng(4)
    lines = [prose(rng, int(rng.integers(1, 7))) for _ in range(10)]
    docs = made(spark, [(i, "\n".join(rng.choice(lines, int(rng.integers(1, 12))))) for i in range(30)])
    runs = linededup.repeated_runs(docs).collect()
    gone = Counter()
    for r in runs:
        assert r.start < r.stop
        gone[r.key] += r.stop - r.start
    assert gone == Counter({r.doc_id: r.n_removed for r in linededup.dedup_lines(docs).collect() if r.n_removed})
    spans = sorted((r.key, r.start, r.stop) for r in runs)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_ann_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((20, 16))
    vectors = [(i, (centres[i % 20] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(2000)]
    vectors += [(5000 + i, [1.0] * 16) for i in range(40)]  # ties
    vectors += [(6000, None), (6100, [0.0] * 16), (6200, [float("nan")] * 16), (6300, [float("inf")] + [1.0] * 15), (6400, []), (6500, [None] + [1.0] * 15), (7, vectors[7][1])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))
    got = ann.search(table, F.col("vec_id") % 100 == 0).collect()
    good = [(i, np.array(v)) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = [(i, v) for i, v in good if i % 100 == 0]
    assert {r.query_id for r in got} == {i for i, _ in queries}
    hit = 0
    for q, v in queries:
        best = sorted({(float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in good if i != q})[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [x[0] for x in mine] == list(range(1, 11)) and len({x[1] for x in mine}) == 10
        hit += len({x[1] for x in mine} & {i for _, i in best})
        if q == 5000:
            assert [x[1] for x in mine] == [i for _, i in best]
    assert hit / (10 * len(queries)) >= 0.9
    few = table.where("vec_id IN (100, 101, 102)")
    assert [(r.rank, r.vec_id) for r in ann.search(few, F.col("vec_id") == 100).orderBy("rank").collect()] in ([(1, 101), (2, 102)], [(1, 102), (2, 101)])
    assert ann.search(table.limit(0), F.lit(True)).collect() == []


def test_langid(spark):
    texts = {"en": "the house and the garden were there with this and that", "de": "das haus und der garten waren nicht mit dem und auch nicht", "fr": "la maison et le jardin étaient là avec les autres dans une rue"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), k) for i, (k, t) in enumerate(list(texts.items()) * 10)]
    table = spark.createDataFrame([*rows, (90, None, "en"), (91, "...", None), (92, "the", None)], "doc_id long, text string, lang string")
    filters = langid.train(table)
    asked = spark.createDataFrame([(1, "und das haus mit dem garten"), (2, "the garden and the house"), (3, "le jardin et la maison"), (4, None), (5, ""), (6, "123 -- !"), (7, "the garden " * 200_000), (2, "the garden and the house")], "doc_id long, text string").withColumn("score", F.lit("x"))
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(asked, filters).collect()]
    assert sorted(got) == [(1, "de"), (2, "en"), (2, "en"), (3, "fr"), (4, "und"), (5, "und"), (6, "und"), (7, "en")]
    assert all(0 <= r.score <= 1 for r in langid.predict(asked, filters).collect())
    assert {r.lang_pred for r in langid.predict(asked, langid.train(table.limit(0))).collect()} == {"und"}


def test_langid_with_more_than_eight_languages_and_ties(spark):
    rng = np.random.default_rng(23)
    letters = [chr(97 + i) for i in range(20)]
    words = {f"l{k:02}": ["".join(rng.choice(letters, 6)) for _ in range(30)] for k in range(11)}
    table = spark.createDataFrame([(i, prose(rng, 40, w), k) for i, (k, w) in enumerate(list(words.items()) * 3)], "doc_id long, text string, lang string")
    filters = langid.train(table)
    assert len(filters.tables) == 2
    asked = spark.createDataFrame([(i, prose(rng, 25, w)) for i, w in enumerate(words.values())] + [(50, "zzzzzz zzzz")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(asked, filters).collect()}
    assert [got[i][0] for i in range(11)] == sorted(words)
    assert got[50] == ("l00", 0.0)  # no gram known: the label that sorts first


def test_langid_long_texts_in_pieces_count_alike(spark, monkeypatch):
    import pyarrow as pa

    text = pa.array(["Der Garten, das Haus – où est-il? " * 500])
    whole = np.concatenate([k for k, _ in langid.grams(text)])
    monkeypatch.setattr(langid, "PIECE", 777)
    assert np.array_equal(np.concatenate([k for k, _ in langid.grams(text)]), whole)


def test_lm_base_score_and_probabilities(spark):
    rng = np.random.default_rng(13)
    rows = [(i, prose(rng, int(rng.integers(0, 40)), WORDS[:50]).title()) for i in range(60)] + [(100, None), (101, ""), (102, "unseen words é"), (103, "long " * 5000), (3, "again w1")]
    docs = made(spark, rows).select("doc_id", "text", "part", langid.held_out(F.col("doc_id"), 10, 0).alias("held_out"))
    model = lm.train(docs.where("NOT held_out"))
    got = lm.score_with_unigrams(docs, model).collect()
    assert len(got) == len(rows)

    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]

    c = Counter(w for k, t in rows if zlib.crc32(str(k).encode()) % 10 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = sorted((k, zlib.crc32(str(k).encode()) % 10 == 0, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for k, t in rows for x in [tokens(t)])
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)
    # over all next bytes the probabilities of a context add up to one
    for context in (b"\xfe\xfe\xfe", b"w1 ", b"zzz"):
        code = model.code[np.frombuffer(context, np.uint8)]
        a = model.size
        at = (code[0] * a + code[1]) * a + code[2]
        row = model.row3[at]
        p = 10 ** (model.table3[row * a : row * a + a] if row >= 0 else model.table2[at % (a * a) * a : at % (a * a) * a + a])
        assert abs(p[:-1].sum() + p[-1] * (256 - (a - 1)) - 1) < 1e-3
    empty = lm.train(docs.limit(0))
    assert all(math.isfinite(r.score) for r in lm.score(docs, empty).collect())
    assert lm.score_with_unigrams(docs.limit(0), model).collect() == []
    adaptive = {r.doc_id: r.score for r in lm.adaptive_score(made(spark, [(1, "ab" * 200), (2, None)])).collect()}
    assert adaptive[1] > -400 * math.log10(256) / 4 and adaptive[2] < 0


def brute_ppm(texts, text):
    """log10 of the probability of a text, with all contexts of up to three bytes."""
    follow, used = {}, {0xFE, 0xFF}
    for t in texts:
        data = b"\xfe\xfe\xfe" + (t or "").encode() + b"\xff"
        for i in range(3, len(data)):
            used.add(data[i])
            for d in range(4):
                follow.setdefault(data[i - d : i], Counter())[data[i]] += 1
    data, total = b"\xfe\xfe\xfe" + (text or "").encode() + b"\xff", 0.0
    for i in range(3, len(data)):
        p, out = 1.0, set()
        for d in (3, 2, 1, 0):
            now = {s: n for s, n in follow.get(data[i - d : i], {}).items() if s not in out}
            n, q = sum(now.values()), len(now)
            if data[i] in now:
                p *= now[data[i]] / (n + q)
                break
            if n:
                p *= q / (n + q)
                out |= now.keys()
        else:
            p /= 256 - len(used)
        total += math.log10(p)
    return total


def test_lm_keeps_rare_contexts(spark, monkeypatch):
    """No text is scored by a shorter context than it has, however rare the context is."""
    rng = np.random.default_rng(19)
    rows = [(i, prose(rng, int(rng.integers(1, 30)), WORDS[:60])) for i in range(30)] + [(40, None), (41, "éa écru ü"), (42, "w1 unseen Zé"), (42, "w1 unseen Zé"), (43, "w5 w66 w5w5")]
    docs = made(spark, rows).withColumn("held_out", F.col("doc_id") >= 42)
    learned = [t for i, t in rows if i < 42]
    expected = sorted((i, round(brute_ppm(learned, t), 2)) for i, t in rows)
    for share, shard in ((2.0**-16, 10**7), (0.01, 10**7), (0.01, 500), (1.1, 10**7)):
        monkeypatch.setattr(lm, "SHARE", share)
        monkeypatch.setattr(lm, "SHARD_BYTES", shard)
        model = lm.train(docs.where("NOT held_out"))
        for got in (lm.score(docs, model), lm.score_with_unigrams(docs, model)):
            got = sorted((r.doc_id, r.score) for r in got.collect())
            assert [i for i, _ in got] == [i for i, _ in expected]
            assert all(abs(a - b) < 0.02 for (_, a), (_, b) in zip(got, expected, strict=True)), (share, shard)


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0"), (5, "cc-by-nc cc by nc"), (6, "mit license"), (1, "Released under the MIT License."), (7, "x " * 20000 + "under the mit license")]
    rows += [(8, "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and its associated documentation files")]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(made(spark, rows))).collect()}
    assert licenses.scan(made(spark, rows)).count() == len(rows)
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (1, 1, 1, "mit", "mit")
    assert (got[2].n_words, got[3].n_words, got[2].labels, got[2].first_word, got[2].score) == (0, 0, "", None, 0.0)
    assert got[4].base_labels == "apache-2" and got[5].n_base == 2 and (got[5].first_word, got[5].last_word) == (0, 3)
    assert got[6].labels == "" and got[7].first_word == 20000
    assert (got[8].base_labels, got[8].labels) == ("", "mit") and 0.6 <= got[8].score < 1
    assert licenses.scan(made(spark, [])).collect() == []


def test_urlfilter(spark):
    entries = urlfilter.list_entries(spark, [("a", "domain", "bad.example", "add", "2024-02-01"), ("a", "domain", "bad.example", "remove", "2024-03-01"), ("b", "prefix", "x.example/p/", "add", "2024-01-01"), ("a", "domain", "bad.example", "add", "2024-02-01")])
    day = date(2024, 2, 10)
    rows = [(1, "https://www.bad.example/a", day), (2, "https://www.bad.example/a", date(2024, 3, 1)), (3, "http://x.example/p/q?z", day), (4, "http://x.example/pq", day), (5, None, day), (6, "no url", day), (7, "http://bad.example:80", None), (8, "http://notbad.example/", day), (1, "https://www.bad.example/a", day)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date").withColumn("list", F.lit("mine")).withColumn("since", F.lit(1))
    got = urlfilter.evaluate(captures, entries)
    assert sorted((r.page_id, r.blocked, r.lists) for r in got.collect()) == [(1, True, "a"), (1, True, "a"), (2, False, ""), (3, True, "b"), (4, False, ""), (5, False, ""), (6, False, ""), (7, False, ""), (8, False, "")]
    assert not any(r.blocked for r in urlfilter.evaluate(captures, entries.limit(0)).collect())
    assert urlfilter.evaluate(captures.limit(0), entries).collect() == []


def test_html(spark):
    def page(i, body):
        return f"<html><head><title>T{i}</title><style>p{{}}</style></head><body><div class='wrap'><nav><a href=/>Home</a> <a href=/a>About</a></nav>{body}<div class='sidebar'>Related {i}</div><footer>All rights &copy; reserved</footer></div><script>var x='<p>no</p>'</script></body></html>"

    rows = [(i, f"http://h.example/{i}", page(i, f"<article><h1>Head {i}</h1><p>One&nbsp;{i}  two &amp; three</p><p>Four <b>five</b><br>six</p></article><div class=comments>Nice {i}!</div>")) for i in range(6)]
    rows += [(10 + i, f"http://g.example/{i}", page(i, f"<div class=c><h1>Title {i}</h1><p>Text of the story number {i} goes here and on</p><p>More of story {i} follows</p></div>")) for i in range(6)]
    rows += [(20, "http://h.example/20", None), (21, None, ""), (22, "odd", "<p>unclosed <div>x"), (0, rows[0][1], rows[0][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("part", F.lit(1)).withColumn("text", F.lit("no"))
    got = html.extract(table)
    texts = {r.page_id: r.text for r in got.collect()}
    assert got.count() == len(rows)
    for i in range(6):
        assert texts[i] == f"Head {i}\n\nOne {i} two & three\n\nFour five six"
        assert texts[10 + i] == f"Title {i}\n\nText of the story number {i} goes here and on\n\nMore of story {i} follows"
    assert texts[20] == "" and texts[21] == ""
    assert html.extract(table.limit(0)).collect() == []


def test_html_without_an_article_keeps_the_title_and_parts_beside_the_body(spark):
    def page(i):
        return f"<body><nav><a href=/>Home</a></nav><div class=c><h1>Title {i}</h1><div class=lead>Lead {i}</div><div class=body><p>{'Long story ' * 40}{i}</p></div><div class=end>Last {i}</div></div></body>"

    rows = [(i, f"http://one{i}.example/", page(i)) for i in range(3)]
    texts = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert texts == {i: f"Title {i}\n\nLead {i}\n\n{'Long story ' * 40}{i}\n\nLast {i}" for i in range(3)}


def unmarked(i):
    """A page without article, of a host whose boilerplate no name gives away."""
    return f"<body><div class=q><p>Every page of ours says this in the same words</p></div><div class=z><h1>Story {i}</h1><p>{prose(np.random.default_rng(i), 30)}</p></div><div class=q><p>Made with care by people who write</p></div></body>"


def test_html_template_decides_without_names(spark, monkeypatch):
    rows = [(i, "http://plain.example/x", unmarked(i)) for i in range(40)]
    rows += [(100 + i, "http://plain.example/y", unmarked(7)) for i in range(60)]  # copies count once
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    expected = {i: f"Story {n}\n\n{prose(np.random.default_rng(n), 30)}" for i, n in [(i, i) for i in range(40)] + [(100 + i, 7) for i in range(60)]}
    assert {r.page_id: r.text for r in html.extract(table).collect()} == expected
    monkeypatch.setattr(html, "PART", 8)  # a host of several parts
    assert {r.page_id: r.text for r in html.extract(table).collect()} == expected
    monkeypatch.setattr(html, "BROADCAST_HOSTS", 0)  # joins by shuffle
    assert {r.page_id: r.text for r in html.extract(table, slots=True).collect()} == expected
    monkeypatch.setattr(html, "PAGES", 10**9)  # no template: the boilerplate stays
    assert all(r.text.startswith("Every page") for r in html.extract(table).collect())


def test_html_deduction_equals_brute_force():
    pages = [unmarked(i) for i in range(12)] + [unmarked(3).replace("care", "pride")]
    part = html.Part(pages, np.arange(1, 14).astype(np.int64))
    valid = {int(t) for t in part.found[part.valid()]}
    counts, sequences = [], []
    for page in pages:
        tokens = []
        for x in html.parse(page)[1]:
            tokens += [(x, None)] if isinstance(x, str) else [(x.path, w.lower()) for w in x.text().split()]
        counts.append(Counter(tokens))
        sequences.append(tokens)
    classes = {}
    for token in {t for c in counts for t in c}:
        vector = tuple(c[token] for c in counts)
        if sum(n > 0 for n in vector) * 2 >= len(pages):
            classes.setdefault(vector, set()).add(token)
    expected = set()
    for vector, tokens in classes.items():
        if len(tokens) >= html.LARGE and max(vector) == 1:
            orders = {tuple(t for t in s if t in tokens) for s, n in zip(sequences, vector, strict=True) if n}
            expected |= tokens if len(orders) == 1 else set()
    hashed = set()
    for path, word in expected:
        words = html.hashed_words(html.pa.array([word or ""]), html.SPACED)[0]
        hashed.add(int(html._word_tokens(path, words)[0]) if word else html._path_hash(path))
    assert expected and valid == hashed


def test_html_names_inside_an_article_must_say_it_in_full(spark):
    stays = ["<div class='social-science'>A one</div>", "<section class='notice-of-motion'>B two</section>", "<h2 id='related-work'>C three</h2>", "<div class='post-header'>D four</div>", "<section id='comments-on-method'>E five</section>"]
    goes = ["<div class='ad-slot'>F</div>", "<div class='comments'>G</div>", "<aside>H</aside>", "<div class='x share-buttons'>I</div>", "<form>J</form>", "<div id='cookie-banner'>K</div>"]
    page = f"<body><article><h1>Title</h1>{''.join(stays + goes)}<p>{'long ' * 40000}</p></article></body>"
    found = html.extract(spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")).collect()
    assert found[0].text == "Title\n\nA one\n\nB two\n\nC three\n\nD four\n\nE five\n\n" + ("long " * 40000).strip()
