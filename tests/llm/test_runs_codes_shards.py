"""Runs of words, vector codes and shards against brute force, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import runs, sharding, vector_codes

SF = "/root/testdata/sf0.01"


def brute_runs(w):
    """Runs (start, length, period), period by period; of periods of one interval the smallest stays."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def word_lists(draw, n):
    for _ in range(n):
        t = [b"%d" % draw.randrange(draw.choice([1, 2, 3, 60])) for _ in range(draw.choice([0, 1, 5, 6, 7, 30, 150]))]
        if t and draw.random() < 0.5:
            k = draw.randrange(len(t))
            t = t[: k + 1] + t[draw.randrange(k + 1) : k + 1] * draw.randrange(1, 9) + t[: draw.randrange(4)]
        yield t * draw.choice([1, 1, 1, 2, 5])


def test_runs_against_brute_force():
    texts = list(word_lists(random.Random(4), 600))
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    texts += [b, [b"x"] * 1000, [b"x", b"y", b"x"] * 77, [b"x"] * 6, [b"x"] * 5]
    for part in (texts, *([t] for t in texts[:100])):
        for w, (found, collapsed) in zip(part, runs.runs_of(part), strict=True):
            assert found == brute_runs(w)
            assert collapsed == brute_collapsed(w, found)


def test_fallback_of_runs_is_the_same():
    for w in word_lists(random.Random(5), 60):
        ids, _ = runs.numbered([w])
        s, e, q = runs.plain_runs(ids)
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)) == brute_runs(w)


def test_grammar_derives_the_words():
    """Every nonterminal derives the same words at all its positions, and none of its occurrences leaves its text."""
    texts = [t for t in word_lists(random.Random(6), 200) if t]
    ids, ends = runs.numbered(texts)
    g = runs.re_pair(ids, ends)
    for r, at in zip(g.rule.tolist(), g.at.tolist(), strict=True):
        n = g.stop[r] - g.start[r]
        assert (ids[at : at + n] == ids[g.start[r] : g.stop[r]]).all()
        assert np.searchsorted(ends, at, "right") == np.searchsorted(ends, at + n - 1, "right")


@pytest.mark.parametrize("words", [[b"x"] * 150_000, [b"%d" % k for k in range(75_000)] * 2, [b"%d" % k for k in range(15_000)] * 10])
def test_runs_of_long_texts_take_little_time(words):
    import time

    began = time.process_time()
    (found, _), = runs.runs_of([words])
    assert time.process_time() - began < 20
    assert len(found) == (len(words) > 150_000 - 1 and words[0] != words[-1] and len(set(words)) == 15_000) + (len(set(words)) == 1)


def test_runs_edge_cases(spark):
    long = " ".join(["one two three"] * 30_000)
    rows = [(1, "a a a a a a b"), (2, None), (3, ""), (4, " \t\n"), (None, "a a a a a a b"), (1, "a a a a a a b"), (5, "x y " * 4), (6, long), (7, "A a A a A a\x0bA a")]
    df = spark.createDataFrame([(*r, "keep", 0) for r in rows], "doc_id bigint, text string, words_of string, RUNS int")
    out = runs.with_runs(df)
    assert out.columns == ["doc_id", "text", "words_of", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()]
    assert got[0] == got[5] == (1, 7, [(0, 6, 1)], "a b") and got[4][1:] == got[0][1:]
    assert [g[1:] for g in got[1:4]] == [(0, [], "")] * 3
    assert got[6] == (5, 4, [], " ".join(["x y"] * 4)) and got[7] == (6, 90_000, [(0, 90_000, 3)], "one two three") and got[8] == (7, 8, [(0, 8, 2)], "A a")
    assert {r.words_of for r in out.collect()} == {"keep"}
    assert runs.with_runs(df.limit(0)).count() == 0


def test_runs_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = {r.doc_id: r for r in runs.query(spark, SF).collect()}
    assert out.keys() == docs.keys()
    seen = 0
    for i, t in docs.items():
        w, h = (t or "").encode().split(), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if len(w) > 1500 and h % 10:
            continue  # plain brute force is quadratic: of the long texts those with planted runs are compared
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute_runs(w) if len(w) <= 1500 else [(int(s), int(e - s), int(q)) for s, e, q in zip(*runs.plain_runs(runs.numbered([w])[0]), strict=True)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = out[i]
        assert (r.n_runs, r.n_words) == (len(found), n)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, found)).hexdigest()
        seen += bool(found)
    assert seen > 50


# --- vector codes ------------------------------------------------------------------------------------------------------


def brute_codes(rows):
    """(vec_id, code, error) and codebooks by plain loops over whole numbers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0]))
    width = -(-max((len(r[1]) for r in kept), default=0) // 4) * 4
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) for c in r[1]] + [0] * (width - len(r[1])) for r in kept], dtype=object).reshape(len(kept), width)
    cut = [x[:, k * width // 4 : (k + 1) * width // 4] for k in range(4)]
    books = [c[:256].copy() for c in cut]
    for k in range(5):
        code = [[min(range(len(b)), key=lambda e: (sum((v - b[e]) ** 2), e)) for v in c] for c, b in zip(cut, books, strict=True)]
        if k < 4:
            for c, b, near in zip(cut, books, code, strict=True):
                for e in set(near):
                    mine = [c[i] for i in range(len(c)) if near[i] == e]
                    b[e] = [int(s) // len(mine) for s in sum(mine)]
    error = [sum(sum((c[i] - b[n[i]]) ** 2) for c, b, n in zip(cut, books, code, strict=True)) for i in range(len(kept))]
    return [(r[0], [n[i] for n in code], error[i]) for i, r in enumerate(kept)], books


def test_codes_against_brute_force(spark):
    draw = np.random.default_rng(2)
    rows = [(k, draw.normal(size=8).astype(np.float32).round(2).tolist(), k % 3 if k % 5 else None) for k in range(330)]
    rows[7:12] = [(7, rows[1][1], 1), (8, None, 1), (9, [1.0] * 7 + [None], 1), (10, [float("nan")] * 8, 1), (11, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, pd string, code int").repartition(3)
    out, books = vector_codes.compress(df)
    expected, brute = brute_codes(rows)
    got = sorted(out.collect(), key=lambda r: r.vec_id)
    assert [(r.vec_id, r.code, r.error) for r in got] == expected
    assert [b.tolist() for b in books] == [b.tolist() for b in brute]
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got) and None in sums
    salted = vector_codes.with_sums(out.drop("label_error"), "label", few=0)
    assert sorted(map(repr, salted.select(out.columns).collect())) == sorted(map(repr, out.collect()))


def test_pivots_prune_without_loss():
    draw = np.random.default_rng(3)
    centres = draw.integers(-2000, 2000, (40, 6))
    x = (centres[draw.integers(0, 40, 5000)] + draw.integers(-30, 30, (5000, 6))).astype(np.int64)
    book = x[draw.choice(5000, 256, replace=False)]
    book[100] = book[7]
    pivots = vector_codes.choose_pivots(book)
    index, best, evaluated = vector_codes.nearest(x, vector_codes.to_pivots(x, pivots), book, vector_codes.to_pivots(book, pivots))
    exact = vector_codes.squared(x, book)
    assert (index == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert evaluated < 0.2 * exact.size


def test_codes_edge_cases(spark):
    schema = "vec_id bigint, embedding array<double>, label string"
    rows = [(2, [0.5], "a"), (1, [0.25, 1e300, -1e300, 0.0, 1.0], "a"), (1, [0.25, 1e300, -1e300, 0.0, 1.0], None), (None, [], None)]
    out, books = vector_codes.compress(spark.createDataFrame(rows, schema))
    assert sorted((r.vec_id or 0, r.error) for r in out.collect()) == [(0, 0), (1, 0), (1, 0), (2, 0)] and books[0].shape == (4, 2)
    for none in (spark.createDataFrame([], schema), spark.createDataFrame([(1, None, "a")], schema)):
        out, books = vector_codes.compress(none)
        assert out.count() == 0 and [len(b) for b in books] == [0] * 4
        assert out.columns == ["vec_id", "label", "code", "error", "label_error"]
    out, _ = vector_codes.compress(spark.createDataFrame([(1, [], "a")], schema))
    assert [(r.code, r.error) for r in out.collect()] == [([0] * 4, 0)]


# --- shards ------------------------------------------------------------------------------------------------------------


def brute_shards(rows, shards, tolerance):
    """(doc_id, size) -> shard and slot of rows (doc_id, text) without repeated rows."""
    md5 = lambda x, n: hashlib.md5(("" if x is None else str(x)).encode()).digest()[:n]
    order = sorted((md5(t, 8), md5(i, 4), i, len((t or "").encode()) + 16) for i, t in rows)
    total, before, out, groups = sum(r[3] for r in order), 0, [], {}
    for g, _, i, size in order:
        out.append([g, i, size, before * shards // total])
        first = groups.setdefault(g, [out[-1][3], 0])
        first[1] += size
        before += size
    slots, done = {}, {}
    for g, i, size, shard in out:
        if groups[g][1] <= int(total / shards * tolerance):
            shard = groups[g][0]
        done[i] = (size, shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
    return done


@pytest.mark.parametrize("copies", [0, 300])
def test_shards_against_brute_force(spark, copies):
    draw = random.Random(8)
    rows = [(i, " ".join(draw.choice(["ab", "c", "défg"]) for _ in range(draw.randrange(40)))) for i in range(500)] + [(1000 + i, "the same text") for i in range(copies)]
    rows += [(5000, None), (5001, "")] + [(6000 + i, rows[i % 50][1]) for i in range(100)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, SHARD int, place string").repartition(3)
    out = sharding.shard_documents(df, shards=7, tolerance=0.02, part_bytes=500)
    assert out.columns == ["doc_id", "text", "place", "size", "shard", "slot"]
    assert {r.doc_id: (r.size, r.shard, r.slot) for r in out.collect()} == brute_shards(rows, 7, 0.02)


def test_shards_of_the_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = {r.doc_id: r for r in sharding.query(spark, SF).collect()}
    assert {i: (r["size"], r.shard, r.slot) for i, r in out.items()} == brute_shards(list(docs.items()), 40, sharding.TOLERANCE)
    assert all(r.text_crc32 == zlib.crc32((docs[i] or "").encode()) and r.law == "bytes" and r.grown_shard is None for i, r in out.items())


def test_shards_of_repeated_rows_are_even(spark):
    rows = [(1, "x" * 84)] * 600 + [(None, None)] * 50 + [(2, "y" * 20_000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), shards=5, part_bytes=1000).collect()
    assert len(out) == 651
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())
    sizes = sorted(sum(r["size"] for r in part) for part in by.values() if not any(r.doc_id == 2 for r in part))
    assert sizes[-1] - sizes[0] <= 20_100


def test_shards_edge_cases(spark):
    schema = "doc_id bigint, text string"
    assert sharding.shard_documents(spark.createDataFrame([], schema)).count() == 0
    one = sharding.shard_documents(spark.createDataFrame([(None, None)], schema)).collect()
    assert [(r.doc_id, r["size"], r.shard, r.slot) for r in one] == [(None, 16, 0, 0)]
    few = sharding.shard_documents(spark.createDataFrame([(1, "a" * 100), (2, "b" * 500_000), (3, "")], schema), shards=4).collect()
    assert sorted(r["size"] for r in few) == [16, 116, 500_016] and all(0 <= r.shard < 4 for r in few)


def test_one_exchange_brings_rows_to_parts(spark):
    plan = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
