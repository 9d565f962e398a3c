"""Line dedup and near dedup against brute force, and their edge cases."""

import itertools
import random

import numpy as np
import pytest

from turnlake.llm import line_dedup, near_dedup
from turnlake.llm.common import Scratch
from turnlake.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string"


def brute_lines(docs):
    """doc_id -> text without the lines of later occurrences of three-line windows."""
    first, gone = {}, {}
    for i, t in sorted(docs.items()):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if "".join(w).strip():
                if w in first:
                    gone.setdefault(i, set()).update((p, p + 1, p + 2))
                else:
                    first[w] = (i, p)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs.items()}


def test_lines_against_brute_force(spark):
    draw = random.Random(3)
    docs = {i: "\n".join(draw.choice("abcd") for _ in range(draw.randrange(12))) for i in range(60)}
    out = line_dedup.remove_repeats(spark.createDataFrame([(i, t, "en") for i, t in docs.items()], DOCS))
    assert {r.doc_id: r.text for r in out.collect()} == brute_lines(docs)


def test_lines_edge_cases(spark):
    passage = "\n".join(f"line {k}" for k in range(5))
    rows = [(1, passage, "en"), (2, "x\n" + passage + "\ny", "en"), (3, None, "en"), (4, "", None), (5, "\n\n\n\n", "en"), (6, "\n\n\n\n", "en"), (None, passage, "en"), (7, "one\ntwo", "en"), (8, "one\ntwo", "en"), (2, "x\n" + passage + "\ny", "en")]
    df = spark.createDataFrame([(*r, 0, "keep") for r in rows], DOCS + ", n_lines int, starts string")
    out = sorted(line_dedup.remove_repeats(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = [(r.doc_id, r.text, r.n_removed) for r in out]
    assert got == [(None, passage, 0), (1, "", 5), (2, "x\ny", 5), (2, "x\ny", 5), (3, None, 0), (4, "", 0), (5, "\n\n\n\n", 0), (6, "\n\n\n\n", 0), (7, "one\ntwo", 0), (8, "one\ntwo", 0)]
    assert {r.starts for r in out} == {"keep"}
    assert line_dedup.remove_repeats(df.limit(0)).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def brute_classes(docs, k, num, den):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in docs}


def corpus(n, seed):
    """Families of texts, each edited from the one before or from the family's first."""
    draw, docs = random.Random(seed), {}
    words = [f"w{k}" for k in range(400)]
    while len(docs) < n:
        base = [draw.choice(words) for _ in range(draw.choice((2, 8, 40, 120)))]
        now = list(base)
        for _ in range(draw.choice((1, 2, 6, 30))):
            docs[len(docs)] = " ".join(now)
            now = list(draw.choice((now, base)))
            for _ in range(draw.choice((0, 0, 1, 3, 9))):
                now[draw.randrange(len(now))] = draw.choice(words)
    return docs


@pytest.mark.parametrize(("k", "num", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_classes_against_brute_force(spark, k, num, seed):
    docs = corpus(260, seed)
    out = near_dedup.duplicate_classes(spark.createDataFrame([(i, t, "en") for i, t in docs.items()], DOCS), words=k, num=num)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute_classes(docs, k, num, 100)


def test_blocks_find_every_link(spark, monkeypatch):
    """Buckets with several components, dealt into many small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 3)
    draw = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    docs = {}
    for i in range(80):
        now = list(base)
        for _ in range(draw.choice((2, 4, 6, 8))):
            now[draw.randrange(len(now))] = f"x{draw.randrange(30)}"
        docs[i] = " ".join(now)
    out = near_dedup.duplicate_classes(spark.createDataFrame([(i, t, "en") for i, t in docs.items()], DOCS), words=3, num=85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out.collect()} == brute_classes(docs, 3, 85, 100)


def test_classes_edge_cases(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(9, text, "en"), (4, text.upper(), "en"), (4, text.upper(), "en"), (None, text, "en"), (5, None, "en"), (6, "", "en"), (7, " \t\n", "en"), (8, "Hi", "en"), (3, "hi", "en"), (2, text + " " + " ".join(f"q{k}" for k in range(20000)), "en")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", n_shingles int, id int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.duplicate_classes(df).collect())
    assert got == [(-1, 26, None, True), (2, 20026, 2, True), (3, 1, 3, True), (4, 26, 4, True), (4, 26, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 3, False), (9, 26, 4, False)]
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 4, 4, 5, 6, 7]
    assert near_dedup.duplicate_classes(df.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100 + draw.randrange(60), 100 + draw.randrange(60)) for _ in range(45)] + [(7, 7), (3, 4)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root}


def test_bands_and_minima():
    assert near_dedup.bands(0.85) == (25, 5)
    for t in (0.8, 0.85):
        n, r = near_dedup.bands(t)
        assert (1 - t**r) ** n <= near_dedup.MISSED and n * r <= near_dedup.MINIMA
    s = near_dedup.shingler(3, 0.85)
    draw = np.random.default_rng(0)
    both, own = draw.integers(0, 2**63, 600).astype(np.uint64), draw.integers(0, 2**63, 200).astype(np.uint64)
    agree = [(s.minima(both + np.uint64(k)) == s.minima(np.concatenate([both, own]) + np.uint64(k))).mean() for k in range(50)]
    assert abs(np.mean(agree) - 0.75) < 0.03
