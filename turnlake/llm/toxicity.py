"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own embedding beside the mean embedding of its character n-grams, so that unseen forms of known
stems are recognised. A text is cut into overlapping windows of words; every window is scored, and the text's score is
its largest window score. Documents carry one label each, so training alternates between picking each
document's highest window under the current network and gradient steps on the picked windows. All of it is numpy.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import Scratch, bounded_sample, held_out

WORD = re.compile(r"\w+")
WINDOW, STRIDE = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 6, 6, 8, 8
BUCKETS = 8192
LONG_WORD = 100_000  # characters of a word beyond which its n-grams are added up in pieces of this size
BLOCK = STRIDE * 4000  # words of a text between the first words of two blocks of windows
CACHED_TYPES = 120_000
LANES = 4096


def buckets_at(points: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash buckets of the n-grams of this length that begin at these points; the same in every process."""
    h = np.full(len(at), length, np.uint64)
    for k in range(length):
        h = (h ^ points[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)).astype(np.int32) % np.int32(BUCKETS)


def code_points(words: list[str]) -> np.ndarray:
    """The words' code points with the borders of each marked, and some zeros behind."""
    points = np.frombuffer(("<" + "><".join(words) + ">" if words else "").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([points, np.zeros(6, np.uint32)]).astype(np.uint64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words' 3-grams with the borders marked and of their 4- and 5-letter stems; how many each word has.

    One pass over the joined words, whatever their lengths.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    points = code_points(words)
    first = np.concatenate([[0], np.cumsum(size + 2)])[:-1].astype(np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    parts, owners = [buckets_at(points, first[owner] + inside, 3)], [owner]
    for n in (4, 5):
        has = np.flatnonzero(size >= n)
        parts.append(buckets_at(points, first[has] + 1, n))
        owners.append(has)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.bincount(owner, minlength=len(words))


def long_mean(table: np.ndarray, word: str) -> np.ndarray:
    """The mean of the table's rows of one very long word's grams, added up piece by piece so that memory stays bounded."""
    n = len(word)
    sums = np.zeros(table.shape[1])
    for lo in range(0, n, LONG_WORD):  # 3-grams begin at the points 0 .. n - 1 of "<word>"
        points = code_points([word[max(0, lo - 1) : lo + LONG_WORD + 2]])
        at = np.arange(min(LONG_WORD, n - lo)) + (lo > 0)
        sums += table[buckets_at(points, at, 3)].sum(axis=0, dtype=np.float64)
        if not lo:
            sums += table[buckets_at(points, np.array([1]), 4)[0]].astype(np.float64) + table[buckets_at(points, np.array([1]), 5)[0]]
    return (sums / (n + 2)).astype(np.float32)


def char_means(table: np.ndarray, buckets: np.ndarray, per_word: np.ndarray) -> np.ndarray:
    """Mean rows of the buckets of each word; a word without any has a mean of zeros."""
    out = np.zeros((len(per_word), table.shape[1]), np.float32)
    has = per_word > 0
    if has.any():
        n = per_word[has]
        out[has] = np.add.reduceat(table[buckets], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)
    return out


def windows(n: int) -> range:
    """First words of the windows that cover n words; no words make one empty window."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of words, row by row; word 0 of the embedding stands for unknown words."""
        w = self.weights
        ids = np.fromiter((self.vocabulary.get(x, 0) for x in words), np.int64, len(words))
        long = [k for k, x in enumerate(words) if len(x) > LONG_WORD]
        means = char_means(w["char"], *grams([x if len(x) <= LONG_WORD else "" for x in words] if long else words))
        for k in long:
            means[k] = long_mean(w["char"], words[k])
        return np.concatenate([w["word"][ids], means], axis=1)

    def scores(self, projected: np.ndarray, types: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of windows. projected: both directions' input gates of each type; types: those of all words in a row, and WINDOW more; first: where each window begins."""
        w, out = self.weights, np.empty(len(first), np.float32)
        order = np.argsort(-lengths, kind="stable")
        for lo in range(0, len(first), LANES):
            at = order[lo : lo + LANES]
            steps, size = types[first[at] + np.arange(WINDOW)[:, None]], lengths[at]
            n, longest = len(at), int(size.max(initial=0))
            full = bool((size == WINDOW).all())
            states = np.zeros((longest, n, 2 * HIDDEN), np.float32)
            for side, times in enumerate((range(longest), range(longest - 1, -1, -1))):
                u, bias = w[f"u{side}"], w[f"bn{side}"]
                part = projected[:, side * 3 * HIDDEN : (side + 1) * 3 * HIDDEN]
                h = np.zeros((n, HIDDEN), np.float32)
                for t in times:
                    x, g = part[steps[t]], h @ u
                    zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                    z = zr[:, :HIDDEN]
                    new = np.tanh(x[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * (g[:, 2 * HIDDEN :] + bias))
                    new += z * (h - new)
                    h = new if full else np.where((t < size)[:, None], new, h)
                    states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
            a = np.tanh(states @ w["aw"] + w["ab"]) @ w["av"]
            if not full:
                a = np.where(np.arange(longest)[:, None] < size, a, -1e9)
            if longest:
                a = np.exp(a - a.max(axis=0))
                a /= a.sum(axis=0)
            pooled = np.einsum("tn,tnd->nd", a, states) * (size > 0)[:, None]
            out[at] = sigmoid(pooled @ w["o"] + w["ob"])
        return out

    def projection(self, vectors: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.concatenate([vectors @ w[f"x{k}"] + w[f"b{k}"] for k in (0, 1)], axis=1).astype(np.float32)


class Numbering(dict):
    """Numbers words in the order in which they are first looked up; fresh lists those since it was last emptied."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Scorer:
    """Scores texts; keeps the input gates of the word types met so far, up to a fixed number."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known, self.table = Numbering(), np.zeros((0, 6 * HIDDEN), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if fresh := self.known.fresh:
            self.table = np.concatenate([self.table, self.net.projection(self.net.inputs(fresh))])
            self.known.fresh = []
        return out

    def window_scores(self, blocks: list[list[str]]) -> list[np.ndarray]:
        """Scores of all windows of each list of words."""
        if len(self.known) > CACHED_TYPES:
            self.clear()
        flat = self.ids([w for own in blocks for w in own])
        starts, lengths, count, base = [], [], [], 0
        for own in blocks:
            firsts = np.arange(windows(len(own)).start, windows(len(own)).stop, STRIDE)
            starts.append(firsts + base)
            lengths.append(np.minimum(WINDOW, len(own) - firsts))
            count.append(len(firsts))
            base += len(own)
        flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
        first = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        size = np.concatenate(lengths) if lengths else first
        out = self.net.scores(self.table, flat, first, size)
        return np.split(out, np.cumsum(count)[:-1]) if count else []

    def text_scores(self, texts: list[str | None]) -> list[float]:
        """The largest window score of each text. Blocks of a text's words are scored together with those of others, bounded numbers of words at a time."""
        out = np.full(len(texts), -1.0)
        blocks: list[list[str]] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            for k, x in zip(owners, self.window_scores(blocks), strict=True):
                out[k] = max(out[k], float(x.max()))
            blocks.clear()
            owners.clear()

        for k, t in enumerate(texts):
            for own in word_blocks(t or ""):
                blocks.append(own)
                owners.append(k)
                size += len(own)
                if size > 250_000:
                    flush()
                    size = 0
        flush()
        return out.tolist()


def word_blocks(text: str) -> Iterator[list[str]]:
    """A text's words in blocks whose windows, taken together, are those of the whole text."""
    found, own = WORD.finditer(text.lower()), []
    while True:
        own += [m[0] for m in islice(found, BLOCK + WINDOW - STRIDE - len(own))]
        yield own
        if len(own) < BLOCK + WINDOW - STRIDE:
            return
        own = own[BLOCK:]
        if (more := next(found, None)) is None:
            return
        own.append(more[0])


def log_odds(seen: np.ndarray, totals: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """Log odds of label 1 of documents with a feature, shrunk to those of all documents. seen: label x feature counts."""
    share = totals / totals.sum()
    rate = (seen + prior * share[:, None]) / (seen.sum(axis=0) + prior)
    return (np.log(rate[1] / share[1]) - np.log(rate[0] / share[0])).astype(np.float32)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions first[i] .. first[i] + count[i] - 1 of all i, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def sums_by(group: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each group."""
    width = rows.shape[1]
    cells = (group[:, None] * width + np.arange(width)).ravel()
    return np.bincount(cells, rows.ravel(), n * width).reshape(n, width).astype(np.float32)


def gradients(net: Network, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean cross-entropy by the weights and by the inputs x (windows x words x features)."""
    w, n, steps = net.weights, len(x), x.shape[1]
    alive = (np.arange(steps)[:, None] < size).astype(np.float32)
    states, kept = np.zeros((steps, n, 2 * HIDDEN), np.float32), {}
    for side, times in enumerate((range(steps), range(steps - 1, -1, -1))):
        h = np.zeros((n, HIDDEN), np.float32)
        gates = x @ w[f"x{side}"] + w[f"b{side}"]
        for t in times:
            g = h @ w[f"u{side}"]
            zr = sigmoid(gates[:, t, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            inner = g[:, 2 * HIDDEN :] + w[f"bn{side}"]
            new = np.tanh(gates[:, t, 2 * HIDDEN :] + zr[:, HIDDEN:] * inner)
            kept[side, t] = h, zr, inner, new
            m = alive[t][:, None]
            h = m * (new + zr[:, :HIDDEN] * (h - new)) + (1 - m) * h
            states[t, :, side * HIDDEN : (side + 1) * HIDDEN] = h
    hidden = np.tanh(states @ w["aw"] + w["ab"])
    e = np.where(alive > 0, hidden @ w["av"], -1e9)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnd->nd", a, states)
    p = sigmoid(pooled @ w["o"] + w["ob"])
    loss = float(-np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-9)))
    out = {k: np.zeros_like(v) for k, v in w.items() if k not in ("word", "char")}
    dlogit = (p - y) / n
    out["o"], out["ob"] = pooled.T @ dlogit, np.array(dlogit.sum(), np.float32)
    dpooled = dlogit[:, None] * w["o"]
    dstates = a[:, :, None] * dpooled
    da = np.einsum("tnd,nd->tn", states, dpooled)
    de = a * (da - (a * da).sum(axis=0))
    out["av"] = np.einsum("tn,tnk->k", de, hidden)
    dpre = de[:, :, None] * w["av"] * (1 - hidden**2)
    out["aw"], out["ab"] = np.einsum("tnd,tnk->dk", states, dpre), dpre.sum(axis=(0, 1))
    dstates += dpre @ w["aw"].T
    dx = np.zeros_like(x)
    for side, times in enumerate((range(steps - 1, -1, -1), range(steps))):
        dh = np.zeros((n, HIDDEN), np.float32)
        for t in times:
            h, zr, inner, new = kept[side, t]
            z, r, m = zr[:, :HIDDEN], zr[:, HIDDEN:], alive[t][:, None]
            dh = dh + dstates[t, :, side * HIDDEN : (side + 1) * HIDDEN]
            live = dh * m
            dn = live * (1 - z) * (1 - new**2)
            dz = live * (h - new) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            dgate, dg = np.concatenate([dz, dr, dn], axis=1), np.concatenate([dz, dr, dn * r], axis=1)
            out[f"bn{side}"] += (dn * r).sum(axis=0)
            out[f"u{side}"] += h.T @ dg
            out[f"x{side}"] += x[:, t].T @ dgate
            out[f"b{side}"] += dgate.sum(axis=0)
            dx[:, t] = dx[:, t] + dgate @ w[f"x{side}"].T
            dh = dh * (1 - m) + live * z + dg @ w[f"u{side}"].T
    return out, dx, loss


def train(texts: list[str], labels: list[int], rounds: int = 4, passes: int = 3, batch: int = 128, rate: float = 0.01, seed: int = 7, mislabelled: float = 0.0) -> Network:
    """Fit a network to texts and their 0/1 labels; without both labels, one that always gives the label seen, or 0.

    The first component of each embedding starts as the log odds of label 1 given the word or n-gram, the rest at random.
    mislabelled: the share of texts of label 1 that a round may leave out because no window of theirs speaks for the label.
    """
    draw, y = np.random.default_rng(seed), np.array(labels, np.float32)
    met = Numbering()
    ids = [np.fromiter((met[m[0]] for m in WORD.finditer(t.lower())), np.int32) for t in texts]
    types = sorted(met)
    place = np.empty(len(types), np.int32)
    place[[met[t] for t in types]] = np.arange(len(types))
    ids = [place[own] for own in ids]
    held = np.zeros(len(types), np.int64)
    for own in ids:
        held[np.unique(own)] += 1
    vocabulary = {t: i + 1 for i, t in enumerate(t for t, n in zip(types, held.tolist(), strict=True) if n >= 4)}
    spread = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"word": 0.05 * draw.normal(size=(len(vocabulary) + 1, WORD_DIM)).astype(np.float32), "char": 0.05 * draw.normal(size=(BUCKETS, CHAR_DIM)).astype(np.float32)}
    for k in (0, 1):
        w |= {f"x{k}": spread(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"b{k}": np.zeros(3 * HIDDEN, np.float32), f"u{k}": spread(HIDDEN, 3 * HIDDEN), f"bn{k}": np.zeros(HIDDEN, np.float32)}
    w |= {"aw": spread(2 * HIDDEN, ATTENTION), "ab": np.zeros(ATTENTION, np.float32), "av": spread(ATTENTION), "o": spread(2 * HIDDEN), "ob": np.zeros((), np.float32)}
    net = Network(vocabulary, w)
    if not len(y) or y.min() == y.max():
        w["o"][:] = 0
        w["ob"] = np.array(30.0 if len(y) and y[0] else -30.0, np.float32)
        return net
    buckets, per_type = grams(types)
    gram_first = np.cumsum(per_type) - per_type
    word_row = np.array([vocabulary.get(t, 0) for t in types])
    totals = np.array([(y == 0).sum(), (y == 1).sum()], float)
    seen_types, seen_grams = np.zeros((2, len(types))), np.zeros((2, BUCKETS))
    for own, label in zip(ids, y.astype(int), strict=True):
        distinct = np.unique(own)
        seen_types[label, distinct] += 1
        seen_grams[label, np.unique(buckets[spans(gram_first[distinct], per_type[distinct])])] += 1
    odds = log_odds(seen_types, totals)
    w["word"][word_row[word_row > 0], 0] = odds[word_row > 0]
    w["char"][:, 0] = log_odds(seen_grams, totals)
    evidence = np.maximum(odds, char_means(w["char"][:, :1], buckets, per_type)[:, 0])

    def vectors(rows: np.ndarray) -> np.ndarray:
        near = buckets[spans(gram_first[rows], per_type[rows])]
        return np.concatenate([w["word"][word_row[rows]], char_means(w["char"], near, per_type[rows])], axis=1)

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    firsts = [np.array(list(windows(len(own)))) for own in ids]
    flat = np.concatenate([*ids, np.zeros(WINDOW, np.int32)])
    base = np.cumsum([0, *map(len, ids)])
    at = np.concatenate([f + b for f, b in zip(firsts, base, strict=False)])
    sizes = np.concatenate([np.minimum(WINDOW, len(i) - f) for i, f in zip(ids, firsts, strict=True)])
    cuts = np.cumsum([len(f) for f in firsts])[:-1]
    step = 0
    for turn in range(rounds):
        if turn:
            value = net.scores(net.projection(vectors(np.arange(len(types)))), flat, at, sizes)
        else:
            value = np.array([evidence[flat[s : s + n]].max(initial=-9) for s, n in zip(at, sizes, strict=True)])
        each = np.split(value, cuts)
        least = min(0.1 if turn else 0.6, float(np.quantile([v.max() for d, v in enumerate(each) if y[d]], mislabelled)))
        picked = []
        for d, v in enumerate(each):
            if len(ids[d]) and (not y[d] or v.max() >= least):
                top = np.argsort(-v, kind="stable")[: 1 if y[d] else 2]
                picked += [(d, firsts[d][k]) for k in top]
                if not y[d]:
                    picked.append((d, draw.choice(firsts[d])))
        for _ in range(passes):
            order = draw.permutation(len(picked))
            for lo in range(0, len(order), batch):
                chosen = [picked[i] for i in order[lo : lo + batch]]
                rows, size = np.zeros((len(chosen), WINDOW), np.int64), np.zeros(len(chosen), np.int64)
                for j, (d, s) in enumerate(chosen):
                    own = ids[d][s : s + WINDOW]
                    rows[j, : len(own)], size[j] = own, len(own)
                used, back = np.unique(rows, return_inverse=True)
                x = vectors(used)[back.reshape(rows.shape)]
                found, dx, _ = gradients(net, x, size, y[[d for d, _ in chosen]])
                by_type = sums_by(back.ravel(), dx.reshape(-1, WORD_DIM + CHAR_DIM), len(used))
                found["word"] = sums_by(word_row[used], by_type[:, :WORD_DIM], len(w["word"]))
                each = np.repeat(by_type[:, WORD_DIM:] / per_type[used, None], per_type[used], axis=0)
                found["char"] = sums_by(buckets[spans(gram_first[used], per_type[used])], each, BUCKETS)
                step += 1
                for k, g in found.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    pace = rate * (0.05 if k in ("word", "char") else 1.0)
                    w[k] -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 2000, longest: int = 20_000, mislabelled: float = 0.0, text: str = "text", label: str = "toxic", doc_id: str = "doc_id") -> Network:
    """A network fitted to at most per_class labelled documents of either label that aren't held out.

    Training takes documents of at most `longest` characters, and of rows that share a doc_id the least text; this and
    per_class bound the sample. One task fits the network to it, so that the driver holds the weights only.
    """
    marks = labels.where(~held_out(doc_id) & F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.max(label).alias("y"))
    chosen = bounded_sample(marks, "y", doc_id, per_class)
    usable = docs.select(F.col(doc_id), F.col(text).alias("t")).where(~held_out(doc_id) & (F.length("t") <= longest))
    rows = usable.join(F.broadcast(chosen), doc_id).groupBy(doc_id).agg(F.min("t").alias("t"), F.min("y").cast("int").alias("y"))
    rows = rows.select(F.col(doc_id).cast("string").alias("d"), "t", "y", F.lit(0).alias("all"))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("d", "ascending"), ("t", "ascending")])
        y = np.array(table["y"].to_pylist())
        used = np.concatenate([np.flatnonzero(y == k)[:per_class] for k in (0, 1)])
        net = train(table["t"].take(pa.array(used)).to_pylist(), y[used].tolist(), mislabelled=mislabelled)
        return pa.table({"net": pa.array([pickle.dumps(net)], pa.binary())})

    fitted = Scratch(docs.sparkSession, "toxicity").table(rows.groupBy("all").applyInArrow(fit, "net binary"), "net").first()
    return pickle.loads(fitted.net) if fitted else train([], [])


def score(docs: DataFrame, net: Network, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a column `into`: 0 to 1, the largest score of all windows of the whole text.

    Null and empty texts, and texts without a word, are one empty window, whose score is the network's bias. Very long texts and
    very long words are scored whole, block by block. Equal texts get equal scores (ties); repeated rows each get theirs; an
    empty table gives an empty one; rows are neither dropped nor joined; a column named `into` is replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.Series(scorer.text_scores([None if t is None else t for t in batch]), dtype="float64")

    return docs.withColumn(into, run(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), net)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
