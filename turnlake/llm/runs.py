"""Periodic runs of words, found on a grammar.

The words of each text are numbered and compressed by Re-Pair: the most frequent pair of neighbouring symbols becomes a
nonterminal, again and again, until no pair occurs twice; a balanced tree stands over the symbols that are left. A run lies inside
the lowest node that covers it and crosses that node's inner boundary. So the runs that cross each nonterminal's boundary are
computed once, on one occurrence, and translated to every position that derives from it; what touches the end of a nonterminal
goes on in a node above, and merging intervals of one period leaves the maximal ones.

Many texts share the arrays of one block: a round replaces in all of them every pair that beats the pairs it overlaps, by its
count in its own text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.common import free_name

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
BLOCK = 400_000  # words worked on together; a longer text is a block of its own
CANDIDATES = 2_000_000  # boundaries times periods looked at together
RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
MADE = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
SPACE = r"[\x20\x09-\x0D]+"
PRIMES, BASES = ((1 << 31) - 1, (1 << 31) - 19), (1_103_515_245, 362_436_069)
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # first word, end, period


@dataclass
class Grammar:
    """Nodes by one occurrence each: start, split (the inner boundary), stop. The first ones are the nonterminals; rule and at say
    which of them derives the text from which position on, for all positions. The nodes of the tree occur once."""

    start: np.ndarray
    split: np.ndarray
    stop: np.ndarray
    rule: np.ndarray
    at: np.ndarray


def chosen(prio: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Which pairs are replaced in a round: those of a higher priority than both pairs they overlap, and every second of equal ones.

    link[k] says that pair k and pair k + 1 share a symbol; equal priorities mean equal pairs.
    """
    n = len(prio)
    same = np.zeros(n, bool)
    same[1:] = link & (prio[1:] == prio[:-1])
    first = np.flatnonzero(~same)
    last = np.append(first[1:], n) - 1
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:], after[:-1] = np.where(link, prio[:-1], 0), np.where(link, prio[1:], 0)
    wins = (before[first] < prio[first]) & (after[last] < prio[last])
    size = last - first + 1
    return np.repeat(wins, size) & ((np.arange(n) - np.repeat(first, size)) % 2 == 0)


def re_pair(ids: np.ndarray, ends: np.ndarray) -> Grammar:
    """The grammar of texts whose word numbers stand one after another, each text with numbers of its own; ends are where texts end."""
    n = len(ids)
    sym, follow, before = ids.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
    closes = np.zeros(n + 1, bool)  # a text ends in front of this position
    closes[ends] = True
    head = np.ones(n, bool)  # a symbol begins here
    symbols, nodes, rules, places, size = int(ids.max(initial=-1)) + 1, [], [], [], 0
    live = np.flatnonzero(~closes[1:])
    while len(live):
        key = sym[live] * symbols + sym[follow[live]]
        slot = (key * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF) >> 41
        often = np.bincount(slot, minlength=1 << 22)[slot] > 1 if len(live) > 1 << 16 else np.ones(len(live), bool)
        live, key = live[often], key[often]
        _, pair, count = np.unique(key, return_inverse=True, return_counts=True)
        often = count[pair] > 1  # a pair that occurs once never occurs again
        live, pair = live[often], pair[often]
        if not len(live):
            break
        bits = int(len(count)).bit_length()
        prio = (count[pair] << bits) | (pair * 0x5BD1E995 & ((1 << bits) - 1))  # ties by a mixed number: no chains along the text
        take = chosen(prio, follow[live[:-1]] == live[1:])
        at, second = live[take], follow[live[take]]
        stop = follow[second]
        _, one, number = np.unique(pair[take], return_index=True, return_inverse=True)
        nodes.append((at[one], second[one], stop[one]))
        rules.append(size + number)
        places.append(at)
        size += len(one)
        sym[at], follow[at], head[second] = symbols + number, stop, False
        inner = ~closes[stop]
        before[stop[inner]] = at[inner]
        symbols += len(one)
        again = np.zeros(n, bool)
        again[live] = again[at] = True
        left = at[at > 0]
        again[before[left[~closes[left]]]] = True
        live = np.flatnonzero(again & head)
        live = live[~closes[follow[live]]]
    level, begins = np.flatnonzero(head), np.append(0, ends[:-1])
    while len(level):
        number = np.arange(len(level))
        number -= number[np.searchsorted(level, begins)][np.searchsorted(begins, level, "right") - 1]
        even = number % 2 == 0
        at, second = level[even], follow[level[even]]
        two = ~closes[second]
        nodes.append((at[two], second[two], follow[second[two]]))
        follow[at[two]] = follow[second[two]]
        level = at if two.any() else at[:0]
    empty = np.zeros(0, np.int64)
    start, split, stop = (np.concatenate([empty, *(x[k] for x in nodes)]) for k in range(3))
    return Grammar(start, split, stop, np.concatenate([empty, *rules]), np.concatenate([empty, *places]))


class Prefixes:
    """Equality of stretches by two polynomial sums of the words before each position."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for p, b in zip(PRIMES, BASES, strict=True):
            power = np.ones(1, np.uint64)
            while len(power) < len(ids):
                power = np.concatenate([power, power * np.uint64(pow(b, len(power), p)) % np.uint64(p)])
            power = power[: len(ids)]
            word = ((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(34)) + np.uint64(1)
            self.sums.append(np.append(np.uint64(0), np.cumsum(word * power % np.uint64(p)) % np.uint64(p)))
            self.powers.append(power)

    def equal(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether k words from i and from j on are the same, i < j."""
        out = np.ones(len(i), bool)
        for p, sums, power in zip(PRIMES, self.sums, self.powers, strict=True):
            m = np.uint64(p)
            out &= (sums[i + k] + m - sums[i]) % m * power[j - i] % m == (sums[j + k] + m - sums[j]) % m
        return out

    def extent(self, i: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The largest k up to `most` for which k words before (or from) i equal those q later."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            at = i - mid if back else i
            same = self.equal(at, at + q, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def crossing(ids: np.ndarray, sums: Prefixes, g: Grammar, lo: int, hi: int) -> tuple[np.ndarray, Runs]:
    """Node numbers and intervals, within their nodes, of the runs that cross the boundaries of nodes lo .. hi - 1.

    A run of LEAST_EXPONENT or more periods has two of them whole on one side of the boundary, so words beside it repeat
    one period on, or one period back.
    """
    start, split, stop = g.start[lo:hi], g.split[lo:hi], g.stop[lo:hi]
    periods = (stop - start) // LEAST_EXPONENT
    periods[stop - start < LEAST_LENGTH] = 0
    node = np.repeat(np.arange(hi - lo), periods)
    q = np.arange(1, len(node) + 1) - np.repeat(np.cumsum(periods) - periods, periods)
    found = []
    for right in (True, False):
        k, p = node, q
        for a, b in ((lambda b, p: b, lambda b, p: b + p), (lambda b, p: b - 1, lambda b, p: b - 1 + p), (lambda b, p: b + p - 1, lambda b, p: b + 2 * p - 1)) if right else ((lambda b, p: b - 1, lambda b, p: b - 1 - p), (lambda b, p: b, lambda b, p: b - p), (lambda b, p: b - p, lambda b, p: b - 2 * p)):
            inside = (split[k] + 2 * p <= stop[k]) if right else (split[k] - 2 * p >= start[k])
            k, p = k[inside], p[inside]
            same = ids[a(split[k], p)] == ids[b(split[k], p)]
            k, p = k[same], p[same]
        anchor = split[k] - 1 if right else split[k] - p
        from_ = anchor - sums.extent(anchor, p, anchor - start[k], True)
        to = anchor + sums.extent(anchor, p, stop[k] - p - anchor, False) + p
        long = to - from_ >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * p)
        found.append((k[long] + lo, from_[long], to[long], p[long]))
    k, s, e, p = (np.concatenate([a, b]) for a, b in zip(*found, strict=True))
    order = np.lexsort((p, e, s, k))
    k, s, e, p = k[order], s[order], e[order], p[order]
    fresh = np.ones(len(k), bool)  # an interval of a period has all multiples of it too
    fresh[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return k[fresh], (s[fresh], e[fresh], p[fresh])


def translated(g: Grammar, node: np.ndarray, runs: Runs) -> Runs:
    """The intervals at every position that their nodes derive."""
    s, e, q = runs
    rule = np.zeros(len(g.start), bool)
    rule[g.rule] = True
    once = ~rule[node]
    wanted = np.zeros(len(g.start), bool)
    wanted[node] = True
    mine = wanted[g.rule]
    of, at = g.rule[mine], g.at[mine]
    order = np.argsort(of, kind="stable")
    of, at = of[order], at[order]
    lo, hi = np.searchsorted(of, node), np.searchsorted(of, node, "right")
    times = np.where(once, 0, hi - lo)
    which = np.repeat(np.arange(len(node)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    shift = at[lo[which] + nth] - g.start[node[which]]
    return np.concatenate([s[once], s[which] + shift]), np.concatenate([e[once], e[which] + shift]), np.concatenate([q[once], q[which]])


def merged(runs: Runs) -> Runs:
    """Intervals of one period that share at least a period become one; sorted by start, then period."""
    s, e, q = runs
    if not len(s):
        return runs
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    step = np.append(0, np.cumsum(q[1:] != q[:-1])) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(e + step)
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] + q[1:] + step[1:] > reach[:-1]) | (step[1:] != step[:-1])
    first = np.flatnonzero(fresh)
    s, q, e = s[first], q[first], (reach - step)[np.append(first[1:], len(reach)) - 1]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def plain_runs(ids: np.ndarray) -> Runs:
    """The same, period by period: what a collision of both sums falls back to."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // LEAST_EXPONENT + 1):
        edge = np.diff(np.concatenate([[0], (ids[q:] == ids[:-q]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if e + q - s >= max(LEAST_LENGTH, LEAST_EXPONENT * q):
                found.setdefault((s, e + q), q)
    rows = sorted((s, q, e) for (s, e), q in found.items())
    s, q, e = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    return s, e, q


def block_runs(ids: np.ndarray, ends: np.ndarray) -> Runs:
    """All runs of the texts of one block."""
    if not len(ids):
        return (np.zeros(0, np.int64),) * 3
    g = re_pair(ids, ends)
    sums, found = Prefixes(ids), []
    work = np.cumsum((g.stop - g.start) // LEAST_EXPONENT)
    lo = 0
    while lo < len(work):
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + CANDIDATES, "right")))
        found.append(translated(g, *crossing(ids, sums, g, lo, hi)))
        lo = hi
    s, e, q = merged(tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3)))
    if all(np.array_equal(ids[a : b - p], ids[a + p : b]) for a, b, p in zip(s.tolist(), e.tolist(), q.tolist(), strict=True)):
        return s, e, q
    parts = [(plain_runs(ids[a:b]), a) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]
    return tuple(np.concatenate([r[k] + (a if k < 2 else 0) for r, a in parts]) for k in range(3))


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers, each text's own, and the ends of the texts."""
    ids, base = np.empty(sum(map(len, texts)), np.int64), 0
    ends = np.cumsum([len(t) for t in texts])
    for words, end in zip(texts, ends.tolist(), strict=True):
        known: dict[bytes, int] = defaultdict()
        known.default_factory = lambda known=known, base=base: base + len(known)
        ids[end - len(words) : end] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        base += len(known)
    return ids, ends


def runs_of(texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text, given as words, its runs (start, length, period) and the words that stay when each run keeps one period."""
    full = [t for t in texts if t]
    ids, ends = numbered(full)
    s, e, q = block_runs(ids, ends)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, s + q, 1)
    np.add.at(cover, e, -1)
    keep = np.cumsum(cover)[:-1] == 0
    of = np.searchsorted(ends, s, "right")
    lows = np.searchsorted(of, np.arange(len(full) + 1)).tolist()
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    local = list(zip((s - begins[of]).tolist(), (e - s).tolist(), q.tolist(), strict=True)) if len(s) else []
    out = []
    for k, (words, b, end) in enumerate(zip(full, begins.tolist(), ends.tolist(), strict=True)):
        mine = local[lows[k] : lows[k + 1]]
        out.append((mine, b" ".join(w for w, stays in zip(words, keep[b:end].tolist(), strict=True) if stays) if mine else b" ".join(words)))
    done = iter(out)
    return [next(done) if t else ([], b"") for t in texts]


def in_blocks(texts: list[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """The texts, in order, in lists of at most BLOCK words or one text."""
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, runs (start, length and period in words, by start, then period) and collapsed.

    Words are what ASCII white space parts. A run is a stretch of at least LEAST_LENGTH words and LEAST_EXPONENT times its smallest
    period that no neighbouring word extends; collapsed joins by one space the words that no run contains after its
    first period. Null, empty and blank texts have no words, no runs and an empty collapsed text. Very long texts are worked on
    whole, in memory in proportion to their words. Equal texts and repeated rows get equal values, each row its own; runs may
    overlap, and of two that start together (a tie) the one of the smaller period comes first. An empty table gives an empty
    one; columns named like the three, in any case, are replaced, all others stay.
    """
    made = [f.name for f in MADE]
    kept = [c for c in docs.columns if c.lower() not in made]
    own = free_name(docs, "words_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            rows = [r for block in in_blocks(texts) for r in runs_of(block)]
            runs = pa.array([[dict(zip(RUN.names, x, strict=True)) for x in r] for r, _ in rows], kind)
            columns = [*batch.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), runs, pa.array([c for _, c in rows], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *made])

    source = docs.select(*kept, F.col(text).cast("string").alias(own))
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], *MADE]))


def planted(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text of the contract: for a tenth of the ids, from some word on, a stretch of its words repeats to the end."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeating(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        stretch = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        return F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(F.flatten(F.array_repeat(stretch, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int")))

    words = F.array_remove(F.split(F.col(text), SPACE), "")
    again = F.get(F.transform(F.array(words), lambda w: F.array_join(repeating(w), " ")), 0)  # splits once
    return F.when((h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), again).otherwise(F.col(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted().alias("text"))
    found = with_runs(docs)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[f].cast("string") for f in RUN.names)), F.lit("\n")))
    found = found.withColumn("best", longest)
    length, period = -F.col("best.k"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words",
    )
