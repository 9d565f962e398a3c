"""Language identification by cross-parsing against suffix automata.

For each language, a suffix automaton of labelled text recognises every substring of that text. A text is
parsed greedily into the longest phrases that the automaton knows; the cross-parsing entropy of the text is its
number of phrases times log2(size of the labelled text), per character. The language that needs fewest such
normalised phrases wins. All texts of a batch are parsed in step, as lanes of numpy arrays over flat transition tables:
segments of long texts run side by side, and run again from the state in which the one before them ended until they are in a
state that they were in before. Where that doesn't come about in a few rounds, as in repeated text, the rest is parsed in order,
so the phrases are always those of the whole text and the time is in proportion to it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import bounded_sample, free_name, held_out

UNDETERMINED = "und"
ALPHABET = 64  # codes 0 pad, 1 anything but letters, 2 .. 17 all other letters by a hash, 18.. the most frequent letters
RARE = 16
SEGMENT = 256  # characters parsed by one lane at a time
EARLY = 48  # characters after which most segments are in the state they were in before
ROUNDS = 4  # of all segments side by side; what still changes is then parsed in order
LANES = 8192
MOST_SLICES = 8192  # labelled slices of all languages together: bounds what is sent to the workers, however many languages there are


class SuffixAutomaton:
    """Smallest automaton of all substrings, built online."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, c: int) -> None:
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        p = self.last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                clone = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = clone
                    p = self.link[p]
                self.link[q] = self.link[cur] = clone
        self.last = cur


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class CrossParser:
    """Automata of all languages as one transition table.

    A cell holds the target's row offset; its lowest bit says that a phrase ended before this character. A character that no
    phrase can begin with ends the phrase that it follows, or is one of its own.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(texts)
        letters = Counter(c for lang in self.langs for t in texts[lang] for c in t.lower() if c.isalpha())
        keep = sorted(letters, key=lambda c: (-letters[c], c))[: ALPHABET - RARE - 2]
        points = np.arange(0x110000)
        is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.codes = np.where(is_letter, 2 + points * 40503 % 65521 % RARE, 1).astype(np.uint8)
        for i, c in enumerate(keep):
            self.codes[ord(c)] = i + RARE + 2
        tables, self.roots, self.sizes, base = [], [], [], 0
        for lang in self.langs:
            automaton, size = SuffixAutomaton(), 0
            for t in texts[lang]:
                for c in (*self.encode(t).tolist(), 0):  # a pad keeps samples apart; no text holds one
                    automaton.add(c)
                    size += 1
            table = np.zeros((len(automaton.next), ALPHABET), np.int64)
            at_root = np.array([automaton.next[0].get(c, 0) for c in range(ALPHABET)]) * ALPHABET
            table[:] = at_root + 1
            for s, go in enumerate(automaton.next):
                for c, to in go.items():
                    table[s, c] = to * ALPHABET
            table[0] = at_root + (at_root == 0)
            table[:, 0] = np.arange(len(table)) * ALPHABET  # behind its end a text stays in its state
            tables.append((table + base).astype(np.int32).ravel())
            self.roots.append(base)
            self.sizes.append(size)
            base += table.size
        if base >= 1 << 31:
            raise ValueError("too much labelled text for one table")
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each whole text (row) by each language (column), an open one at the end included."""
        coded = [self.encode(t) for t in texts]
        lanes = np.array([max(1, -(-len(c) // SEGMENT)) for c in coded])
        owner = np.repeat(np.arange(len(texts)), lanes)
        flat = np.zeros((len(owner), SEGMENT), np.uint8)
        at = 0
        for c, n in zip(coded, lanes, strict=True):
            flat[at : at + n].reshape(-1)[: len(c)] = c
            at += n
        roots = np.array(self.roots, np.int32)[:, None]
        start = np.repeat(roots, len(owner), axis=1)
        end, total = np.zeros_like(start), np.zeros_like(start)
        early, so_far = np.zeros_like(start), np.zeros_like(start)  # state and phrases after the first EARLY characters
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1  # lanes that go on with the text of the one before
        todo = np.arange(len(owner))
        for again in range(ROUNDS):
            for lo in range(0, len(todo), LANES):
                lane = todo[lo : lo + LANES]
                codes = np.ascontiguousarray(flat[lane].T)
                state, count = self.advance(start[:, lane], codes[:EARLY])
                differs = (state != early[:, lane]).any(axis=0) if again else np.ones(len(lane), bool)
                total[:, lane] += count - so_far[:, lane]  # of lanes in the same state as before nothing else changes
                early[:, lane], so_far[:, lane] = state, count
                lane, state, count = lane[differs], state[:, differs], count[:, differs]
                end[:, lane], more = self.advance(state, codes[EARLY:, differs])
                total[:, lane] = count + more
            todo = follows[(start[:, follows] != end[:, follows - 1]).any(axis=0)]
            if not len(todo):
                break
            start[:, todo] = end[:, todo - 1]
        else:
            self.in_order(flat, follows, todo, start, end, total)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        last = np.cumsum(lanes) - 1
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, total[k], len(texts)).astype(np.int64) + (end[k, last] != self.roots[k])
        return out

    def advance(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and ended phrases of all languages (rows) and lanes (columns) after the characters of `codes` (rows)."""
        count = np.zeros_like(state)
        for c in codes:
            go = self.table.take(state + c)
            ended = go & 1
            count += ended
            state = go - ended
        return state, count

    def in_order(self, flat: np.ndarray, follows: np.ndarray, todo: np.ndarray, start: np.ndarray, end: np.ndarray, total: np.ndarray) -> None:
        """Bring the lanes that still began in a wrong state up to date, one after the other, each at most once for a language.

        Texts in which the parse depends on where it began, such as repeated ones, would need a round for each of their
        segments; this takes time in proportion to them.
        """
        table, changed = memoryview(self.table), set(todo.tolist())
        for k in range(len(self.langs)):
            moved = False
            for lane in follows.tolist():
                state = int(end[k, lane - 1])
                if lane not in changed and (not moved or state == start[k, lane]):
                    moved = False
                    continue
                start[k, lane], n = state, 0
                for c in flat[lane].tolist():
                    go = table[state + c]
                    n += go & 1
                    state = go & -2
                moved = state != end[k, lane]
                end[k, lane], total[k, lane] = state, n

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score (its share of the inverse normalised phrase counts) of texts that have letters."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cost = np.maximum(self.phrases(texts), 1) * np.array([math.log2(max(2, n)) for n in self.sizes])
        best = cost.argmin(axis=1)  # ties: the language that sorts first
        weight = 1.0 / cost
        return [self.langs[k] for k in best], (weight[np.arange(len(texts)), best] / weight.sum(axis=1)).tolist()


def learn(docs: DataFrame, samples: int = 160, sample_chars: int = 256, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> CrossParser:
    """Automata of at most `samples` slices of `sample_chars` characters for each language of the rows that aren't held out.

    Slices are of texts drawn by a hash of doc_id; languages beyond MOST_SLICES / samples share that number evenly. These
    bounds on the labelled text are the only ones: prediction covers all rows and whole texts. Rows with a null or empty
    text or language teach nothing; of rows that share a doc_id the least text is taken; a table without labels gives a
    parser without languages.
    """
    usable = docs.select(doc_id, text, lang).where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    start = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - sample_chars, F.lit(1))).cast("int") + 1
    slices = bounded_sample(usable, lang, doc_id, samples).select(F.col(doc_id).alias("d"), F.col(lang).alias("g"), F.substring(F.col(text), start, F.lit(sample_chars)).alias("t"))
    rows = sorted(slices.collect(), key=lambda r: (r.g, r.d is not None, r.d, r.t))
    samples = max(1, min(samples, MOST_SLICES // max(1, len({r.g for r in rows}))))
    texts: dict[str, list[str]] = {}
    for r in rows:
        if len(own := texts.setdefault(r.g, [])) < samples:
            own.append(r.t)
    return CrossParser(texts)


def identify(docs: DataFrame, parser: CrossParser, text: str = "text") -> DataFrame:
    """docs with lang_pred and score.

    Null text, empty text and text without a letter give `und` and 0.0; so does a parser that learned no language. Very long
    texts are parsed whole. Ties go to the language that sorts first. Equal texts get equal values; repeated rows each get
    theirs; an empty table gives an empty one. Columns named lang_pred and score are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            pred, score = [UNDETERMINED] * len(batch), [0.0] * len(batch)
            todo: list[int] = []
            size = 0

            def flush() -> None:
                for i, g, s in zip(todo, *model.predict([batch.iat[i] for i in todo]), strict=True):
                    pred[i], score[i] = g, s
                todo.clear()

            for i, t in enumerate(batch):
                if has_letter(t):
                    todo.append(i)
                    size += len(t)
                    if size > 4_000_000:  # keeps a worker's arrays small
                        flush()
                        size = 0
            if todo:
                flush()
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    kept, found = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")], free_name(docs, "found")
    return docs.select(*kept, run(F.col(text)).alias(found)).select(*kept, f"{found}.lang_pred", f"{found}.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), learn(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
