"""Personal data in whole texts, found plainly and through disguises, with spans in the source text.

Plain spans come from fixed patterns. Disguised ones come from a chain of transducers that rewrite homoglyphs, invisible
characters, spelled digits and at/dot disguises; each transducer carries, for every character that it writes, the
source span it stands for, so that what the same detectors find in the rewritten text maps back to the source.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import free_name

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
Span = tuple[int, int]

# Letters and digits of other scripts that look like Latin ones, and invisible characters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
HOMOGLYPHS |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
for first in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # digits of other scripts and styles
    HOMOGLYPHS |= {chr(first + d): str(d) for d in range(10)}
INVISIBLE = "­​‌‍⁠﻿"
# Digit words of English, French, German and Spanish.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TABLE = str.maketrans(HOMOGLYPHS)
LOOKALIKE = re.compile(f"[{re.escape(''.join(HOMOGLYPHS) + INVISIBLE)}]")
WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
DIGIT_RUN = re.compile(rf"(?i)(?<!\w)(?:plus[ ])?(?:{WORDS})(?:[ ,.-]{{1,2}}(?:{WORDS}|[0-9]|dot|point))*[ ,.-]{{1,2}}(?:{WORDS})(?!\w)")
DIGIT_TOKEN = re.compile(rf"(?i)plus[ ]|{WORDS}|dot|point|[0-9]|[ ,.-]+")
AT, DOT = r"(?:at|arobase|arroba|klammeraffe)", r"(?:dot|point|punkt|punto)"
BRACKETED = re.compile(rf"(?i)[(\[{{<]\s*(?:({AT}|@)|({DOT}|\.))\s*[)\]}}>]\s*")
AT_SIGN = re.compile(rf"(?i)[ ]{AT}(?=[ ])|@")
SPOKEN_DOT = re.compile(rf"(?i)[ ]{DOT}[ ]")
SPOKEN_DOMAIN = re.compile(rf"(?i)[ ]*[A-Za-z0-9-]++(?:(?:[ ]{DOT}[ ]|\.)[A-Za-z0-9-]++)*[ ]{DOT}[ ][A-Za-z]{{2,10}}(?!\w)")
DOT_BEFORE = re.compile(rf"(?i)[ ]{DOT}[ ]$")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping e-mail addresses, walking from one @ to the next so that long runs of letters cost nothing."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    found = ((m.span(), NOT_DIGIT.sub("", m[0])) for m in CARD.finditer(text) if m.end() - m.start() >= 13)
    return [s for s, digits in found if 13 <= len(digits) <= 19 and luhn(digits)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]


DETECTORS: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}
HAS_DIGIT = re.compile("[0-9]")


def detect(text: str) -> dict[str, list[Span]]:
    """Plain spans of each kind."""
    digit = HAS_DIGIT.search(text) is not None
    return {
        "email": emails(text) if "@" in text else [],
        "ip": ips(text) if digit else [],
        "card": cards(text) if digit else [],
        "phone": phones(text) if digit and "+" in text else [],
    }


Change = tuple[int, int, list[tuple[str, int, int]]]  # a range, and the characters in its place, each with the range that it stands for


class Tape:
    """A rewritten text and, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, changes: Iterable[Change]) -> None:
        """Put characters in the place of ranges, which come in order and don't overlap."""
        parts, starts, ends, done = [], [], [], 0
        for first, last, characters in changes:
            parts.append(self.text[done:first])
            starts += self.starts[done:first]
            ends += self.ends[done:first]
            for c, lo, hi in characters:
                parts.append(c)
                starts.append(self.starts[lo])
                ends.append(self.ends[hi - 1])
            done = last
        if done:
            self.text = "".join(parts) + self.text[done:]
            self.starts, self.ends = starts + self.starts[done:], ends + self.ends[done:]

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


# Transducers: each reads a text once and yields its changes; the work of each is in proportion to the text.


def plain_letters(text: str) -> Iterator[Change]:
    """Homoglyphs become the characters that they look like; invisible characters go."""
    for m in LOOKALIKE.finditer(text):
        yield *m.span(), [] if m[0] in INVISIBLE else [(m[0].translate(TABLE), *m.span())]


def spelled_digits(text: str) -> Iterator[Change]:
    """Runs of digit words become digits."""
    for m in DIGIT_RUN.finditer(text):
        out = []
        for t in DIGIT_TOKEN.finditer(text, m.start(), m.end()):
            word = t[0].lower()
            if word in DIGIT_WORDS or word.isdigit():
                out.append((DIGIT_WORDS.get(word, word), *t.span()))
            elif word == "plus ":
                out.append(("+", *t.span()))
            elif word in ("dot", "point"):
                out.append((".", *t.span()))
        yield *m.span(), out


def bracketed(text: str) -> Iterator[Change]:
    """An at or dot in brackets, with the white space around it, becomes the sign."""
    done = 0
    for m in BRACKETED.finditer(text):
        first = m.start()
        while first > done and text[first - 1].isspace():
            first -= 1
        done = m.end()
        yield first, done, [("@" if m[1] else ".", first, done)]


def spoken_address(text: str) -> Iterator[Change]:
    """Addresses whose dots, and maybe whose at, are spelled: from each at the domain is read forward and the local part backward."""
    done = 0  # no part of an address lies before the end of the last one, or of the last at
    for at in AT_SIGN.finditer(text):
        spelled = text[at.start()] == " "
        after = at.end() + spelled
        if at.start() < done:
            continue
        free, done = done, at.end()
        if not (domain := SPOKEN_DOMAIN.match(text, after)):
            continue
        start = at.start()
        while start > free and text[start - 1] == " ":
            start -= 1
        signs = [(start, domain.end() - len(domain[0].lstrip(" ")), "@")]
        end = start
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        if start == end:
            continue
        while (m := DOT_BEFORE.search(text, max(free, start - 7), start)) and m.start() > free and LOCAL.match(text, m.start() - 1):
            signs.append((*m.span(), "."))
            start = m.start()
            while start > free and LOCAL.match(text, start - 1):
                start -= 1
        if start and (text[start - 1].isalnum() or text[start - 1] in "_@"):
            continue
        signs += [(*m.span(), ".") for m in SPOKEN_DOT.finditer(text, domain.start(), domain.end())]
        done, at_ = domain.end(), start
        out = []
        for lo, hi, sign in sorted(signs):
            out += [(text[i], i, i + 1) for i in range(at_, lo)]
            out.append((sign, lo, hi))
            at_ = hi
        yield start, done, out + [(text[i], i, i + 1) for i in range(at_, done)]


#: In this order; a transducer runs only where its hint is found.
TRANSDUCERS = ((LOOKALIKE, plain_letters), (DIGIT_RUN, spelled_digits), (BRACKETED, bracketed), (SPOKEN_DOT, spoken_address))


def disguised(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows: those that no plain span of their kind contains."""
    tape = None
    for hint, transducer in TRANSDUCERS:
        now = tape.text if tape else text
        if hint.search(now):
            tape = tape or Tape(text)
            tape.rewrite(transducer(now))
    if tape is None or tape.text == text:
        return {k: [] for k in KINDS}
    out = {}
    for kind, spans in detect(tape.text).items():
        firsts = [s for s, _ in plain[kind]]
        known = lambda s, e: (k := bisect_right(firsts, s)) and e <= plain[kind][k - 1][1]  # noqa: B023, E731
        out[kind] = [(s, e) for s, e in map(tape.source, spans) if not known(s, e)]
    return out


def listed(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(found[k]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (plain spans), base_sha256, spans (plain and disguised) and n_disguised.

    Offsets are code points of the source, end exclusive. A null text counts as empty: no spans, the hash of the empty
    string. Very long texts are read whole, in time proportional to their length. Equal texts get equal values (ties);
    repeated rows each get theirs; an empty table gives an empty one. Columns of these names, in any case, are replaced,
    all others stay; rows are neither dropped nor joined.
    """
    fields = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_disguised bigint"

    @F.pandas_udf(fields)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                t = t or ""
                plain = detect(t)
                more = disguised(t, plain)
                both = {k: plain[k] + more[k] for k in KINDS}
                rows.append((*(len(plain[k]) for k in KINDS), hashlib.sha256(listed(plain).encode()).hexdigest(), listed(both), sum(map(len, more.values()))))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    names = [f.split()[0] for f in fields.split(", ")]
    kept, found = [c for c in docs.columns if c.lower() not in names], free_name(docs, "found")
    return docs.select(*kept, run(F.col(text)).alias(found)).select(*kept, *(f"{found}.{n}" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).drop("text")
