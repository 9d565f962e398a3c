"""Language identification, toxicity and personal data."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import language_id, pii, toxicity
from turnlake.llm.common import bounded_sample

SF = "/root/testdata/sf0.01"


def lengths_by_search(text, known):
    """Phrases of a text by greedy longest match, found by substring search; an unknown letter ends the phrase that it follows."""
    n = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in known:
            size += 1
        n += 1
        at += size
        if at < len(text) and text[at] not in known:
            at += 1
    return n


def test_phrases_are_greedy_longest_matches_of_whole_texts():
    draw = random.Random(2)
    known = {"a": ["".join(draw.choice("abc ") for _ in range(300))], "b": ["".join(draw.choice("bcd ") for _ in range(300))]}
    parser = language_id.CrossParser(known)
    texts = ["".join(draw.choice("abcd ") for _ in range(draw.randrange(1, 1500))) for _ in range(60)]
    texts += ["", "dddd", known["a"][0] * 40, "d" * 1000, "a" * 255 + "d", "abc" * 512]
    for t, row in zip(texts, parser.phrases(texts), strict=True):
        for lang, n in zip(parser.langs, row, strict=True):
            assert n == lengths_by_search(t, known[lang][0]), t


@pytest.mark.parametrize("piece", ["x", "x ", " ", ". ", "ab", "abc cab", "a" * 300 + "b"])
def test_repeated_texts_are_parsed_in_time_and_exactly(piece):
    """A parse that never forgets where it began: phrases equal a search, and a million characters take little time."""
    draw = random.Random(4)
    known = {"a": ["".join(draw.choice("abcx .") for _ in range(250)), "   . . . ", "ababab"], "b": ["bcd  . x", " " * 7 + "xx"]}
    parser = language_id.CrossParser(known)
    short = "".join(parser_char if parser_char.isalpha() else " " for parser_char in ("q" + piece * 6000)[:6000])
    row = parser.phrases([short, "abc", short[1:]])
    for lang, n, last in zip(parser.langs, row[0], row[2], strict=True):
        plain = "\n".join("".join(c if c.isalpha() else " " for c in t) for t in known[lang])
        assert (n, last) == (lengths_by_search(short, plain), lengths_by_search(short[1:], plain))
    began = time.process_time()
    parser.phrases(["x" + piece * (1_000_000 // len(piece))])
    assert time.process_time() - began < 4


def test_letters_outside_the_alphabet_still_tell_languages_apart():
    draw = random.Random(3)
    script = lambda first, n: "".join(chr(first + draw.randrange(400)) for _ in range(n))
    frequent = "abcdefghijklmnopqrstuvwxyzàâäçéèêëîïôöùûüßñáíóú" * 9
    han, egyptian = [script(0x4E00, 256) for _ in range(40)], [script(0x13000, 256) for _ in range(40)]
    parser = language_id.CrossParser({"fr": [frequent] * 9, "zh": han, "egy": egyptian})
    texts = [frequent[5:90], "".join(han)[100:900], "".join(egyptian)[300:1200]]
    assert parser.predict(texts)[0] == ["fr", "zh", "egy"]


@pytest.mark.parametrize("copies", [1, 100, 5000])
def test_sample_draws_keys_however_often_they_are_repeated(spark, copies):
    keys = 200_000 // copies
    rows = spark.range(keys * copies).select((F.col("id") % keys).alias("k"), F.lit("x").alias("label"), F.lit("t").alias("t"))
    few = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.lit("few").alias("label"), F.lit("t").alias("t"))
    got = {r.label: r["count"] for r in bounded_sample(rows.union(few), "label", "k", 1500).groupBy("label").count().collect()}
    assert got["few"] == 3 and (got["x"] == keys if keys < 1500 else 0.9 * 1.2 * 1500 < got["x"] < 1.3 * 1500)


def test_four_repeated_ids_teach_their_languages(spark):
    texts = [("hello the world and the rest of it", "en"), ("der die das und nicht der rest", "de")]
    docs = spark.range(20_000).select((F.col("id") % 2 * 3 + 1).alias("doc_id"), F.element_at(F.array(*[F.lit(t) for t, _ in texts]), (F.col("id") % 2 + 1).cast("int")).alias("text"), F.element_at(F.array(F.lit("en"), F.lit("de")), (F.col("id") % 2 + 1).cast("int")).alias("lang"))
    assert language_id.learn(docs).langs == ["de", "en"]


def test_language_accuracy_and_split(spark):
    out = language_id.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    unseen = [r for r in out if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in unseen]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate([("hello the world and the rest", "en")] * 30 + [("der die das und nicht", "de")] * 30)], "doc_id bigint, text string, lang string")
    parser = language_id.learn(docs)
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "the rest"), (5, "nicht und" * 20_000), (5, "nicht und" * 20_000), (6, "漢字")]
    df = spark.createDataFrame([(*r, 7, 6) for r in rows], "doc_id bigint, text string, Score int, found int")
    got = [(r.lang_pred, r.score) for r in language_id.identify(df, parser).collect()]
    assert [g for g, _ in got] == ["und", "und", "und", "en", "de", "de", got[6][0]] and got[4] == got[5] and got[6][0] in ("de", "en")
    nothing = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(df.limit(0), parser).count() == 0


def test_gradients_match_differences():
    draw = np.random.default_rng(0)
    net = toxicity.train(["a b c d", "x y z w"] * 6, [0, 1] * 6, rounds=1, passes=1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, size, y = draw.normal(size=(5, 7, toxicity.WORD_DIM + toxicity.CHAR_DIM)), np.array([7, 3, 1, 5, 7]), np.array([1.0, 0, 1, 0, 1])
    found, dx, _ = toxicity.gradients(net, x, size, y)
    for name in ("x0", "u1", "bn0", "b1", "aw", "av", "o"):
        w = net.weights[name]
        at = tuple(draw.integers(0, n) for n in w.shape)
        w[at] += 1e-4
        up = toxicity.gradients(net, x, size, y)[2]
        w[at] -= 2e-4
        down = toxicity.gradients(net, x, size, y)[2]
        w[at] += 1e-4
        assert abs((up - down) / 2e-4 - found[name][at]) < 2e-3, name


def test_toxicity_learns_words_and_stems(spark):
    draw = random.Random(4)
    filler = [f"word{k}" for k in range(200)]

    def text(bad):
        w = [draw.choice(filler) for _ in range(draw.randrange(20, 200))]
        if bad:
            w[draw.randrange(len(w))] = "zorgh" + "".join(draw.choice("abcdef") for _ in range(3))
        return " ".join(w)

    labels = [k % 2 for k in range(600)]
    net = toxicity.train([text(y) for y in labels], labels)
    scorer = toxicity.Scorer(net)
    fresh = [text(k % 2) for k in range(200)]
    got = scorer.text_scores(fresh)
    assert np.mean([(s >= 0.5) == bool(k % 2) for k, s in enumerate(got)]) > 0.97
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, fresh[1], 3), (2, fresh[1], 4), (3, "word1 " * 30_000 + fresh[1], 5)], "doc_id bigint, text string, score int")
    rows = toxicity.score(df, net).collect()
    assert rows[0].score == rows[1].score and rows[2].score == rows[3].score and rows[4].score >= 0.5
    assert toxicity.score(df.limit(0), net).count() == 0


def plain_forward(net, words):
    """Score of one window, word by word."""
    w, h_dim = net.weights, toxicity.HIDDEN
    x = np.array([np.concatenate([w["word"][net.vocabulary.get(t, 0)], w["char"][toxicity.grams([t])[0]].mean(axis=0)]) for t in words], float)
    sig = lambda v: 1 / (1 + np.exp(-v))
    sides = []
    for k, order in ((0, range(len(words))), (1, reversed(range(len(words))))):
        h, states = np.zeros(h_dim), {}
        for t in order:
            i, g = x[t] @ w[f"x{k}"] + w[f"b{k}"], h @ w[f"u{k}"]
            z, r = sig(i[:h_dim] + g[:h_dim]), sig(i[h_dim : 2 * h_dim] + g[h_dim : 2 * h_dim])
            new = np.tanh(i[2 * h_dim :] + r * (g[2 * h_dim :] + w[f"bn{k}"]))
            states[t] = h = z * h + (1 - z) * new
        sides.append(states)
    both = np.array([np.concatenate([sides[0][t], sides[1][t]]) for t in range(len(words))])
    e = np.exp(np.tanh(both @ w["aw"] + w["ab"]) @ w["av"])
    return sig((e / e.sum()) @ both @ w["o"] + w["ob"])


def test_scores_equal_a_plain_forward_pass():
    draw = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 120))) for _ in range(40)]
    net = toxicity.train(texts, [int("w7" in t.split()) for t in texts], rounds=2)
    for t, s in zip(texts, toxicity.Scorer(net).text_scores(texts), strict=True):
        own = t.split()
        assert s == pytest.approx(max(plain_forward(net, own[k : k + toxicity.WINDOW]) for k in toxicity.windows(len(own))), abs=1e-4)


def test_whole_words_and_whole_texts_are_scored(monkeypatch):
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(300))
    spoiled = word[:150] + "zorgh" + word[150:]
    assert set(toxicity.grams([word])[0].tolist()) != set(toxicity.grams([spoiled])[0].tolist())
    table = np.random.default_rng(2).normal(size=(toxicity.BUCKETS, 5)).astype(np.float32)
    for w in (word, "abc", "é" * 1000):
        whole = toxicity.char_means(table, *toxicity.grams([w]))[0]
        monkeypatch.setattr(toxicity, "LONG_WORD", 100)
        assert np.allclose(toxicity.long_mean(table, w), whole, atol=1e-5) or len(w) < 5
        monkeypatch.undo()
    for n in (0, 1, 8, 9, 100, toxicity.BLOCK, toxicity.BLOCK + 8, toxicity.BLOCK + 9, 2 * toxicity.BLOCK + 8, 2 * toxicity.BLOCK + 50):
        seen, at = [], 0
        for block in toxicity.word_blocks("a " * n):
            seen += [(at + k, min(toxicity.WINDOW, len(block) - k)) for k in toxicity.windows(len(block))]
            at += toxicity.BLOCK
        assert seen == [(k, min(toxicity.WINDOW, n - k)) for k in toxicity.windows(n)], n


@pytest.mark.parametrize("labels", [[], [0, 0, 0], [1, 1, 1]])
def test_toxicity_without_both_labels(labels):
    net = toxicity.train(["some text here"] * len(labels), labels)
    (s,) = toxicity.Scorer(net).text_scores(["any"])
    assert s < 0.01 if not labels or labels[0] == 0 else s > 0.99


def test_windows_cover_every_word():
    for n in range(0, 200):
        starts = list(toxicity.windows(n))
        assert starts and set(range(n)) <= {i for s in starts for i in range(s, s + toxicity.WINDOW)}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15],
    }


def test_plain_spans_against_patterns(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    draw = random.Random(6)
    texts += ["".join(draw.choice("ab1.9@-+ (%") for _ in range(draw.randrange(60))) for _ in range(4000)]
    for t in texts:
        assert pii.detect(t) == brute_spans(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com"),
        ("jane at mail dot example dot org", "email", "jane at mail dot example dot org"),
        ("to ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ!", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("user@ex​ample.com", "email", "user@ex​ample.com"),
        ("jоhn@example.com", "email", "jоhn@example.com"),
        ("call plus four nine one seven two three four five six seven", "phone", "plus four nine one seven two three four five six seven"),
        ("at one nine two dot one six eight dot one dot two", "ip", "one nine two dot one six eight dot one dot two"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguises(text, kind, found):
    spans = pii.disguised(text, pii.detect(text))[kind]
    assert found in [text[s:e] for s, e in spans]


def disguise(kind, draw):
    """A random identifier, disguised in one of the ways that the transducers know."""
    words = "zero one two three four five six seven eight nine".split()
    name = lambda: "".join(draw.choice("abcdehkmnoprstuvwxyz") for _ in range(draw.randrange(3, 9)))
    if kind == "email":
        local, domain = [name() for _ in range(draw.randrange(1, 3))], [*(name() for _ in range(draw.randrange(1, 3))), draw.choice(["com", "org", "net", "io"])]
        way = draw.randrange(5)
        if way == 0:
            at, dot = draw.choice(["(at)", " (at) ", "[at]", " { AT } ", "<at>", " ( @ ) "]), draw.choice(["(dot)", " [dot] ", "{DOT}", " (.) ", "."])
            return ".".join(local) + at + dot.join(domain)
        if way == 1:
            return " dot ".join(local) + draw.choice([" at ", " AT ", "@"]) + " dot ".join(domain)
        plain = ".".join(local) + "@" + ".".join(domain)
        if way == 2:
            return "".join(chr(ord(c) + 0xFEE0) for c in plain)
        if way == 3:
            k = draw.randrange(1, len(plain))
            return plain[:k] + draw.choice("\u200b\u200d\u2060") + plain[k:]
        swap = str.maketrans("aeopcx", "аеорсх")
        return plain.translate(swap) if set(plain) & set("aeopcx") else plain.replace("@", "﹫")
    digits = {"phone": "+" + "".join(draw.choice("123456789") for _ in range(draw.randrange(10, 13))), "ip": ".".join(str(draw.randrange(1, 250)) for _ in range(4)), "card": ""}[kind]
    if kind == "card":
        body = "4" + "".join(draw.choice("0123456789") for _ in range(14))
        digits = next(body + str(c) for c in range(10) if pii.luhn(body + str(c)))
    way = draw.randrange(3)
    if way == 0:
        gap = draw.choice([" ", "-", ", "])
        return gap.join(words[int(c)] if c.isdigit() else {"+": "plus", ".": "dot"}[c] for c in digits).replace("plus" + gap, "plus ")
    if way == 1:
        first = draw.choice([0x0660, 0x06F0, 0x0966, 0xFF10, 0x1D7CE])
        return "".join(chr(first + int(c)) if c.isdigit() else c for c in digits)
    k = draw.randrange(3, len(digits))
    return digits[:k] + draw.choice("\u200b\u200c\ufeff") + digits[k:]


def test_recall_and_precision_on_disguises(spark):
    """Identifiers planted, disguised, into the documents of a table; what is found elsewhere counts as wrong."""
    draw, planted, met, wrong = random.Random(11), 0, 0, 0
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").select("text").collect()]
    for t in texts:
        kind, before = draw.choice(pii.KINDS), pii.disguised(t, pii.detect(t))
        wrong += sum(map(len, before.values()))
        hidden = disguise(kind, draw)
        head = t[: draw.randrange(len(t) + 1)] + ". \n"
        spoiled = f"{head}{hidden} \n. {t[len(head) - 3:]}"
        found = pii.disguised(spoiled, pii.detect(spoiled))
        planted += 1
        exact = (len(head), len(head) + len(hidden)) in found[kind]
        met += exact
        wrong += sum(map(len, found.values())) - exact
    assert planted >= 900 and met / planted > 0.98 and met / (met + wrong) > 0.98, (planted, met, wrong)


@pytest.mark.parametrize("text", [" " * 100_000, "a dot b " + "." * 100_000, "( " * 50_000, "(" + " " * 100_000, "one " * 25_000 + "x", "one 1 " * 20_000, "a@" * 50_000, "a at " * 20_000 + "dot com", "a at b" + " dot c" * 16_000, "x" * 100_000 + " at y dot com", "+" + " " * 100_000, "1 " * 50_000, "a.b" * 33_000 + " dot com at"])
def test_time_follows_the_length(text):
    began = time.perf_counter()
    pii.disguised(text, pii.detect(text))
    assert time.perf_counter() - began < 1


def test_plain_prose_is_left_alone():
    for t in ("he came in at one two in the morning, look at example.com", "meet me at the dot", "one, two, three and four", "nine of ten at noon"):
        assert not any(pii.disguised(t, pii.detect(t)).values()), t


def test_scan_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c"), (4, "a" * 200_000 + "@" + "1" * 200_000), (5, "a@b.c"), (5, "a@b.c")]
    df = spark.createDataFrame([(*r, 9, 8) for r in rows], "doc_id bigint, text string, Spans int, found int")
    got = pii.scan(df).collect()
    assert [c.lower() for c in pii.scan(df).columns].count("spans") == 1 and {r.found for r in got} == {8}
    assert [r.n_email for r in got] == [0, 0, 1, 0, 1, 1] and got[2].spans == "email:0:5" and got[0].spans == ""
    assert got[2].base_sha256 == hashlib.sha256(b"email:0:5").hexdigest() and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.scan(df.limit(0)).count() == 0


def test_offsets_map_back(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(200)
    spoiled = docs.withColumn("text", F.concat(F.lit("é​☂ "), "text", F.lit(" bob (at) site (dot) net")))
    for r in pii.scan(spoiled).join(spoiled.withColumnRenamed("text", "t"), "doc_id").collect():
        s, e = map(int, [x for x in r.spans.split(",") if x.startswith("email")][-1].split(":")[1:])
        assert r.t[s:e] == "bob (at) site (dot) net"
