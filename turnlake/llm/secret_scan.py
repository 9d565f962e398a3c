"""Secrets in text: candidate strings, and a random forest that removes false findings.

Candidates are runs of key characters that hold a digit or mixed case, every value assigned to a name that secrets have, every key in
a provider's format and every private-key block. The forest weighs their length, character classes and transitions, how much of
them dictionary words cover, the path of the file and the words beside them, which include the name that a value is assigned
to. It is fitted to labelled findings. Where a caller has none, provider formats and assignments stand for true ones and
addresses and bare numbers for false ones: then the forest carries a rule over words and shapes to candidates that the rule doesn't
label, and agreement with that rule says nothing about true secrets. Everything is DataFrame functions and JVM-side transformers.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import Scratch, bounded_sample, held_out

LEAST_LENGTH = 10
RUN = r"[A-Za-z0-9_+/=.@~-]{10,}"
MIXED = r"^[^=]*[a-z][A-Z][^=]*[a-z][A-Z][^=]*=*$"  # in runs of 16 or more characters without a digit
# Names that secrets are assigned to.
NAMES = "token|secret|passw|pwd|api_?key|apikey|access_?key|auth|bearer|credential|private_?key|client_?key"
# Formats of keys of public providers.
PROVIDERS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35})$"
KEY = r"(?<![A-Za-z0-9])(?:" + PROVIDERS[2:-2] + ")(?![A-Za-z0-9])"
# A name that secrets have, up to the end of what belongs to it; an operator; both at the end of a word; both with a value in one word.
NAME = rf"(?i)(?:{NAMES})(?:(?!{NAMES})[^\s=:])*+"
OPERATOR = "(?:[=:]++>?+)"
NAME_ENDS, ASSIGNS = NAME + "$", NAME + OPERATOR + "[\"'`]*$"
WITHIN = NAME + OPERATOR + r"(?=(\S+))"
SCHEME = r"(?i)^[\"'`]?(?:bearer|basic|token)$"  # stands between the name and the value in headers
QUOTES = ("\"", "'", "`")
BEGINS, ENDS, KEY_BLOCK = "-----BEGIN", "-----END", r"(?s)^-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*-----END$"
FEATURES = ["length", "digits", "lowers", "uppers", "others", "up", "down", "to_digit", "from_digit", "distinct", "alternation", "coverage", "path_depth", "before_length", "after_length"]
CONTEXT_BUCKETS = 128  # for words beside the candidate and parts of its path


def bare(value: Column) -> Column:
    """A value without the quotes around it, or without separators behind it."""
    quoted = F.regexp_extract(value, r"^([\"'`])(.+?)\1", 2)
    return F.when(quoted != "", quoted).otherwise(F.regexp_replace(value, r"^[\"'`]+|[\"'`,;]+$", ""))


def continuations(text: Column, pattern: str) -> Column:
    """For each word of split(text), what group 1 of the pattern gives for it, with single spaces; the pattern matches every word once."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    lead = F.when(text.rlike(r"^\s"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(lead, F.transform(found, lambda t: F.regexp_replace(t, r"\s+", " ")))


def closings(text: Column, quote: str) -> Column:
    """For each word with an open quote at its begin or behind an operator, the text from there to the closing quote.

    Such a look ahead ends at the next quote of the kind, and the next one begins there at the earliest: together they read a text once.
    """
    pattern = rf"(?:\S*[=:>])?{quote}[^\s{quote}]*+(?=(\s[^{quote}]*+{quote}))|\S++"
    return F.when(text.contains(quote), continuations(text, pattern))


def key_blocks(text: Column) -> Column:
    """For each word that begins a key block, the words after it up to the end mark; a block that another one begins in isn't one."""
    marked = F.replace(F.replace(F.translate(text, "\u0002\u0003", "??"), F.lit(BEGINS), F.lit("\u0002" + BEGINS)), F.lit(ENDS), F.lit("\u0003" + ENDS))
    pattern = rf"\x02{BEGINS}(?=(\s[^\x02\x03]*+\x03{ENDS})(?!\S))|\S++"
    return F.when(text.contains(BEGINS), F.transform(continuations(marked, pattern), lambda t: F.translate(t, "\u0003", "")))


def assigned_values(w: Column, i: Column, close: dict[str, Column]) -> Column:
    """The values that begin in word i of w and are assigned to a name of NAMES, in this word or in the two before it.

    A quoted value goes on to its closing quote, over as many words as that takes: close has the rest by the quote.
    """
    at = lambda k: F.coalesce(F.get(w, i + k), F.lit(""))
    word, none = F.get(w, i), F.array().cast("array<string>")
    within = F.when(word.rlike("[=:]"), F.regexp_extract_all(word, F.lit(WITHIN), F.lit(1))).otherwise(none)
    operator = lambda k: at(k).rlike(f"^{OPERATOR}[\"'`]*$")
    direct = (at(-1).rlike("[=:]") & at(-1).rlike(ASSIGNS)) | (operator(-1) & at(-2).rlike(NAME_ENDS))
    schemed = at(-1).rlike(SCHEME) & ((at(-2).rlike("[=:]") & at(-2).rlike(ASSIGNS)) | (operator(-2) & at(-3).rlike(NAME_ENDS)))
    behind = word.rlike(f"^{OPERATOR}.") & at(-1).rlike(NAME_ENDS)
    beside = F.when((direct | schemed) & ~operator(0), F.array(word)).when(behind, F.array(F.regexp_replace(word, f"^{OPERATOR}", ""))).otherwise(none)
    values = F.concat(within, beside)
    open_ = lambda v: v.rlike("^([\"'`])(?!.*\\1)")

    def whole(v: Column) -> Column:
        more = F.lit("")
        for q, c in close.items():
            more = F.when(v.startswith(q), F.coalesce(F.get(c, i), F.lit(""))).otherwise(more)
        return F.regexp_extract(F.concat(v, more), r"^([\"'`])(.+?)\1", 2)

    return F.filter(F.concat(F.transform(values, bare), F.transform(F.filter(values, open_), whole)), lambda v: v != "")


def key_block(blocks: Column, i: Column) -> Column:
    """The private-key block that begins in word i, up to the next end mark, its words joined by spaces; else no value."""
    block = F.concat(F.lit(BEGINS), F.get(blocks, i))
    return F.when(block.rlike(KEY_BLOCK), F.array(block)).otherwise(F.array().cast("array<string>"))


def candidates(docs: DataFrame, path: Column | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each candidate: doc_id, word (its first word's number in the text), part (its number in the word: runs first, then other values, keys and blocks), candidate, the word around it, the two words before and the one after, and the path."""
    own = F.coalesce(F.col(text), F.lit(""))
    close = {q: f"close{k}" for k, q in enumerate(QUOTES)}
    words = docs.select(
        F.col(doc_id).alias("doc_id"), (F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))).alias("path"), F.split(own, r"\s+").alias("w"),
        *[closings(own, q).alias(c) for q, c in close.items()], key_blocks(own).alias("blocks"),
    )
    closing = {q: F.col(c) for q, c in close.items()}
    none = F.array().cast("array<string>")
    at = lambda i, k: F.coalesce(F.get("w", i + k), F.lit(""))
    operator = lambda x: x.contains("=") | x.contains(":")
    near_operator = lambda i: operator(F.get("w", i)) | operator(at(i, -1)) | operator(at(i, -2))
    run = lambda x: (F.length(x) >= LEAST_LENGTH) & (x.rlike("[0-9]") | ((F.length(x) >= 16) & x.rlike(MIXED)))
    # nothing shorter is a run, a key in a provider's format or the first word of a key block
    long = lambda x: (F.length(x) >= LEAST_LENGTH) & (x.rlike("[0-9]") | x.endswith(BEGINS) | ((F.length(x) >= 16) & x.rlike(MIXED)) | x.rlike(KEY))
    likely = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: long(F.get("w", i)) | near_operator(i))
    named = lambda i: F.when(near_operator(i), assigned_values(F.col("w"), i, closing)).otherwise(none)
    block = lambda i: F.when(F.get("w", i) == BEGINS, key_block(F.col("blocks"), i)).otherwise(none)
    beside = F.transform(likely, lambda i: F.struct(i.alias("word"), F.get("w", i).alias("around"), at(i, -2).alias("before2"), at(i, -1).alias("before"), at(i, 1).alias("after"), F.concat(named(i), block(i)).alias("values")))
    near = words.select("doc_id", "path", F.explode(beside).alias("x")).select("doc_id", "path", "x.*")
    runs, sure = F.regexp_extract_all("around", F.lit(RUN), F.lit(0)), F.concat("values", F.regexp_extract_all("around", F.lit(KEY), F.lit(0)))
    near = near.select("*", runs.alias("runs"), sure.alias("sure"))
    found = near.select("*", F.posexplode(F.concat("runs", F.array_except("sure", "runs"))).alias("part", "candidate"))
    return found.where(run(F.col("candidate")) | F.array_contains("sure", F.col("candidate"))).drop("values", "runs", "sure")


def common_words(docs: DataFrame, n: int = 1500, text: str = "text") -> list[str]:
    """A dictionary: of the words of 3 to 15 letters the n that most texts hold, counted over all whole texts; ties go to the smaller word."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\p{L})\p{L}{3,15}(?!\p{L})"), F.lit(0)))).alias("w"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(n).collect()]


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """found with `made`, the numbers of FEATURES, and `context`, the lower-cased words beside the candidate and the parts of its path.

    Coverage is the share of letters that words of the dictionary of four or more letters cover, the longest first.
    """
    c, around = F.col("candidate"), F.col("around")
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    known = "|".join(sorted((w for w in dictionary if len(w) >= 4), key=lambda w: (-len(w), w)))
    left = F.length(F.regexp_replace(F.lower(c), known, "")) if known else n
    name = F.when(around.rlike("[=:]"), F.regexp_extract(around, "^[^=:]*", 0)).otherwise("")
    before = F.concat_ws(" ", "before2", "before", name)
    made = {
        "length": n,
        "digits": share("[0-9]"),
        "lowers": share("[a-z]"),
        "uppers": share("[A-Z]"),
        "others": share("[^A-Za-z0-9]"),
        "up": share("(?<=[a-z])[A-Z]"),
        "down": share("(?<=[A-Z])[a-z]"),
        "to_digit": share("(?<=[A-Za-z])[0-9]"),
        "from_digit": share("(?<=[0-9])[A-Za-z]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "alternation": share("(?i)[aeiou](?=[b-df-hj-np-tv-z])"),
        "coverage": (n - left) / n,
        "path_depth": F.regexp_count("path", F.lit("/")),
        "before_length": F.length("before"),
        "after_length": F.length("after"),
    }
    words = lambda text, mark: F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), ""), lambda w: F.concat(F.lit(mark), w))
    context = F.concat(words(before, "before "), words(F.col("after"), "after "), words(F.col("path"), "path "))
    return found.withColumns({"made": F.array(*[F.coalesce(made[k].cast("double"), F.lit(0.0)) for k in FEATURES]), "context": F.coalesce(context, F.array().cast("array<string>"))})


def vectors(df: DataFrame) -> DataFrame:
    """df with `features`: made and the hashed context."""
    hashed = HashingTF(inputCol="context", outputCol="hashed", numFeatures=CONTEXT_BUCKETS, binary=True).transform(df)
    wide = hashed.withColumns({k: F.col("made")[i] for i, k in enumerate(FEATURES)})
    return VectorAssembler(inputCols=[*FEATURES, "hashed"], outputCol="features").transform(wide).drop("hashed", *FEATURES)


def presumed(found: DataFrame) -> Column:
    """A label from fixed formats: 1.0 for provider formats and assignments to secret names, 0.0 for addresses and numbers, else null."""
    c = F.col("candidate")
    address = c.contains("@") | c.rlike(r"^[0-9.+/~=-]+$") | c.rlike(r"^(https?:)?//|^www\.")
    assigned = F.col("before").rlike("[=:]$") & F.lower(F.concat_ws(" ", "before2", "before")).rlike(NAMES)
    return F.when(c.rlike(PROVIDERS), 1.0).when(address, 0.0).when(assigned, 1.0)


def scan(docs: DataFrame, findings: DataFrame | None = None, path: Column | None = None, per_label: int = 3000, threshold: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Candidates of whole texts with score (0 to 1) and secret (score >= threshold).

    Columns: doc_id, word, part, candidate, score, secret; other columns of docs, whatever their names, play no part. findings
    holds labelled ones: the columns of candidates() and label (1.0 or 0.0, else ignored); by default the candidates of
    documents that aren't held out which presumed() can label. The forest is fitted to about per_label different ones of each
    label; this bound holds for fitting alone. With findings of one label only, or none, every candidate gets that label's
    score, or 0.5. Null and empty texts have no candidates, and an empty table gives no rows; very long texts are scanned
    whole; a null path counts as empty. Equal candidates beside equal words get equal scores (ties); equal rows each give
    their own.
    """
    scratch = Scratch(docs.sparkSession, "secret-scan")
    found = scratch.table(candidates(docs, path, text, doc_id), "candidates")
    dictionary = common_words(docs.select(F.col(text).alias("text")))
    known = findings if findings is not None else found.where(~held_out()).withColumn("label", presumed(found))
    known = known.where(F.col("label").isin(0.0, 1.0)).select("candidate", "around", "before2", "before", "after", "path", F.col("label").cast("double").alias("label"))
    known = known.withColumn("key", F.concat_ws("\u0001", "candidate", "before", "after", "path"))
    sample = bounded_sample(known, "label", "key", per_label)
    training = scratch.table(with_features(sample, dictionary).select("made", "context", "label", "key").orderBy("key", "label").coalesce(1), "training")
    labels = [r.label for r in training.select("label").distinct().collect()]
    ready = with_features(found, dictionary)
    if len(labels) < 2:
        scored = ready.withColumn("score", F.lit(float(labels[0]) if labels else 0.5))
    else:
        forest = RandomForestClassifier(numTrees=40, maxDepth=8, seed=11, probabilityCol="probability").fit(vectors(training))
        scored = forest.transform(vectors(ready)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word", "part", "candidate", "score", (F.col("score") >= threshold).alias("secret"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs.select("doc_id", "text", "source"), path=F.col("source"))
    return found.select("doc_id", F.col("word").cast("long").alias("word"), F.col("part").cast("long").alias("part"), F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")
