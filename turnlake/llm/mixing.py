"""Mixing a corpus to target weights, with soft membership of documents in domains.

A multinomial logistic regression fitted to a labelled table gives every document a posterior over the domains. Rates of
documents are the nonnegative least-squares solution nearest to 1 whose expected tokens of each domain match the targets:
a distributed projected gradient, preconditioned by the domains' Gram matrix, in which one pass over the documents sums
what the rates give each domain. Everything is DataFrame functions and JVM-side transformers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import Scratch, bounded_sample, free_name

BUCKETS = 4096
TARGETS = {"high": 0.95, "low": 0.05}


def quality_domain() -> Column:
    """The domain that the labels table gives a document: by its quality mark."""
    return F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")


def measured(docs: DataFrame, text: str, words: str, shape: str, tokens: str) -> DataFrame:
    """docs with its lower-cased words, the number of its tokens, and shares that tell how its text is made."""
    body = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.withColumn(words, F.array_remove(F.split(F.lower(body), r"\s+"), ""))
    size = F.greatest(F.length(body), F.lit(1)).cast("double")
    n = F.size(words)
    few = F.greatest(n, F.lit(1)).cast("double")
    shares = [
        F.log1p(n.cast("double")),
        F.size(F.array_distinct(words)) / few,
        F.length(F.regexp_replace(body, r"[^|*$%&#!=]+", "")) / size,
        F.length(F.regexp_replace(body, r"[^\p{Lu}]+", "")) / size,
        F.length(F.regexp_replace(body, r"[^0-9]+", "")) / size,
    ]
    return with_words.withColumn(tokens, n.cast("long")).withColumn(shape, F.array(*shares))


@dataclass
class Membership:
    """A fitted classifier over sorted domains; without a model, the same posterior for all."""

    domains: list[str]
    model: LogisticRegressionModel | None
    constant: list[float]


def assembled(df: DataFrame, words: str, shape: str, into: str) -> DataFrame:
    hashed, five = free_name(df, "hashed"), [free_name(df, f"share{k}") for k in range(5)]
    wide = HashingTF(inputCol=words, outputCol=hashed, numFeatures=BUCKETS, binary=True).transform(df).withColumns({c: F.col(shape)[k] for k, c in enumerate(five)})
    return VectorAssembler(inputCols=[*five, hashed], outputCol=into).transform(wide).drop(hashed, *five)


def learn(docs: DataFrame, labels: DataFrame, domain: Column | None = None, targets: dict[str, float] | None = None, per_domain: int = 1500, longest: int = 20_000, text: str = "text", doc_id: str = "doc_id") -> Membership:
    """Fit domain posteriors to about per_domain labelled documents of each domain, of at most `longest` characters.

    These two bounds hold for fitting alone; of rows that share a doc_id the least text is taken. Rows whose label names no target domain are ignored. With labelled documents
    of only one domain all posteriors are 1 for it; without any, they are equal for all domains.
    """
    domains = sorted(targets or TARGETS)
    named = labels.withColumn("_domain", quality_domain() if domain is None else domain).where(F.col("_domain").isin(domains))
    chosen = bounded_sample(named.groupBy(doc_id).agg(F.min("_domain").alias("_domain")), "_domain", doc_id, per_domain)
    rows = docs.select(doc_id, text).where(F.length(text) <= longest).join(F.broadcast(chosen), doc_id).groupBy(doc_id, "_domain").agg(F.min(text).alias(text))
    number = F.array_position(F.lit(domains), F.col("_domain")) - 1
    table = Scratch(docs.sparkSession, "mixing").table(rows.select(doc_id, text, number.cast("double").alias("label")), "labelled")
    present = [int(r.label) for r in table.select("label").distinct().collect()]
    if len(present) < 2:
        return Membership(domains, None, [float(k in present) for k in range(len(domains))] if present else [1.0 / len(domains)] * len(domains))
    ready = assembled(measured(table, text, "_words", "_shape", "_tokens"), "_words", "_shape", "features")
    model = LogisticRegression(maxIter=40, regParam=0.01, family="multinomial").fit(ready.select("features", "label").coalesce(4))
    return Membership(domains, model, [])


def with_posteriors(docs: DataFrame, membership: Membership, into: str, tokens: str, text: str = "text") -> DataFrame:
    """docs with its posteriors (an array in the order of the domains) and number of tokens (words)."""
    words, shape, features = free_name(docs, "words_"), free_name(docs, "shape_"), free_name(docs, "features_")
    ready = measured(docs, text, words, shape, tokens)
    if membership.model is None:
        return ready.withColumn(into, F.array(*[F.lit(x) for x in membership.constant])).drop(words, shape)
    model, k = membership.model.copy(), len(membership.domains)
    probability, raw = free_name(docs, "probability_"), free_name(docs, "raw_")
    model.setFeaturesCol(features).setProbabilityCol(probability).setRawPredictionCol(raw).setPredictionCol("")
    found = model.transform(assembled(ready, words, shape, features))
    seen = vector_to_array(probability)  # as many entries as the largest label fitted
    full = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.get(seen, i), F.lit(0.0)))
    return found.withColumn(into, full).drop(words, shape, features, probability, raw)


def rate(posterior: Column, pull: list[float]) -> Column:
    """The nonnegative rate of a document at the current multipliers of the domains."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((posterior[k] * float(x) for k, x in enumerate(pull)), F.lit(0.0)))


def fit_rates(scored: DataFrame, targets: dict[str, float], total_tokens: float | None = None, rounds: int = 25, tolerance: float = 1e-6) -> list[float]:
    """Multipliers of the domains for rate(); scored has columns t (tokens) and p (posteriors).

    The total defaults to the corpus's own tokens, so that scarce domains are repeated (rates above 1) and don't shrink the
    mixture. A domain without expected tokens can't be matched: by default the others share all tokens in the proportion of
    their weights, and its goal stays in the least-squares residual.
    Each round makes one pass: the domains' totals at the current rates and the Gram matrix of documents with a positive
    rate. A step that doesn't lessen the residual is halved; what can't be matched ends in the least-squares residual.
    """
    domains = sorted(targets)
    k = len(domains)
    weight = np.array([targets[d] for d in domains], float)
    weight = weight / weight.sum()
    cells = [(a, b) for a in range(k) for b in range(a, k)]
    t = F.col("t").cast("double")

    def sums(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = rate(F.col("p"), pull.tolist())
        on = F.when(r > 0, t).otherwise(0.0)
        row = scored.agg(*[F.sum(r * t * F.col("p")[a]).alias(f"s{a}") for a in range(k)], *[F.sum(on * F.col("p")[a] * F.col("p")[b]).alias(f"g{a}_{b}") for a, b in cells]).first()
        gram = np.zeros((k, k))
        for a, b in cells:
            gram[a, b] = gram[b, a] = row[f"g{a}_{b}"] or 0.0
        return np.array([row[f"s{a}"] or 0.0 for a in range(k)]), gram

    pull = np.zeros(k)
    totals, gram = sums(pull)
    if not totals.sum():
        return pull.tolist()
    held = weight[totals > 0].sum()  # what can be matched
    total = float(total_tokens) if total_tokens is not None else float(totals.sum() / (held or 1.0))
    goal, step = total * weight, 1.0
    best = np.linalg.norm(totals - goal)
    for _ in range(rounds):
        if best <= tolerance * max(total, 1.0) or step < 1e-3:
            break
        tried = pull + step * np.linalg.lstsq(gram + 1e-9 * np.trace(gram) * np.eye(k), totals - goal, rcond=None)[0]
        new_totals, new_gram = sums(tried)
        if (error := np.linalg.norm(new_totals - goal)) < best:
            pull, totals, gram, best, step = tried, new_totals, new_gram, error, min(1.0, 2 * step)
        else:
            step /= 2
    return pull.tolist()


def mix(docs: DataFrame, membership: Membership, targets: dict[str, float] | None = None, total_tokens: float | None = None, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with n_tokens, posterior, rate and copies (how often the mixture takes the document: the rate, rounded by a hash of doc_id and text to the whole number above or below so that its expectation is the rate).

    Texts are read once: what the fit and the result need is written to the shared folder. Null and empty texts have no
    tokens and don't sway the fit. Rows with equal doc_ids and texts get equal values; a null doc_id is hashed
    like any other value. No row is dropped here; columns of these names, in any case, are replaced. Very long texts are counted
    whole; documents with one posterior (ties) have one rate; an empty table gives an empty one.
    """
    targets = targets or TARGETS
    if sorted(targets) != membership.domains:
        raise ValueError("targets and classifier differ in their domains")
    made = ("n_tokens", "posterior", "rate", "copies")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in made]
    own = free_name(docs, "draw")
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col(doc_id), F.col(text)), F.lit(1_000_000_007)) / 1_000_000_007.0
    scored = with_posteriors(docs.drop(*made).withColumn(own, draw), membership, "posterior", "n_tokens", text)
    table = Scratch(docs.sparkSession, "mixing").table(scored.select(*kept, own, "n_tokens", "posterior"), "scored")
    pull = fit_rates(table.select(F.col("n_tokens").alias("t"), F.col("posterior").alias("p")), targets, total_tokens)
    rated = table.withColumn("rate", rate(F.col("posterior"), pull))
    return rated.withColumn("copies", F.floor(F.col("rate") + F.col(own)).cast("long")).drop(own)


def sampled(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture itself: each row as often as its copies say."""
    nth = free_name(mixed, "nth")
    return mixed.where(F.col("copies") > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    membership = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mix(docs, membership, keep=["doc_id"]).select("doc_id", "n_tokens", "posterior", "rate", "copies")
