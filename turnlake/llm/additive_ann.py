"""Nearest neighbours by additive quantisation.

A vector is coded as the sum of one codeword from each of several full-dimensional codebooks, fitted to residuals and chosen by
beam search; beside the code stand a scale and the norm of what the code leaves of the vector. A query turns the codebooks into
lookup tables of inner products and scores every code by adding table entries. The score is off by at most the product of the
query's norm and that remainder's; every vector that can reach the k-th exact score within this bound is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.common import Scratch

BOOKS, WORDS, BEAM = 16, 256, 4
TRAINED_ON = 16_384  # vectors that the codebooks are fitted to, at most
LEAST_QUERIES, MOST_QUERIES, CODE_BLOCK = 256, 2048, 8192  # a query block holds between these numbers of queries on average


def nearest_words(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(axis=1) - 2 * (x @ book.T), axis=1)


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Codebooks (books x words x dimensions) by k-means on successive residuals, then one joint least-squares pass."""
    draw, residual, out = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        book = residual[draw.choice(len(residual), words, replace=len(residual) < words)].copy()
        for _ in range(rounds):
            near = nearest_words(residual, book)
            count = np.bincount(near, minlength=words)
            sums = np.stack([np.bincount(near, residual[:, d], words) for d in range(x.shape[1])], axis=1)
            book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], residual[draw.integers(0, len(residual), words)])
        book = book.astype(np.float32)
        residual = residual - book[nearest_words(residual, book)]
        out.append(book)
    found = np.stack(out)
    codes = encode(x, found)
    size = books * words
    gram, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
    for a in range(books):
        rows = slice(a * words, (a + 1) * words)
        right[rows] = np.stack([np.bincount(codes[:, a], x[:, d], words) for d in range(x.shape[1])], axis=1)
        for b in range(books):
            gram[rows, b * words : (b + 1) * words] = np.bincount(codes[:, a] * words + codes[:, b], minlength=words**2).reshape(words, words)
    ridge = 1e-3 * len(x) / words
    flat = found.reshape(-1, x.shape[1])
    return np.linalg.solve(gram + ridge * np.eye(len(gram)), right + ridge * flat).reshape(found.shape)


def encode(x: np.ndarray, codebooks: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) by beam search: after each book the `beam` partial sums nearest to the vector stay."""
    out, codebooks = np.empty((len(x), len(codebooks)), np.int64), codebooks.astype(np.float32)
    for lo in range(0, len(x), 512):
        rest = x[lo : lo + 512, None, :].astype(np.float32)
        chosen = np.zeros((len(rest), 1, 0), np.int64)
        for book in codebooks:
            error = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(axis=1)
            flat = error.reshape(len(rest), -1)
            keep = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
            parent, word = keep // len(book), keep % len(book)
            rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
            chosen = np.concatenate([np.take_along_axis(chosen, parent[:, :, None], axis=1), word[:, :, None]], axis=2)
        best = (rest**2).sum(axis=2).argmin(axis=1)
        out[lo : lo + 512] = chosen[np.arange(len(chosen)), best]
    return out


def decode(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    return sum(codebooks[m][codes[:, m]] for m in range(len(codebooks)))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v (doubles) of the vectors that take part: of the most frequent dimension, finite, not zero; one for each id."""
    parts = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    parts = parts.where(finite & F.exists("v", lambda x: x != 0))
    sizes = parts.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    parts = parts.where(F.size("v") == (sizes[0].d if sizes else 0))
    return parts.groupBy("vec_id").agg(F.min("v").alias("v"))


def doubles(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return np.array(column.to_pylist(), np.float64)


def coded(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, codes (a byte for each book), scale (norm of the vector over norm of its sum of codewords), left (norm of the vector less its scaled sum) and v."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    double = T.DoubleType()
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("codes", T.BinaryType()), T.StructField("scale", double), T.StructField("left", double), T.StructField("v", T.ArrayType(double))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = doubles(batch.column(1))
                codes = encode(x, shared.value)
                sums = decode(codes, shared.value)
                norm = np.linalg.norm(sums, axis=1)
                scale = np.linalg.norm(x, axis=1) / np.where(norm > 0, norm, 1)
                left = np.linalg.norm(x - scale[:, None] * sums, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(scale), pa.array(left), batch.column(1)], names=["vec_id", "codes", "scale", "left", "v"])

    return vectors.select("vec_id", "v").mapInArrow(run, schema)


def best_rows(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n largest scores, ties to smaller ids."""
    if len(score) > n:
        near = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:n]]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with y, added up from the first component on, so that equal vectors get equal ones."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[d]
    return out


def neighbours(queries: DataFrame, codes: DataFrame, codebooks: np.ndarray, k: int, first: int) -> DataFrame:
    """query_id, and the ids and exact scores of the k other vectors of largest inner product.

    Queries go into blocks of bounded size, codes into packed blocks that are dealt to every query block; a task
    runs through the codes of one query block after another and keeps only the best k for each query. The `first` best
    by table lookup are scored exactly before the bound is used; the bound leaves out none that belongs to the result.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(codebooks)
    asked_for = queries.count()
    # all codes travel to every block of queries: no more blocks than memory or the idle cores ask for
    blocks = max(1, -(-asked_for // MOST_QUERIES), min(-(-asked_for // LEAST_QUERIES), spark.sparkContext.defaultParallelism))
    code_blocks = max(1, -(-codes.count() // CODE_BLOCK))
    pack = F.pmod(F.xxhash64(F.lit("codes"), "vec_id"), F.lit(code_blocks))
    gathered = codes.groupBy(pack.alias("b")).agg(F.collect_list(F.struct("vec_id", "codes", "scale", "left", "v")).alias("x"))
    packed = gathered.select(F.col("x.vec_id").alias("ids"), F.col("x.codes").alias("codes"), F.col("x.scale").alias("scales"), F.col("x.left").alias("left"), F.col("x.v").alias("v"))
    everywhere = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"), F.lit(1).alias("turn"), "ids", "codes", "scales", "left", "v")
    block = F.pmod(F.xxhash64(F.lit("queries"), "vec_id"), F.lit(blocks)).cast("int")
    asked = queries.groupBy(block.alias("q")).agg(F.collect_list(F.struct("vec_id", "v")).alias("x"))
    numbers = F.lit(None).cast("array<double>")
    asked = asked.select("q", F.lit(0).alias("turn"), F.col("x.vec_id").alias("ids"), F.lit(None).cast("array<binary>").alias("codes"), numbers.alias("scales"), numbers.alias("left"), F.col("x.v").alias("v"))
    both = asked.unionByName(everywhere).repartitionById(blocks, F.col("q")).sortWithinPartitions("q", "turn")  # a task for each block
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("found", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        own, best = None, []

        def results() -> Iterator[pa.RecordBatch]:
            if own is not None:
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([b[1].tolist() for b in best], pa.list_(pa.int64())), pa.array([b[0].tolist() for b in best], pa.list_(pa.float64()))], names=["query_id", "found", "scores"])

        for batch in batches:
            for row in range(batch.num_rows):
                one = lambda name: batch.column(name)[row].values  # noqa: B023, E731
                if batch.column("turn")[row].as_py() == 0:
                    yield from results()
                    own = one("ids").to_numpy()
                    v = one("v").flatten().to_numpy().reshape(len(own), -1)
                    tables, norms = np.einsum("qd,mkd->mkq", v, books), np.linalg.norm(v, axis=1)  # a column for each query
                    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in own]
                    continue
                if own is None:
                    continue  # a block without queries
                ids, scale, left = one("ids").to_numpy(), one("scales").to_numpy(), one("left").to_numpy()
                codes_ = np.frombuffer(b"".join(one("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
                x = one("v").flatten().to_numpy().reshape(len(ids), -1)
                slack = left + 1e-9 * np.linalg.norm(x, axis=1)  # the last part is for rounding
                for lo in range(0, len(ids), 2048):
                    part = slice(lo, lo + 2048)
                    score = sum(tables[m][codes_[part, m]] for m in range(len(books))) * scale[part, None]
                    for i, query in enumerate(own):
                        least, near = score[:, i] + slack[part] * norms[i], np.arange(lo, min(lo + 2048, len(ids)))
                        near = near[ids[near] != query]
                        if len(best[i][0]) < k:
                            near = near[best_rows(score[near - lo, i], ids[near], first)]
                            best[i] = kept(best[i], ids[near], products(x[near], v[i]), k)
                            near = np.setdiff1d(np.arange(lo, min(lo + 2048, len(ids))), near)
                            near = near[ids[near] != query]
                        if len(best[i][0]) == k:
                            near = near[least[near - lo] >= best[i][0][-1]]
                        if len(near):
                            best[i] = kept(best[i], ids[near], products(x[near], v[i]), k)
        yield from results()

    return both.mapInArrow(run, schema)


def kept(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of those so far and new ones, as scores and ids."""
    s, near = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    at = best_rows(s, near, k)
    return s[at], near[at]


def search(vectors: DataFrame, is_query: Column, k: int = 20, reranked: int = 500, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of largest inner product with each query, other than itself.

    Every vector is indexed and every query of is_query (an expression over vec_id) is answered; the codebooks are fitted to
    at most TRAINED_ON of them, chosen by a hash of their ids. Scores and neighbours are exact at every size of the table; `reranked` is only how many
    are scored before the error bound tells which others can matter. Ties go to the smaller vec_id; fewer rows come out where there are fewer candidates. Vectors that are null, empty, zero, of another dimension than most, or
    hold null or non-finite components take no part. Rows with equal vec_ids count once, with the least vector. An empty
    table gives an empty one; only the two named columns are read, so others may have any name.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "additive-ann")
    base = scratch.table(usable(vectors, vec_id, embedding), "base")
    total = base.count()
    share = F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, 0.9 * TRAINED_ON / max(1, total))) + 1)
    sample = [r for r in base.where(share).select("vec_id", "v").collect()]
    sample = np.array([r.v for r in sorted(sample, key=lambda r: r.vec_id)[:TRAINED_ON]])
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    words = int(min(WORDS, max(1, len(sample) // 4)))
    codebooks = fit_codebooks(sample, words=words)
    codes = scratch.table(coded(base, codebooks), "codes")
    found = neighbours(base.where(is_query), codes, codebooks, k, max(reranked, k))
    ranked = found.select("query_id", F.posexplode(F.arrays_zip("found", "scores")).alias("p", "x"))
    return ranked.select(F.col("query_id").cast("long").alias("query_id"), (F.col("p") + 1).cast("int").alias("rank"), F.col("x.found").cast("long").alias("vec_id"), F.col("x.scores").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
