"""Product codes of vectors in whole numbers, with exact assignment by pivots (LAESA).

A vector of floor(1024 * x) is cut into four parts; each part position has a codebook of up to 256 entries, refined for some rounds by
assigning every part to its nearest entry and averaging. Distances of all parts to a few fixed pivots are computed once and
stored. In each round the distances of the pivots to the entries give, for each part, a lower bound of its distance to
each entry: the largest difference of the two distances to one pivot. Entries are evaluated exactly, in whole numbers, in the
order of their bounds; an entry whose bound is above the best distance found is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.common import Scratch, free_name

PARTS, ENTRIES, ROUNDS, PIVOTS = 4, 256, 4, 16
SCALE, LIMIT = 1024, 1 << 25
ROWS = 2048  # parts that one step holds bounds to all entries for
WAVE = 4  # entries of the least bounds, evaluated for each part before all others
FEW_LABELS = 100_000  # sums of labels that are broadcast, at most


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a and b."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def choose_pivots(book: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n entries far from one another: each next one is the farthest from those chosen (ties: the lower index)."""
    picked, near = [0], squared(book, book[:1])[:, 0]
    while len(picked) < min(n, len(book)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, squared(book, book[picked[-1:]])[:, 0])
    return book[picked]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(squared(x, pivots).astype(np.float64))


def nearest(x: np.ndarray, x_pivots: np.ndarray, book: np.ndarray, book_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each row of x (ties: the lower index), its squared distance, and how many were evaluated.

    x_pivots and book_pivots hold distances to the same pivots. Bounds are lowered by more than rounding can raise them. Each
    row first evaluates the entries of its least bounds; the others follow by their least bound to any row, each for the
    rows whose best distance doesn't rule it out by then.
    """
    index, best, evaluated = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max), 0
    for lo in range(0, len(x), ROWS):
        part, far = x[lo : lo + ROWS], x_pivots[lo : lo + ROWS]
        low = np.zeros((len(part), len(book)))
        for k in range(book_pivots.shape[1]):
            np.maximum(low, np.abs(far[:, k, None] - book_pivots[None, :, k]), out=low)
        low = np.maximum(low * (1 - 1e-9) - 1e-6, 0.0) ** 2
        wave = min(WAVE, len(book))
        some = np.argpartition(low, wave - 1, axis=1)[:, :wave]
        some.sort(axis=1)
        exact = ((part[:, None, :] - book[some]) ** 2).sum(axis=2)
        low[np.arange(len(part))[:, None], some] = np.inf
        least = exact.argmin(axis=1)
        at, dist = some[np.arange(len(part)), least], exact.min(axis=1)
        evaluated += exact.size
        open_ = np.ascontiguousarray(low.T)
        for e in np.argsort(open_.min(axis=1), kind="stable").tolist():
            rows = np.flatnonzero(open_[e] <= dist)
            if len(rows):
                diff = part[rows] - book[e]
                d = np.einsum("ij,ij->i", diff, diff)
                evaluated += len(rows)
                better = (d < dist[rows]) | ((d == dist[rows]) & (e < at[rows]))
                at[rows[better]], dist[rows[better]] = e, d[better]
        index[lo : lo + ROWS], best[lo : lo + ROWS] = at, dist
    return index, best, evaluated


def whole_numbers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key_, label_ and x (array of long) of rows whose vector has only finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    floor = F.transform(v, lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long"))
    return vectors.where(v.isNotNull() & ~bad).select(F.col(key).alias("key_"), F.col(label).alias("label_"), floor.alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of one matrix, shorter ones with zeros behind."""
    size = np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    out = np.zeros((len(column), width), column.type.value_type.to_pandas_dtype())
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def with_pivot_distances(numbers: DataFrame, width: int, pivots: list[np.ndarray]) -> DataFrame:
    """key_, label_, x with `width` numbers, and pd, the distances of each part to its pivots, part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(2), width)
            cut = np.split(x, PARTS, axis=1)
            pd_ = np.concatenate([to_pivots(c, p) for c, p in zip(cut, pivots, strict=True)], axis=1)
            lists = [pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.shape[1] else np.zeros(len(x) + 1, np.int32), m.ravel()) for m in (x, pd_)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["key_", "label_", "x", "pd"])

    return numbers.mapInArrow(run, T.StructType([*numbers.schema.fields[:2], T.StructField("x", T.ArrayType(T.LongType())), T.StructField("pd", T.ArrayType(T.DoubleType()))]))


def assigned(b: pa.RecordBatch, width: int, pivots: list[np.ndarray], books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: the parts of a batch, their entries and squared distances."""
    x = np.split(matrix(b.column(2), width), PARTS, axis=1)
    far = np.split(matrix(b.column(3), PARTS * len(pivots[0])), PARTS, axis=1)
    for part, f, p, book in zip(x, far, pivots, books, strict=True):
        index, best, _ = nearest(part, f, book, to_pivots(book, p))
        yield part, index, best


def refined(parts: DataFrame, width: int, pivots: list[np.ndarray], books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: componentwise floors of the averages of what each entry got; unused entries stay.

    Each task adds up its own parts first, so that a row for each entry and task is shuffled and a row for each entry collected.
    """
    d, k = width // PARTS, len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, k, d), np.int64), np.zeros((PARTS, k), np.int64)
        for b in batches:
            for p, (part, index, _) in enumerate(assigned(b, width, pivots, books)):
                order = np.argsort(index, kind="stable")
                used, first = np.unique(index[order], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(part[order], first, axis=0)
                counts[p] += np.bincount(index, minlength=k)
        p, e = np.nonzero(counts)
        s = sums[p, e]
        lists = pa.ListArray.from_arrays(np.arange(0, s.size + 1, d, dtype=np.int32) if d else np.zeros(len(s) + 1, np.int32), s.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(e, pa.int64()), pa.array(counts[p, e], pa.int64()), lists], ["p", "e", "n", "s"])

    total = parts.mapInArrow(run, "p bigint, e bigint, n bigint, s array<bigint>").groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(d)])
    out = [b.copy() for b in books]
    for r in total.collect():  # at most PARTS * ENTRIES rows
        out[r.p][r.e] = [r[f"s{i}"] // r.n for i in range(d)]
    return out


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(c) for book in books for entry in book.tolist() for c in entry)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of vectors, and the codebooks (one matrix of entries for each part position).

    The table has key, label, code (array of entry numbers), error (squared distances summed over the parts) and label_error
    (errors summed over equal labels, nulls together). Rows whose vector is null or holds a null or non-finite component are
    left out; other columns play no part, whatever their names. The first entries are the vectors of the least keys
    (nulls last, ties by their numbers), as many as there are if fewer than ENTRIES. Vectors shorter than the longest one, or than the next multiple of PARTS, count as
    followed by zeros; numbers beyond plus or minus LIMIT count as that, so that sums stay exact. Equal vectors, and so repeated rows, get
    equal codes, each row its own; ties go to the lower entry. An empty table gives an empty one and codebooks without entries.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vector-codes")
    numbers = whole_numbers(vectors, key, vector, label)
    first = numbers.orderBy(F.col("key_").asc_nulls_last(), "x").limit(ENTRIES).collect()
    longest = numbers.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    start = np.array([r.x + [0] * (width - len(r.x)) for r in first], np.int64).reshape(len(first), width)
    books = np.split(start, PARTS, axis=1)
    kind = {f.name: f.dataType for f in numbers.schema}
    result = T.StructType([T.StructField(key, kind["key_"]), T.StructField(label, kind["label_"]), T.StructField("code", T.ArrayType(T.LongType())), T.StructField("error", T.LongType())])
    if not first:
        return spark.createDataFrame([], result).withColumn("label_error", F.lit(None).cast("long")), books
    pivots = [choose_pivots(b) for b in books]
    parts = scratch.table(with_pivot_distances(numbers, width, pivots), "parts")
    for _ in range(ROUNDS):
        books = refined(parts, width, pivots, books)
    final = books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(assigned(b, width, pivots, final))
            code = np.stack([i for _, i, _ in found], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, code.size + 1, PARTS, dtype=np.int32), code.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(sum(d for _, _, d in found), pa.int64())], result.names)

    coded = scratch.table(parts.mapInArrow(run, result), "coded")
    scratch.drop("parts")
    return with_sums(coded, label), books


def with_sums(coded: DataFrame, label: str, few: int = FEW_LABELS) -> DataFrame:
    """coded with label_error. Up to `few` labels the sums are broadcast; beyond that rows are dealt by label and salt, so that no label meets in one task."""
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    same = F.col(label).eqNullSafe(F.col("_label"))
    if coded.select(F.approx_count_distinct(label)).first()[0] <= few:
        return coded.join(F.broadcast(sums), same).drop("_label")
    salt, salts = free_name(coded, "salt"), 16
    dealt = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return coded.withColumn(salt, F.pmod(F.xxhash64("code", "error", coded.columns[0]), F.lit(salts)).cast("int")).join(dealt.hint("shuffle_hash"), same & (F.col(salt) == F.col("_salt"))).drop("_label", "_salt", salt)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds() -> str:
    """The rounds as common table expressions: near<k> holds each part's nearest entry, book<k + 1> the averages."""
    nearest_sql = """near{k} AS (
  SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT vec_id, parts.p, e, list_sum(list_transform(list_zip(parts.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts JOIN book{k} b ON b.p = parts.p
  ) GROUP BY vec_id, p
)"""
    book_sql = """mean{n} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT parts.p, best.e AS e, i, (sum(x[i + 1]) - ((sum(x[i + 1]) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM parts JOIN near{k} USING (vec_id, p), (SELECT unnest(range(0, 4096)) AS i) WHERE i < len(x) GROUP BY parts.p, best.e, i
  ) GROUP BY p, e
), book{n} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{n} m ON m.p = b.p AND m.e = b.e)"""
    steps = []
    for k in range(ROUNDS):
        steps += [nearest_sql.format(k=k), book_sql.format(k=k, n=k + 1)]
    return ", ".join([*steps, nearest_sql.format(k=ROUNDS)])


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, (SELECT unnest(range(0, {PARTS})) AS p)
), book0 AS (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES}
), {_rounds()}, coded AS (
  SELECT kept.vec_id, label, code, error FROM kept JOIN (SELECT vec_id, string_agg(lower(lpad(hex(best.e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id) USING (vec_id)
), digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""
