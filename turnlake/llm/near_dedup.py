"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, connected components.

Documents with equal shingle sets count as one candidate. Candidates that share a band's minima meet in a bucket; each is
checked against its bucket's first member, by the signatures and then exactly on the full sets, and
connected components join what is linked. Buckets that still hold several components then have all their open
pairs checked, in blocks of bounded size that pass on no more links than join components. So no bucket's pairs are
ever written out, and no link between candidates that share a band is lost.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.common import Scratch, free_name
from turnlake.llm.components import connected_components

MINIMA = 128
MISSED = 1e-6  # bound on the chance that a pair right at the threshold shares no band
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000
KNOWN_WORDS = 300_000
U64 = np.uint64


def bands(threshold: float) -> tuple[int, int]:
    """Number of bands and minima in each: the most selective choice that keeps MISSED."""
    for rows in range(16, 0, -1):
        n = MINIMA // rows
        if (1 - threshold**rows) ** n <= MISSED:
            return n, rows
    return MINIMA, 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Shingle sets of lower-cased (A-Z) texts as sorted 64-bit hashes, and their minima under universal hash functions."""

    def __init__(self, words: int, threshold: float):
        self.words, (self.n_bands, self.rows) = words, bands(threshold)
        draw = np.random.default_rng(20_240_501)
        self.mul = (draw.integers(0, 1 << 31, (MINIMA, 1), np.int64) * 2 + 1).astype(np.uint32)
        self.add = draw.integers(0, 1 << 32, (MINIMA, 1), np.int64).astype(np.uint32)
        self.known = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not tokens:
            return np.zeros(0, U64)
        hashed = np.fromiter(map(self.known.__getitem__, tokens), U64, len(tokens))
        k = min(self.words, len(tokens))
        out = np.full(len(tokens) - k + 1, k, U64)
        for i in range(k):
            out = (out ^ hashed[i : len(hashed) - k + 1 + i]) * U64(0x9E3779B97F4A7C15)
            out ^= out >> U64(32)
        out *= U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(29)
        return np.unique(out)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles ^ (shingles >> U64(32))).astype(np.uint32)
        out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(low), 8192):
            out = np.minimum(out, (low[None, lo : lo + 8192] * self.mul + self.add).min(axis=1))
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One key for each band: the band's number in the top byte, a hash of its minima below."""
        rows = minima[: self.n_bands * self.rows].reshape(self.n_bands, self.rows).astype(U64)
        h = np.full(self.n_bands, 0x51ED270B, U64)
        for r in range(self.rows):
            h = (h ^ rows[:, r]) * U64(0x9E3779B97F4A7C15)
            h ^= h >> U64(31)
        return ((h >> U64(8)) | (np.arange(self.n_bands, dtype=U64) << U64(56))).astype(np.int64)


@functools.cache
def shingler(words: int, threshold: float) -> Shingler:
    return Shingler(words, threshold)


def features(docs: DataFrame, doc_id: str, text: str, words: int, threshold: float) -> DataFrame:
    """id, n (set size), digest of the set, band keys; one row for each row of docs."""
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(words, threshold)
        for batch in batches:
            n, digest, keys = [], [], []
            for t in batch.column(1):
                s = own.shingles(t.as_py())
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(own.band_keys(own.minima(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "digest", "keys"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """id, n, sig (lowest byte of each minimum), keys and the full set of docs' (id, text)."""
    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("sig", "keys", "shingles"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(words, threshold)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [own.shingles(t.as_py()) for t in part.column(1)]
                minima = [own.minima(s) for s in sets]
                binary = lambda arrays: pa.array([a.tobytes() for a in arrays], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), binary([m.astype(np.uint8) for m in minima]), binary([own.band_keys(m) for m in minima]), binary(sets)], names=["id", "n", "sig", "keys", "shingles"])

    return docs.select("id", "t").mapInArrow(run, schema)


def least_agreement(num: int, den: int) -> int:
    """Agreeing signature bytes below which a pair at the threshold practically never falls (six deviations)."""
    t = num / den
    return int(MINIMA * t - 6 * (MINIMA * t * (1 - t)) ** 0.5)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * intersection >= num * union, on full sets."""
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those (u, v) of pairs whose full sets are linked.

    Signatures are compared first, but not of pairs that are `only` ones of their bucket: no later step looks at these again,
    while open_links() checks every pair of a larger bucket that is left open here.
    """
    least = least_agreement(num, den)

    @F.pandas_udf(T.BooleanType())
    def check(only: pd.Series, sig_u: pd.Series, sig_v: pd.Series, set_u: pd.Series, set_v: pd.Series) -> pd.Series:
        out = np.zeros(len(sig_u), bool)
        if len(out):
            agree = (np.frombuffer(b"".join(sig_u), np.uint8) == np.frombuffer(b"".join(sig_v), np.uint8)).reshape(-1, MINIMA).sum(axis=1)
            for i in np.flatnonzero((agree >= least) | only.to_numpy()):
                out[i] = linked(np.frombuffer(set_u.iat[i], U64), np.frombuffer(set_v.iat[i], U64), num, den)
        return pd.Series(out)

    side = lambda x: sets.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("u").hint("merge"), "u").join(side("v").hint("merge"), "v")
    return both.where(check("only", "sig_u", "sig_v", "set_u", "set_v")).select("u", "v")


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of 0/1 matrices over `width` elements at a time."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return out
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    parts = []
    for sets in (left, right):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(shared, flat)
        on = at < len(shared)
        on[on] = shared[at[on]] == flat[on]
        parts.append((row[on], at[on]))
    for lo in range(0, len(shared), width):
        dense = []
        for (row, at), n in zip(parts, out.shape, strict=True):
            on = (at >= lo) & (at < lo + width)
            m = np.zeros((n, min(width, len(shared) - lo)), np.float32)
            m[row[on], at[on] - lo] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def open_links(members: DataFrame, component: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) between components that share a bucket, all open pairs having been checked.

    In each bucket, the members outside the first member's component meet all others. Both sides are dealt into blocks of
    bounded rows and shingles. A pair is checked in the first bucket that it shares; each block joins components as
    it finds links, so it gives at most one link for each component that it holds.
    """
    known = members.join(component.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = known.join(sets.select("id", "n"), "id")
    first = known.where(F.col("id") == F.col("pivot")).select("key", F.col("component").alias("main")).distinct()
    sided = known.join(first, "key").withColumn("out", F.col("component") != F.col("main"))
    shape = sided.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.count_if("out").alias("out_rows"), F.sum(F.when(F.col("out"), F.col("n"))).alias("out_shingles"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("print"))
    shape = shape.where((F.col("rows") > 2) & (F.col("out_rows") > 0))
    only = shape.groupBy("rows", "print").agg(F.min("key").alias("key"))  # buckets with the same members: the first band's
    parts = lambda rows, n: F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(n) / BLOCK_SHINGLES)).cast("int")
    shape = shape.join(only.select("key"), "key", "left_semi").select("key", parts("rows", "shingles").alias("n_all"), parts("out_rows", "out_shingles").alias("n_out"))
    dealt = sided.join(shape, "key").select("key", "id", "component", "out", "n_all", "n_out", F.xxhash64(F.lit("block"), "id").alias("h"))
    left = dealt.where("out").select("key", "id", "component", F.lit(True).alias("left"), F.pmod("h", "n_out").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_all").cast("bigint") - 1)).alias("j"))
    right = dealt.select("key", "id", "component", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_out").cast("bigint") - 1)).alias("i"), F.pmod("h", "n_all").alias("j"))
    blocks = left.union(right).join(sets.select("id", "keys", "shingles"), "id")
    kind = sets.schema["id"].dataType

    def check(table: pa.Table) -> pa.Table:
        ids, comp = table["id"].to_pylist(), table["component"].to_pylist()
        flag = np.array(table["left"].to_pylist())
        xs, ys = np.flatnonzero(flag), np.flatnonzero(~flag)
        keys = np.stack([np.frombuffer(x, np.int64) for x in table["keys"].to_pylist()])
        members = [np.frombuffer(x, U64) for x in table["shingles"].to_pylist()]
        size = np.array([len(s) for s in members])
        both = intersections([members[x] for x in xs], [members[y] for y in ys])
        found = den * both >= num * (size[xs][:, None] + size[ys] - both)
        for band in range(table["key"][0].as_py() >> 56):  # pairs that share an earlier band are checked there
            found &= keys[xs, band][:, None] != keys[ys, band]
        root: dict = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        us, vs = [], []
        for i, j in zip(*(k.tolist() for k in np.nonzero(found)), strict=True):
            a, b = find(comp[xs[i]]), find(comp[ys[j]])
            if a != b:
                root[max(a, b)] = min(a, b)
                us.append(ids[xs[i]])
                vs.append(ids[ys[j]])
        return pa.table({"u": pa.array(us, table["id"].type), "v": pa.array(vs, table["id"].type)})

    return blocks.groupBy("key", "i", "j").applyInArrow(check, T.StructType([T.StructField("u", kind), T.StructField("v", kind)]))


def duplicate_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id).

    Documents link when den * |intersection| >= num * |union| of their sets of distinct shingles of `words` words.
    A text of fewer words is one shingle; null and empty texts and texts without words have an empty set and link
    with nothing. Rows that share a doc_id are one document that has the links of each of them. A null doc_id
    links with nothing: its component is null and it is kept. Very long texts have their whole sets; among equal ones (ties) the
    least doc_id stands for all; an empty table gives an empty one. Only the two named columns are read, so others may have any name.
    """
    spark, threshold = docs.sparkSession, num / den
    scratch = Scratch(spark, "near-dedup")
    all_rows = scratch.table(features(docs, doc_id, text, words, threshold), "features")
    usable = all_rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    first = scratch.table(usable.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "first-of-set")
    stands = usable.join(first.select(F.col("digest"), F.col("first").alias("id")), ["digest", "id"], "left_semi")
    in_bands = stands.select("id", F.explode("keys").alias("key"))
    shared = in_bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last"), F.count("*").alias("rows")).where(F.col("_last") > F.col("pivot"))
    members = scratch.table(in_bands.join(shared.select("key", "pivot", (F.col("rows") == 2).alias("only")).hint("merge"), "key"), "members")
    active = members.select("id").distinct()
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(active.hint("merge"), "id", "left_semi")
    sets = scratch.table(full_sets(texts, words, threshold), "sets")
    pairs = members.where(F.col("id") > F.col("pivot")).select(F.col("id").alias("u"), F.col("pivot").alias("v"), "only").groupBy("u", "v").agg(F.bool_or("only").alias("only"))
    links = scratch.table(verified(pairs, sets, num, den), "links")
    component = scratch.table(connected_components(links, scratch, "first"), "component")
    more = scratch.table(open_links(members, component, sets, num, den), "more")
    scratch.drop("sets", "members")
    # the components found first stand for their members; copies with one set link to the first of them
    by_node = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    lifted = more.join(by_node("u"), "u", "left").join(by_node("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    joined = connected_components(lifted, scratch, "second")
    final = component.join(joined.select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
    final = scratch.table(final.union(joined.join(component.select("node"), "node", "left_anti")), "final")
    copies = usable.select("id", "digest").join(first.where("copies > 1").select("digest", "first"), "digest").select("id", "first")
    copies = copies.where(F.col("id") != F.col("first")).distinct()
    direct = copies.join(final.withColumnRenamed("node", "first"), "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    named = direct.union(final.select(F.col("node").alias("id"), "component")).groupBy("id").agg(F.min("component").alias("component"))
    out = all_rows.select("id", "n").join(named, "id", "left")
    found = F.least(F.coalesce("component", "id"), F.col("id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of docs whose document is kept; documents with one doc_id are kept or dropped together."""
    mark = free_name(docs, "dropped_id")
    gone = duplicate_classes(docs, text=text, doc_id=doc_id, **how).where(~F.col("kept")).select(F.col(doc_id).alias(mark)).distinct()
    return docs.join(gone.hint("merge"), docs[doc_id] == gone[mark], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return duplicate_classes(docs, words=3, num=85, den=100)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), shingles AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN sets x ON x.doc_id = u JOIN sets y ON y.doc_id = v WHERE 100 * c >= 85 * (len(x.s) + len(y.s) - c)
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS found FROM documents
  UNION
  SELECT node, v FROM reach JOIN edges ON found = u
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT node, min(found) AS component_id FROM reach GROUP BY node) ON node = doc_id
"""
