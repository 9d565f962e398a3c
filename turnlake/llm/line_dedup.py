"""Repeated passages, by overlapping windows of three lines.

Every three consecutive lines are hashed; a window that occurs more than once anywhere keeps its first occurrence, and
the lines that later occurrences cover, merged, are removed. Each line that goes has an equal one, in an
earlier place, that stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.common import Scratch, free_name

WINDOW = 3


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())]))
def without(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
    """Texts without the lines that windows beginning at `starts` cover, and how many lines that takes out."""
    kept, removed = [], []
    for t, s in zip(text, starts, strict=True):
        if s is None or t is None:
            kept.append(None)
            removed.append(0)
            continue
        lines = t.split("\n")
        gone = np.zeros(len(lines) + WINDOW, np.int64)
        np.add.at(gone, s, 1)
        np.add.at(gone, np.asarray(s) + WINDOW, -1)
        covered = np.cumsum(gone)[: len(lines)] > 0
        kept.append("\n".join(x for x, c in zip(lines, covered.tolist(), strict=True) if not c))
        removed.append(int(covered.sum()))
    return pd.DataFrame({"text": kept, "n_removed": removed})


def windows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, of (a hash of the row's text), pos and two 64-bit hashes of each window that holds more than white space."""
    lines = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("of"), F.split(F.col(text), "\n").alias("lines")).where(F.size("lines") >= WINDOW)
    at = lambda i, k: F.get("lines", i + k)
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("lines") - WINDOW),
        lambda i: F.when(
            F.concat(at(i, 0), at(i, 1), at(i, 2)).rlike(r"\S"),
            F.struct(i.alias("pos"), F.xxhash64(at(i, 0), at(i, 1), at(i, 2)).alias("h1"), F.xxhash64(F.lit(1), at(i, 0), at(i, 1), at(i, 2)).alias("h2")),
        ),
    )
    return lines.select("id", "of", F.explode(F.filter(hashes, lambda x: x.isNotNull())).alias("w")).select("id", "of", "w.*")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the repeated lines taken out of `text`, and the columns n_lines and n_removed.

    Occurrences are ordered by doc_id (nulls first), then position; rows that share a doc_id and the whole text are
    one document and keep the same lines. Null texts stay null with 0 lines; texts of fewer than three lines
    have no window and stay; windows of white space only are ignored; a text may become empty. Columns
    named n_lines and n_removed, in any case, are replaced, all others kept; no row is dropped. Very long texts are cut into lines
    whole; equal windows are ties that the first place wins; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    all_windows = scratch.table(windows(docs, doc_id, text), "windows")
    here = F.struct("id", "of", "pos")
    repeated = all_windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(F.col("last") > F.col("first"))
    later = all_windows.join(repeated.select("h1", "h2", "first"), ["h1", "h2"]).where(here > F.col("first"))
    covered = later.groupBy("id", "of").agg(F.collect_set("pos").alias("starts"))
    covered = scratch.table(covered.select(F.col("id").alias("_id"), F.col("of").alias("_of"), "starts"), "covered")
    scratch.drop("windows")
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    starts, cut = free_name(docs, "starts"), free_name(docs, "cut")
    covered = covered.withColumnRenamed("starts", starts)
    # the same plan at every size: a broadcast that fits small inputs only would hide what large ones shuffle
    joined = docs.join(covered.hint("merge"), docs[doc_id].eqNullSafe(covered["_id"]) & (F.xxhash64(docs[text]) == covered["_of"]), "left")
    done = joined.select(*(docs[c] for c in kept), F.col(starts), without(F.when(F.col(starts).isNotNull(), docs[text]), F.col(starts)).alias(cut))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n"))).cast("long")
    new = F.when(F.col(starts).isNotNull(), F.col(f"{cut}.text")).otherwise(F.col(text))
    return done.select(*(new.alias(c) if c == text else F.col(c) for c in kept), n_lines.alias("n_lines"), F.col(f"{cut}.n_removed").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS passage FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) AS nth FROM windows WHERE passage IS NOT NULL AND regexp_matches(passage, '[^ \t\n\x0B\f\r]')
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1
), marked AS (
  SELECT lines.doc_id, lines.pos, line, gone.pos IS NOT NULL AS removed FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.pos = lines.pos
), merged AS (
  SELECT doc_id, count(*) AS n_lines, count_if(removed) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '') AS text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, m.text
FROM documents d LEFT JOIN merged m ON m.doc_id = d.doc_id
"""
