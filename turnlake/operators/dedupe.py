"""De-duplication and upserts. Every function names its key; nulls in keys are values of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION = ["device", "tool", "external_id"]


def first_wins(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key by `order` (OP-52, OP-54)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def last_wins(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key by `order` (OP-55)."""
    return first_wins(rows, key, *[c.desc() for c in order])


def add_new_turns(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """stored and those parsed turns whose position isn't stored yet; the same parse again adds nothing."""
    key = [*SESSION, "seq"]
    fresh = first_wins(parsed, key, F.col("ord")).drop("ord")
    return stored.unionByName(fresh.join(stored.select(*key), key, "left_anti"))


def upsert_sessions(versions: DataFrame) -> DataFrame:
    """One row for each session of its parsed versions, in the order of `ord` (OP-53).

    started_ms stays that of the first, provider and surface are those of the last, model is the last that isn't null,
    ended_ms and message_count are the largest.
    """
    return versions.groupBy(*SESSION).agg(
        F.max_by("provider", "ord").alias("provider"),
        F.max_by("surface", "ord").alias("surface"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("ord"))).alias("model"),
        F.min_by("started_ms", "ord").alias("started_ms"),
        F.max("ended_ms").alias("ended_ms"),
        F.max("message_count").alias("message_count"),
    )


def replace_delegations(stored: DataFrame, parsed_sessions: DataFrame, parsed: DataFrame) -> DataFrame:
    """stored with the whole set of each parsed session replaced, also by an empty one (OP-56).

    Rows of one session, tool and instant collapse by their sum; sums below 1 go.
    """
    new = parsed.groupBy(*SESSION, "driven_tool", "occurred_ms").agg(F.sum("turns").alias("turns")).where("turns > 0")
    return stored.join(parsed_sessions.select(*SESSION).distinct(), SESSION, "left_anti").unionByName(new.select(*stored.columns))


def without_repeats(turns: DataFrame, order: str = "pos") -> DataFrame:
    """Turns of web chats without those equal in role and text to the turn before, numbered from `existing` on (OP-57, OP-81).

    turns has device, tool, external_id, role, redacted_text, existing (turns already stored) and last_role and
    last_text (of the last stored turn, or null). Blank turns are dropped first.
    """
    w = Window.partitionBy(*SESSION).orderBy(order)
    kept = turns.where(F.col("redacted_text").rlike(r"\S"))
    before = kept.withColumns({"_role": F.coalesce(F.lag("role").over(w), "last_role"), "_text": F.coalesce(F.lag("redacted_text").over(w), "last_text")})
    fresh = before.where(~(F.col("role").eqNullSafe(F.col("_role")) & F.col("redacted_text").eqNullSafe(F.col("_text"))))
    return fresh.withColumn("seq", F.row_number().over(w) - 1 + F.coalesce("existing", F.lit(0))).drop("_role", "_text")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources as one table; a column that one lacks is null (OP-60)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def merge_failures(ledger: DataFrame, failed: DataFrame, labels: DataFrame) -> DataFrame:
    """The failure ledger after a batch: attempts add up, the last error stays, labelled turns leave (OP-58)."""
    key = [*SESSION, "seq", "prompt_version"]
    both = ledger.unionByName(failed).groupBy(*key).agg(F.sum("attempts").alias("attempts"), F.max_by("last_error", "last_attempt_ms").alias("last_error"), F.max("last_attempt_ms").alias("last_attempt_ms"))
    return both.join(labels.select(*key).distinct(), key, "left_anti")


def merge_candidates(proposals: DataFrame) -> DataFrame:
    """One row for each proposed value of a facet: observations, first and last sight, first rationale (OP-59)."""
    return proposals.groupBy("taxonomy_version", "facet", "proposed").agg(
        F.count("*").alias("observations"), F.min("seen_ms").alias("first_seen_ms"), F.max("seen_ms").alias("last_seen_ms"), F.min_by("rationale", "seen_ms").alias("rationale")
    )
