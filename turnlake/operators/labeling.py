"""The label queue, its context, validation of labels, and pluggable labelers and detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import taxonomy as tx
from turnlake.functions import text as tf
from turnlake.operators.dedupe import SESSION

MAX_ATTEMPTS = 5
BATCH = 25
CONTEXT_TURNS, CONTEXT_BYTES, REQUEST_BYTES, RATIONALE_BYTES = 6, 400, 5000, 200
TURN = [*SESSION, "seq"]


def of_version(rows: DataFrame, taxonomy_version: int | None = tx.TAXONOMY_VERSION, prompt_version: int | None = tx.PROMPT_VERSION) -> DataFrame:
    """Rows of the given versions; the others are superseded (OP-25)."""
    for name, v in (("taxonomy_version", taxonomy_version), ("prompt_version", prompt_version)):
        if v is not None and name in rows.columns:
            rows = rows.where(F.col(name) == v)
    return rows


def amnesty(ledger: DataFrame, granted: Column, level: int) -> DataFrame:
    """The failure ledger, empty for devices whose granted level is below the configured one (OP-26)."""
    return ledger.where(F.coalesce(granted, F.lit(0)) >= level)


def queue(turns: DataFrame, sessions: DataFrame, labels: DataFrame, failures: DataFrame) -> DataFrame:
    """User turns of known sessions that have no label of this version and fewer than MAX_ATTEMPTS failures (OP-27)."""
    asked = turns.where("role = 'user'").join(sessions.select(*SESSION, "model"), SESSION)
    done = of_version(labels).select(*TURN)
    retired = of_version(failures, None).where(F.col("attempts") >= MAX_ATTEMPTS).select(*TURN)
    return asked.join(done, TURN, "left_anti").join(retired, TURN, "left_anti")


def ranked(queued: DataFrame, per_device: int = BATCH) -> DataFrame:
    """The newest requests of each device with their `place`."""
    w = Window.partitionBy("device").orderBy(F.desc("ts_ms"), "tool", "external_id", F.desc("seq"))
    return queued.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_device)


def newest(queued: DataFrame, per_device: int = BATCH) -> DataFrame:
    """The newest requests of each device, blank ones left out afterwards (OP-80)."""
    return ranked(queued, per_device).where(F.col("redacted_text").rlike(r"\S"))


def batch(turns: DataFrame, sessions: DataFrame, labels: DataFrame, failures: DataFrame, per_device: int = BATCH) -> DataFrame:
    """newest(queue(...)) of turns whose keys are unique: keys alone go through joins and ranking, texts are read for the chosen rows."""
    chosen = ranked(queue(turns.select(*TURN, "role", "ts_ms"), sessions, labels, failures), per_device).drop("role", "ts_ms")
    return turns.join(chosen, TURN).where(F.col("redacted_text").rlike(r"\S"))


def with_context(turns: DataFrame) -> DataFrame:
    """turns with `context`: up to six turns before, oldest first, blank ones left out, as `role: text` of bounded bytes (OP-79)."""
    w = Window.partitionBy(*SESSION).orderBy("seq").rowsBetween(-CONTEXT_TURNS, -1)
    line = F.when(F.col("redacted_text").rlike(r"\S"), tf.first_bytes(F.concat_ws(": ", "role", tf.trimmed(F.col("redacted_text"))), CONTEXT_BYTES))
    return turns.withColumn("context", F.collect_list(line).over(w))


def request_text() -> Column:
    """The text a labeler gets: the context as a list, then the request, each of bounded bytes."""
    request = F.concat(F.lit("LATEST REQUEST:\n"), tf.first_bytes(F.col("redacted_text"), REQUEST_BYTES))
    earlier = F.array_join(F.transform("context", lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.when(F.size("context") > 0, F.concat(F.lit("EARLIER IN THIS CONVERSATION:\n"), earlier, F.lit("\n\n"), request)).otherwise(request)


def label_error() -> Column:
    """Why a label row is outside the taxonomy, by its first wrong facet; null if it is valid (OP-20)."""
    bad = lambda c, ok, what: (~F.coalesce(F.col(c).isin(ok), F.lit(False)), F.concat(F.lit(f"{what}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    depth_bad = ~F.coalesce(F.col("depth").between(tx.MIN_DEPTH, tx.MAX_DEPTH), F.lit(False))
    out = F.when(*bad("intent", tx.INTENTS, "intent outside taxonomy")).when(*bad("domain", tx.DOMAINS, "domain outside taxonomy"))
    out = out.when(*bad("delegation", tx.DELEGATIONS, "delegation outside taxonomy")).when(*bad("delegate_tool", tx.DELEGATE_TARGETS, "delegate_tool outside taxonomy"))
    return out.when(depth_bad, F.concat(F.lit("depth outside range: "), F.coalesce(F.col("depth").cast("string"), F.lit("null"))))


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid labels and failures with `last_error`."""
    marked = rows.withColumn("last_error", label_error())
    return marked.where("last_error IS NULL").drop("last_error"), marked.where("last_error IS NOT NULL")


REPLY = "choices array<struct<message:struct<content:string,refusal:string>>>"
PAYLOAD = "intent string, domain string, depth bigint, delegation string, delegate_tool string, confidence double, proposed_intent string, proposed_domain string, proposal_rationale string"


def parse_replies(replies: DataFrame, body: str = "body") -> DataFrame:
    """replies with the label of each model reply, its kept proposals, and last_error where there is none (OP-94, OP-20)."""
    out = replies.withColumn("_reply", F.from_json(body, REPLY)).withColumn("_m", F.get("_reply.choices", 0)["message"])
    out = out.withColumn("_p", F.from_json(F.col("_m.content"), PAYLOAD)).select(*replies.columns, "_reply", "_m", "_p.*")
    other = (F.col("intent") == tx.OTHER) | (F.col("domain") == tx.OTHER)
    rationale = F.nullif(tf.first_bytes(tf.trimmed(F.col("proposal_rationale")), RATIONALE_BYTES), F.lit(""))
    error = F.when(F.col("_reply").isNull() | F.col("_reply.choices").isNull(), "response parse").when(F.size("_reply.choices") == 0, "empty choices")
    error = error.when(F.col("_m.refusal").isNotNull(), F.concat(F.lit("model refused: "), F.col("_m.refusal"))).when(F.col("_m.content").isNull(), "no content")
    error = error.when(F.col("intent").isNull() | F.col("domain").isNull() | F.col("depth").isNull() | F.col("confidence").isNull(), "label parse").otherwise(label_error())
    return out.withColumns(
        {
            "last_error": error,
            "proposed_intent": tf.proposal_id(F.col("proposed_intent"), F.col("intent")),
            "proposed_domain": tf.proposal_id(F.col("proposed_domain"), F.col("domain")),
            "proposal_rationale": F.when(other, rationale),
            "confidence": tf.clamped(F.col("confidence")),
        }
    ).drop("_reply", "_m")


def apply_labeler(requests: DataFrame, labeler: Callable[[str], dict], request: str = "request") -> DataFrame:
    """requests with a caller's labels (OP-93): labeler(text) gives a dict of facets; what it raises becomes last_error."""
    facets = ["intent", "domain", "depth", "delegation", "delegate_tool", "confidence"]
    kinds = {"depth": "bigint", "confidence": "double"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch[request]:
                try:
                    found = labeler(text)
                    rows.append([found.get(f) for f in facets] + [None])
                except Exception as e:  # a labeler's failure is a row, never the job's
                    rows.append([None] * len(facets) + [f"{type(e).__name__}: {e}"])
            yield batch.assign(**{f: pd.Series([r[k] for r in rows], index=batch.index, dtype={"depth": "Int64", "confidence": "Float64"}.get(f, object)) for k, f in enumerate([*facets, "last_error"])})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema] + [f"{f} {kinds.get(f, 'string')}" for f in facets] + ["last_error string"])
    return requests.mapInPandas(run, schema)


def detect_entities(rows: DataFrame, detector: Callable[[str], list[dict]], column: str, into: str = "spans") -> DataFrame:
    """rows with a caller's entity spans, ready for redact_spans (OP-93)."""
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("class", T.StringType()), T.StructField("prob", T.DoubleType())]))

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if t is None else [(s["text"], s["class"], float(s["prob"])) for s in detector(t)] for t in texts])

    return rows.withColumn(into, run(F.col(column)))


def progress(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """user_turns, labeled and whole percent of this version (OP-67)."""
    total = turns.where("role = 'user'").agg(F.count("*").alias("user_turns"))
    done = of_version(labels).agg(F.count("*").alias("labeled"))
    return total.join(F.broadcast(done)).select("user_turns", "labeled", F.coalesce(F.expr("labeled * 100 div nullif(user_turns, 0)"), F.lit(0)).cast("long").alias("percent"))


def job_report(results: DataFrame) -> DataFrame:
    """considered, labeled, failed, proposals of parsed replies (OP-69)."""
    proposals = F.col("proposed_intent").isNotNull().cast("int") + F.col("proposed_domain").isNotNull().cast("int")
    return results.agg(F.count("*").alias("considered"), F.count_if(F.col("last_error").isNull()).alias("labeled"), F.count_if(F.col("last_error").isNotNull()).alias("failed"), F.coalesce(F.sum(F.when(F.col("last_error").isNull(), proposals)), F.lit(0)).cast("long").alias("candidates"))


def candidate_report(candidates: DataFrame, taxonomy_version: int = tx.TAXONOMY_VERSION) -> DataFrame:
    """Proposed values of one version, the most observed first (OP-68)."""
    return candidates.where(F.col("taxonomy_version") == taxonomy_version).orderBy(F.desc("observations"), "proposed")
