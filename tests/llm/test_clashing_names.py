"""Tables that have columns with the names that operators make, in upper case."""

import pytest
from pyspark.sql import functions as F

from turnlake.llm import additive_ann, flac, language_id, line_dedup, mixing, near_dedup, packing, pii, runs, secret_scan, sharding, toxicity, vector_codes

DOCS = [(k, f"some plain words of document {k % 4}\nsecond line\nthird line", "en" if k % 2 else "de") for k in range(12)]
MADE = {
    "near": ("COMPONENT_ID", "N_SHINGLES", "KEPT", "ID", "HASH", "KEY", "SET"),
    "packing": ("PIECE", "BIN", "LENGTH", "N_TOKENS", "START", "SHARD", "COPY"),
    "lines": ("N_LINES", "N_REMOVED", "STARTS", "CUT", "_ID", "_OF"),
    "pii": ("N_EMAIL", "N_IP", "N_CARD", "N_PHONE", "N_DISGUISED", "BASE_SHA256", "SPANS", "FOUND"),
    "language": ("LANG_PRED", "SCORE", "FOUND"),
    "mixing": ("N_TOKENS", "POSTERIOR", "RATE", "COPIES", "DRAW", "NTH"),
    "flac": ("MEDIA",),
    "toxicity": ("SCORE",),
    "secrets": ("WORD", "PART", "CANDIDATE", "SCORE", "SECRET", "PATH", "W"),
    "runs": ("N_WORDS", "RUNS", "COLLAPSED", "WORDS_OF"),
    "shards": ("SIZE", "SHARD", "SLOT", "PLACE", "GROUP_KEY", "ROW_KEY"),
}


@pytest.mark.parametrize("name", sorted(MADE))
def test_documents_with_clashing_columns(spark, name):
    plain = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string")
    docs = plain.withColumns({c: F.lit("own") for c in MADE[name]})
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "doc_id bigint, quality int, toxic int")
    out = {
        "near": lambda: near_dedup.deduplicated(docs),
        "packing": lambda: packing.pack(docs),
        "lines": lambda: line_dedup.remove_repeats(docs),
        "pii": lambda: pii.scan(docs),
        "language": lambda: language_id.identify(docs, language_id.learn(docs)),
        "mixing": lambda: mixing.mix(docs, mixing.learn(docs, labels)),
        "flac": lambda: flac.with_media(docs),
        "toxicity": lambda: toxicity.score(docs, toxicity.learn(docs, labels)),
        "secrets": lambda: secret_scan.scan(docs),
        "runs": lambda: runs.with_runs(docs),
        "shards": lambda: sharding.shard_documents(docs, shards=3),
    }[name]()
    lower = [c.lower() for c in out.columns]
    assert len(lower) == len(set(lower))
    rows = out.collect()
    assert name == "secrets" or len(rows) == (4 if name == "near" else 12)


def test_vectors_with_clashing_columns(spark):
    rows = [(k, [float(k % 5), 1.0, 0.5, float(k % 3)], k % 2) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns({c: F.lit("own") for c in ("CODE", "ERROR", "LABEL_ERROR", "X", "PD", "KEY_", "LABEL_", "SCORE", "RANK", "QUERY_ID", "CODES", "BLOCK", "NORM")})
    assert vector_codes.compress(df)[0].count() == 30
    assert additive_ann.search(df, F.col("vec_id") % 10 == 0, k=2).count() == 6
