"""The stages of the corpus pipeline on odd input: nulls, empty and very long texts, repeated rows, clashing names, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHING = ["id", "key", "t", "of", "starts", "label", "y", "toxicity", "_toxicity", "n_lines", "N_REMOVED", "n_tokens", "rate", "copies", "posterior", "component_id", "dropped_id", "own_rate"]
LONG = " ".join(f"word{i % 4001}x{i // 3}" for i in range(60_000))
PASSAGE = [f"line {i} of a passage that two documents share word for word" for i in range(5)]


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The small tables with odd rows and clashing columns added."""
    path = str(tmp_path_factory.mktemp("odd"))
    draw = random.Random(4)
    near = [draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(draw.randrange(50)) for _ in range(200)]
    rows = [(900_001, None), (900_002, ""), (900_003, " \n\t "), (900_004, LONG), (900_005, LONG + " end"), (900_006, " ".join(near)), (900_007, " ".join([*near, "more"])), (900_008, "one two")]
    rows += [(900_009, "\n".join(["first head", *PASSAGE])), (900_010, "\n".join(["second head", *PASSAGE])), (900_011, "same id a"), (900_011, "same id b"), (None, "no id at all"), (None, None)]
    rows += [(900_012, "a repeated row of six words")] * 3
    own = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").cast(own.schema["doc_id"].dataType), "text", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns if c not in ("doc_id", "text")))
    docs = own.unionByName(extra.select(own.columns))
    docs.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHING)).write.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    nothing = [(None, 1, 1), (900_001, None, None), (900_012, 1, None), (900_012, 1, 0)]
    labels.unionByName(spark.createDataFrame(nothing, "doc_id long, quality int, toxic int").select(*(F.col(c).cast(labels.schema[c].dataType) for c in labels.columns))).write.parquet(f"{path}/labels.parquet")
    return path


def odd_rows(df):
    return [r for r in df.collect() if r.doc_id is None or r.doc_id > 900_000]


def unchanged(before, after, but=()):
    """Columns, types and all values but those of `but` are as before."""
    assert after.dtypes == before.dtypes
    others = [c for c in before.columns if c not in but]
    assert after.select(others).distinct().exceptAll(before.select(others).distinct()).count() == 0


def test_toxicity_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = corpus_pipeline.drop_toxic(spark, docs, odd)
    unchanged(docs, out)
    kept = odd_rows(out)
    assert sum(r.text in (None, "", " \n\t ") for r in kept) == 4
    assert sum(r.doc_id == 900_012 for r in kept) in (0, 3)


def test_line_dedup_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = corpus_pipeline.drop_repeated_lines(spark, docs, odd)
    unchanged(docs, out, ("text", "n_chars"))
    rows = odd_rows(out)
    assert out.count() == docs.count() and len(rows) == 17
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    text = {r.doc_id: r.text for r in rows}
    assert text[900_009].split("\n") == ["first head", *PASSAGE] and text[900_010].strip() == "second head"
    assert text[900_001] is None and text[900_002] == "" and text[900_004] == LONG
    assert [r.text for r in rows if r.doc_id == 900_012] == ["a repeated row of six words"] * 3


def test_near_dedup_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, odd)
    unchanged(docs, out)
    own = docs.where(F.col("doc_id").isNotNull()).collect()
    sets, reach = [shingles(r.text) for r in own], {r.doc_id: r.doc_id for r in own}
    close = [(a.doc_id, b.doc_id) for i, a in enumerate(own) for j, b in enumerate(own[:i]) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in own:
        before = dict(reach)
        for a, b in close:
            reach[a] = reach[b] = min(reach[a], reach[b])
        if reach == before:
            break
    wanted = sorted(r.doc_id for r in own if reach[r.doc_id] == r.doc_id)
    assert sorted(r.doc_id for r in out.where("doc_id IS NOT NULL").collect()) == wanted
    assert out.where("doc_id IS NULL").count() == 2 and {900_004, 900_006} <= set(wanted) and not {900_005, 900_007} & set(wanted)


def test_mixing_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = corpus_pipeline.mix_to_targets(spark, docs, odd)
    unchanged(docs, out)
    assert sum(r.doc_id == 900_012 for r in out.collect()) % 3 == 0
    tokens = lambda df: df.agg(F.sum(F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")))).first()[0]
    assert 0.5 * tokens(docs) < tokens(out) < 1.5 * tokens(docs)


def test_packing_stage(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = corpus_pipeline.pack_sequences(spark, docs, odd).collect()
    own = docs.select("doc_id", "text").collect()
    assert sum(r.n_tokens for r in rows) == sum(len((r.text or "").split()) for r in own)
    assert sum(r.bin_id is None for r in rows) == sum(not (r.text or "").split() for r in own)
    assert sum(r.doc_id == 900_012 for r in rows) == 3 and sum(r.n_tokens for r in rows if r.doc_id == 900_004) == 60_000


def test_stages_of_empty_tables(spark, odd, tmp_path):
    docs, labels = (spark.read.parquet(f"{odd}/{t}.parquet").limit(0) for t in ("documents", "labels"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
