"""The corpus pipeline: toxicity, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns where each piece of each document goes. Classifiers learn from the labels table.

All stages take nulls in any column, texts of any length (classifiers learn from those of at most 20,000 characters, and all are
scored, compared, mixed and packed whole), rows that repeat, and further columns of any name, which they keep as they
are. An empty documents table gives an empty one, and labels may be empty too. What each makes of them is said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm import line_dedup, mixing, near_dedup, packing, toxicity
from turnlake.llm.common import free_name, shared_dir


def set_aside(docs: DataFrame, *made: str) -> tuple[DataFrame, list[Column]]:
    """docs with those of its columns renamed that have a name in `made`, and the columns that name all of them as before."""
    hidden = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in made}
    return docs.withColumnsRenamed(hidden), [F.col(hidden.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half.

    Null and empty texts have the score of a text without words. Equal texts stay or go together, whatever their ids; a null
    doc_id is an id like any other. Where all labels to learn from are 1, every document goes; where all are 0 or there are none, all stay.
    """
    net = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = free_name(docs, "toxicity")
    return toxicity.score(docs, net, into=into).where(F.col(into) < 0.5).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of later occurrences of repeated passages; n_chars follows the text.

    A null text stays null and its n_chars becomes null; a text may become empty. Of occurrences in several documents the one of the
    least doc_id (null first) stays; rows that share doc_id and text are one document and all keep their lines.
    """
    kept, columns = set_aside(docs, "n_lines", "n_removed")
    done = line_dedup.remove_repeats(kept)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more).

    The one of the least doc_id stays. Null and empty texts have no duplicates; rows with a null doc_id stay; rows that
    share a doc_id stay or go together.
    """
    return near_dedup.deduplicated(docs, words=5, num=80, den=100).select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their fitted rates say, so that the quality domains hold their target shares.

    A document comes as often as its rate, rounded by a hash of its id and text; rows with equal ids and texts come equally often.
    Null and empty texts have no tokens, and a rate like that of other texts with their posterior. Labels of one
    domain, or none, give all documents the same posterior.
    """
    kept, columns = set_aside(docs, "n_tokens", "posterior", "rate", "copies")
    membership = mixing.learn(kept, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.sampled(mixing.mix(kept, membership), columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences.

    Null and empty texts get one row without a place; a very long text is cut into pieces; each repeated row has places of its own, and
    ties of sizes go by doc_id, piece and copy.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: Trained classifiers, connected components and packing aren't SQL. The operators of the stages have brute-force tests of their own;
#: the test of the stages checks columns, ids and that packing loses no token.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        done.write.option("compression", "zstd").parquet(f"{base}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
