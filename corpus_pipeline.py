"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents; the last
one returns the token ids. `run` writes every stage's result as Parquet into the shared folder and
reads it again, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.llm import line_dedup, minhash_bayes, mixing, sentencepiece_bpe, toxicity
from loglathe.llm.common import ensure_checkpoint_dir, n_words, set_aside, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon learned from the labels doesn't call toxic."""
    rows, back = set_aside(docs, toxicity.ADDED)
    scored = toxicity.scored(rows, table(spark, sf_dir, "labels"))
    return scored.where(F.col("predicted") == 0).drop(*toxicity.ADDED).withColumnsRenamed(back).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines close to an earlier one; documents of which nothing is left go."""
    return line_dedup.drop_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates."""
    return minhash_bayes.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, in the output shards that it draws, shuffled there."""
    return mixing.mixture(docs, "doc_id", "source", n_words(F.col("text"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to its text."""
    done = sentencepiece_bpe.encode(docs, "text")
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_bpe.SPACE, " ")
    return done.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: The stages score, cluster and tokenize by methods that SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
