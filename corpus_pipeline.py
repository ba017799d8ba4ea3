"""A corpus made ready for training: five stages, each written and read again.

toxicity: documents that the model rejects go.  near_copies: one document of each group of
near copies stays.  benchmark: documents that hold a test item go.  secrets: secrets
are replaced in the texts, all documents stay.  packing: the texts become token sequences.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.llm import contamination, packing, secrets, simhash, toxicity
from doctriage.llm.common import shared_folder
from doctriage.llm.queries import table, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; all of them if the labels gave nothing to learn, as a model without terms rejects nothing."""
    model = toxicity_model(spark, docs, sf_dir)
    if not model.terms and not model.stems:
        return docs
    score = toxicity.score_of(model, spark)
    return docs.where(score(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 0.8 of their 5-word shingles or more, the first."""
    return simhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.without_contained(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows."""
    clean = docs.withColumn("text", secrets.redaction(spark)(F.col("text")))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]
#: Fingerprints, a fitted model and a tokenizer are beyond SQL: stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is a table in the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
