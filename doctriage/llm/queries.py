"""The operators over whole tables, as registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.llm import chat, contamination, covertree, hmm, lexical, packing, passages, repeats, secrets, simhash, tokens, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, links at 4 bits or fewer."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"), words=4, distance=4, table=simhash.LOWER)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are not learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    labels = table(spark, sf_dir, "labels")
    return toxicity.fit(docs, labels.where(~held_out()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each of its roles but the system."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that start twice."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans per document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE counts; more than 512 is over the limit."""
    found = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which 0.8 of the 5-word shingles are in a document."""
    return contamination.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows for every 50th vector."""
    return covertree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the rows whose crc32 leaves a remainder to 10."""
    return hmm.score(table(spark, sf_dir, "documents"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that also start at an earlier place."""
    found = passages.remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 16 whitened components of every vector."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_toxicity, op3_chat, op4_repeats, op5_packing, op6_secrets, op7_token_counts, op8_contamination, op9_top_k, op10_hmm,
        op11_passages, op12_lexical, op13_whitening,
    )
}
#: The same results as SQL, where SQL can express them at a usable speed.
ORACLES: dict[str, str] = {"op3_chat": chat.ORACLE, "op9_top_k": covertree.ORACLE, "op12_lexical": lexical.ORACLE}
