"""Preparing a training corpus: five stages over ``documents``, each a job of its own.

Each stage reads what its predecessor kept and works on all of it. run() writes every
stage's rows as Parquet to the shared folder before the next one reads them, so a lost
executor costs the tasks it ran and nothing earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bag_minhash, byte_merges, mixing, personal, quality
from tidemark.llm.registry import fresh, table
from tidemark.session import cut_lineage, prepare


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts, all columns as they were."""
    prepare(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")
    return quality.score(docs, model, score_col=score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id."""
    return bag_minhash.one_of_each_group(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars, if there, follows the text."""
    hidden = personal.redact(docs, personal.fit(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        hidden = hidden.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return hidden


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix; one that is taken n times is n rows."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and the digest of the bytes they decode to."""
    ranks, pattern = byte_merges.public_ranks()
    named = docs.select("doc_id", "lang", "source", "text")
    return byte_merges.encode_texts(named, ranks, pattern, decoded_col="decoded").select(
        "doc_id", "lang", "source", "ids", F.call_function("div", F.octet_length("ids"), F.lit(4)).alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", drop_near_copies),
    ("PII", hide_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL cannot express the classifier, the random field or BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
