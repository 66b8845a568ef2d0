"""A corpus pipeline over ``documents``: language, near-duplicates, personal data, mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm import langid, mixing, packing, pii, shingles
from fringeflow.llm.common import table, words_of


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; those rejected, or without a letter, go."""
    judged = langid.identify(docs, "doc_id", "text", "lang")
    return judged.where(F.col(judged.columns[-1])["accepted"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id."""
    return shingles.without_similar(docs, "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.personal_data(docs, "text")
    found = found.withColumn("text", F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col(found.columns[-1]))))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources meet their target weights."""
    return mixing.mix_sources(docs, "doc_id", "source", words_of(F.col("text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of permitted lengths, in words."""
    return packing.pack_documents(docs, "doc_id", words_of(F.col("text")))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", pack),
]

#: Fingerprints, language models and packing are not SQL: tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
