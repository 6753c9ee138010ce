"""A training-data pipeline over ``documents``: language, near-duplicates, repeated passages,
secrets, packing. Each stage works on what its predecessor wrote; all but the last return the
columns of ``documents``, whatever others there are and however they are named.

Defined cases, besides those of each stage: an empty table stays empty through all of them; rows that
share a doc_id are one document and stay or go together; a row without doc_id is never near or equal to
another, so it stays if its language is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import langid, near_dup, packing, scratch, secrets, suffix_dedup
from tarnwick.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty ones too), and those whose two likeliest languages
    can't be told apart, go; so do all where no row tells its language."""
    scratch.ship(spark)
    model = langid.fit(docs)
    told = langid.identify(docs.select(F.struct("*").alias("row"), "text"), model, keep=["row"])
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the least doc_id stays. Texts
    without words are near nothing and stay."""
    scratch.ship(spark)
    gone = near_dup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs.doc_id == gone.gone, "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that occur earlier are cut out of the texts. Documents stay, those
    too that are left empty; null texts stay null."""
    scratch.ship(spark)
    return suffix_dedup.remove_repeats(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts by a mark; null texts stay null."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all texts with their sequences; a null or empty text is its end id alone."""
    scratch.ship(spark)
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = scratch.mark()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
            scratch.drop_since(begin, docs)
    return docs
