"""From raw documents to packed training sequences.

Toxic documents go, one document of each near-duplicate group stays, documents that hold
benchmark passages go, personal data is replaced by its kind, and what is left is packed. Every
stage works on all that the one before kept and returns the columns of ``documents``; the last
returns where each piece of a document is placed. Verdicts depend on the text alone, so rows are
matched by a digest of it and rows that share an id or have none are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytally.llm import catalog, decontamination, near_duplicates, packing, personal_data, toxicity
from paytally.storage import fresh_path


def _digest() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of a model fitted on the labelled documents."""
    model = toxicity.fit(catalog.table(spark, sf_dir, "documents"), catalog.table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows whole in one column, so that no name of theirs meets one of ours, with id and digest."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), _digest().alias("digest"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; of rows alike in id and text, one."""
    kept = near_duplicates.representatives(docs)
    keyed = _keyed(docs)
    same = keyed["id"].eqNullSafe(kept["doc_id"]) & (keyed["digest"] == kept["text_digest"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["id", "digest"]).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages."""
    return decontamination.reject(docs, catalog.table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced and the length brought up to date."""
    cleaned = personal_data.redact(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.pack(docs, catalog.tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash", deduplicate),
    ("decontamination", decontaminate),
    ("personal_data", redact),
    ("packing", pack),
]

#: Learned weights, shingle sets and token ids are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
