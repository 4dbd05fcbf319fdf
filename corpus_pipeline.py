"""A corpus from raw documents: five stages, each written as Parquet and read by the next one.

Defined results. Null or empty texts: rejected by the first stage, as too short. Null ids, sources and
other columns: kept as they are. Very long texts: handled whole. Repeated rows and copies: one row of each
group stays after the second stage; the fourth may take it more than once. Empty table: no rows.
Extra columns, whatever their names: kept up to the last stage; ``n_chars``, if there, follows the masked text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import mixing, packing, quality_rules, secret_scan, simhash_dedup
from passagework.llm.common import collecting, remove, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return simhash_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars, if there, follows."""
    masked = secret_scan.redacted(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mixing_weights),
    ("best_fit_packing", pack),
]

#: Tokenizing and dependent rounding have no SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it.

    Once a stage is written, nothing reads what it was made from any more, so that is removed.
    """
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(STAGES):
        with collecting() as made:
            docs = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                return docs
            docs = staged(docs, name)
        remove(spark, old + made[:-1])
        old = made[-1:]
    return docs
