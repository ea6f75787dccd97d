"""A corpus pipeline: language ID, near-duplicates, secrets, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readsift.llm import bpe, langid, minhash, mixing, secrets
from readsift.llm.common import new_folder, remove


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those without letters, without text or with too small a lead of their language go."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies."""
    return minhash.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced by a mark and n_chars set anew where that happened."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights of its source say: none, once or several times."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with their number and the digests of ids and decoded bytes."""
    return bpe.digest(bpe.round_trip(docs), ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express kernel regression, near-duplicate classes, a forest or byte-pair merges; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, in a new folder of the shared place. What a stage wrote goes when the next has
    written; the last one's rows stay."""
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        now = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if before:
            remove(before)
        before = now
    return docs
