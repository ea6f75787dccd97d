"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsift.llm import bpe, embeddings, langid, minhash, mixing, pii, quality, secrets, sql, substring, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents"))
    return pii.digest(found)


def op2_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_mixing(spark, sf_dir):
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_secrets(spark, sf_dir):
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op5_embeddings(spark, sf_dir):
    return embeddings.link(table(spark, sf_dir, "embeddings"))


def op6_fertility(spark, sf_dir):
    return quality.measure(table(spark, sf_dir, "documents")).drop("n_tokens")


def op7_warc(spark, sf_dir):
    found = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring(spark, sf_dir):
    found = substring.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_bpe(spark, sf_dir):
    return bpe.digest(bpe.round_trip(table(spark, sf_dir, "documents")))


def op10_minhash(spark, sf_dir):
    return minhash.deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii, "op2_langid": op2_langid, "op3_mixing": op3_mixing, "op4_secrets": op4_secrets, "op5_embeddings": op5_embeddings, "op6_fertility": op6_fertility, "op7_warc": op7_warc, "op8_substring": op8_substring, "op9_bpe": op9_bpe, "op10_minhash": op10_minhash}
ORACLES = sql.ORACLES
