"""Mixing sources to target weights: token totals per source, repetition rates, hash-seeded copies of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readsift.llm.common import WORD, cut, fresh

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "readsift-mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the id, or the text where there is no id: 52 bits of an MD5."""
    said = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    hashed = F.md5(F.concat(F.lit(seed + ":"), said))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in order of code points, null last, get ``weights`` in turn. Their targets share the sum of all sizes by
    weight; a target stops at ``cap`` times the source's size and the rest is shared anew. That is a water level: with
    sources ordered by ``cap * size / weight``, those before the first whose capacity reaches the level are full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((turn - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("full", F.col("source_size") * cap)
    order = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    per = (
        per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("before", F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    left = F.col("total") - F.col("before")
    per = per.withColumn("level", F.when(F.col("full") * F.col("rest") >= left * F.col("w"), left.cast("double") / F.col("rest")))
    per = per.withColumn("top", F.max("level").over(Window.partitionBy()))
    target = F.when(F.col("level").isNotNull(), F.col("w") * F.col("top")).otherwise(F.col("full").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, *, text="text", source="source", doc_id="doc_id", weights=WEIGHTS, cap=CAP, seed=SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (long).

    Copies are ``floor(rate)`` plus one with the probability of the fraction, where rate = target / source_size; the
    draw depends on seed and id alone (without an id, on seed and text), so reruns agree and rows that repeat an id share
    it. A null text has size 0; a null source is a source of its own; a source without words has rate 0. Other columns
    are ignored. The totals per source are combined before the shuffle, and the join back may be split by adaptive
    execution, so a source that holds most rows is no hot spot. The global windows see one row per source, in one task:
    sources are names of collections, up to millions of them, not hosts or paths without number.
    """
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), draw(F.col(doc_id), F.col(text), seed).alias("draw"))
    targets = source_targets(sizes.drop("draw"), weights, cap).withColumnRenamed("source", "of")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = (F.col("draw") < rate - whole).cast("long")
    return joined.withColumn("copies", whole.cast("long") + extra).drop("draw")


#: Sources up to which their rates are broadcast; beyond, adaptive execution chooses, and splits a source of many rows.
MOST_BROADCAST = 10_000


def mix_documents(docs: DataFrame, *, text="text", source="source", doc_id="doc_id", weights=WEIGHTS, cap=CAP, seed=SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns that came in, whatever their names.

    What a document's source is taken at is enough to tell its copies, so one rate per source meets the documents.
    """
    sizes = docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    targets = cut(source_targets(sizes, weights, cap))
    of, rate, copy = (fresh(docs, name) for name in ("of", "rate", "copy"))
    rates = targets.select(F.col("source").alias(of), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate))
    if targets.count() <= MOST_BROADCAST:
        rates = F.broadcast(rates)
    joined = docs.join(rates, docs[source].eqNullSafe(F.col(of)))
    whole = F.floor(F.col(rate))
    copies = (whole + (draw(docs[doc_id], docs[text], seed) < F.col(rate) - whole).cast("long")).cast("int")
    taken = joined.withColumn(of, copies).where(F.col(of) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(of)))).select(*docs.columns)
