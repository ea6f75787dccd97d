"""Counts of a read from its patterns: hits per bin, best bin, counts, unique counts and proportions per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsift.functions.columns import let, once


def hits_of_bin(patterns: Column, bin_: Column) -> Column:
    return F.aggregate(patterns, F.lit(0).cast("long"), lambda a, p: a + F.when(F.array_contains(p["bins"], bin_), p["n"]).otherwise(0))


def hits_per_bin(scored: DataFrame) -> DataFrame:
    """read_ord, bin, hits for every bin that a read hits."""
    each = scored.select("read_ord", F.explode("patterns").alias("p")).select("read_ord", F.explode("p.bins").alias("bin"), "p.n")
    return each.groupBy("read_ord", "bin").agg(F.sum("n").alias("hits"))


def best_bins(patterns: Column, category_bins: list[list[int]]) -> Column:
    """Per category its bin with the most hits, the lowest of equal ones, as struct(hits, bin)."""
    score = lambda b: F.struct(hits_of_bin(patterns, b).alias("hits"), (-b).alias("minus"))
    best = lambda bins: F.array_max(F.transform(F.array(*map(F.lit, bins)), score))
    plain = lambda s: F.struct(s["hits"].alias("hits"), (-s["minus"]).alias("bin"))
    return F.array(*(let(best(bins), plain) for bins in category_bins))


def unique_counts(patterns: Column, best: Column) -> Column:
    """Per category the hashes that hit its best bin and no other category's best bin."""

    def of(b: Column) -> Column:
        alone = lambda p: F.array_contains(p["bins"], b) & (F.size(F.filter(best, lambda x: F.array_contains(p["bins"], x))) == 1)
        return F.aggregate(patterns, F.lit(0).cast("long"), lambda a, p: a + F.when(alone(p), p["n"]).otherwise(0))

    return F.transform(best, of)


def shares(counts: Column, num_hashes: Column) -> Column:
    """Counts over the number of hashes; NaN for a read without hashes."""
    return F.transform(counts, lambda c: F.when(num_hashes > 0, c / num_hashes).otherwise(F.lit(float("nan"))))


def category_scores(hit: DataFrame, category_bins: list[list[int]]) -> DataFrame:
    """The rows with best_bin, counts, unique_counts, props and unique_props: arrays by category, computed once."""
    best = once(hit, "__best", best_bins(F.col("patterns"), category_bins))
    out = once(best, "__unique", unique_counts(F.col("patterns"), F.col("__best.bin")))
    each = F.struct(shares(F.col("__best.hits"), F.col("num_hashes")).alias("props"), shares(F.col("__unique"), F.col("num_hashes")).alias("unique_props"))
    out = once(out, "__shares", each)
    return out.select(*hit.columns, F.col("__best.bin").alias("best_bin"), F.col("__best.hits").alias("counts"), F.col("__unique").alias("unique_counts"), "__shares.props", "__shares.unique_props")


def long_scores(scored: DataFrame) -> DataFrame:
    """One row per read and category."""
    zipped = F.arrays_zip("best_bin", "counts", "unique_counts", "props", "unique_props")
    each = scored.select("read_ord", "num_hashes", F.posexplode_outer(zipped).alias("category_idx", "z"))
    return each.select("read_ord", "category_idx", "num_hashes", "z.best_bin", F.col("z.counts").alias("count"), F.col("z.unique_counts").alias("unique_count"), F.col("z.props").alias("prop"), F.col("z.unique_props").alias("unique_prop"))


def rollup(calls: DataFrame, categories: list[str]) -> DataFrame:
    """category, n: reads called for each category, zeros too, and those without a call as "unclassified"."""
    spark = calls.sparkSession
    names = F.broadcast(spark.createDataFrame([(c,) for c in [*categories, "unclassified"]], "category string"))
    found = calls.groupBy(F.coalesce("call", F.lit("unclassified")).alias("category")).agg(F.count("*").alias("n"))
    return names.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
