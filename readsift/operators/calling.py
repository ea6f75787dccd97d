"""Calls: N-way between categories, or host against the other category, under thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CONFIDENCE = 255


def _good(s, min_length: int) -> Column:
    sound = (F.col("mean_quality") >= s.min_quality) & (F.col("length") >= min_length)
    return sound & (F.coalesce("compression", F.lit(0.0)) >= s.min_compression) if s.min_compression > 0 else sound  # a ratio is never below 0


def _named(index: Column, categories: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, categories)), index)


def call_category(scored: DataFrame, categories: list[str], s, min_length: int = 140) -> DataFrame:
    """The rows with call (null for none) and confidence, by the N-way rule.

    The two categories with the highest unique counts, the first listed of equal ones, must differ by more than the
    confidence asked for and be ordered alike by probability, count and proportion.
    """
    if len(categories) < 2:
        raise ValueError("the N-way rule needs two categories")
    ranked = F.array_sort(F.transform("unique_counts", lambda u, i: F.struct((-u).alias("minus"), i.alias("i"))))
    out = scored.withColumn("__r", F.transform(F.slice(ranked, 1, 2), lambda x: x["i"]))
    first, second = F.col("__r")[0], F.col("__r")[1]
    at = lambda c, i: F.get(F.col(c), i)
    difference = at("unique_counts", first) - at("unique_counts", second)
    confidence = F.least(F.lit(MOST_CONFIDENCE).cast("long"), difference).cast("int")
    likely = ((at("probabilities", second) == 0) & (at("probabilities", first) > 0)) | ((confidence > s.confidence) & (at("probabilities", first) > at("probabilities", second)))
    more = at("counts", first) - at("counts", second)
    share = at("props", first) - at("props", second)
    ordered = (more >= 0) & (more >= s.min_hits) & (share >= 0) & (share >= s.min_proportion_diff) & (F.col("num_hashes") > 0)
    call = F.when(_good(s, min_length) & likely & ordered, _named(first, categories))
    return out.withColumn("confidence", confidence).withColumn("call", call).drop("__r")


def call_host(scored: DataFrame, categories: list[str], host: int, s, min_length: int = 140) -> DataFrame:
    """The rows with call (null for none) and confidence, by the rule of host against other."""
    if len(categories) != 2:
        raise ValueError("the rule of host against other needs exactly two categories")
    of = lambda c, i: F.col(c)[i]
    other = 1 - host
    uh, uo, ph, po = of("unique_props", host), of("unique_props", other), of("probabilities", host), of("probabilities", other)
    lead = of("unique_counts", host) - of("unique_counts", other)
    difference = F.when(uh < uo, -lead).otherwise(lead)
    confidence = F.least(F.lit(MOST_CONFIDENCE).cast("long"), difference).cast("int")
    sound = _good(s, min_length) & (confidence >= s.confidence) & (F.col("num_hashes") > 0)

    def ahead(u: Column, v: Column, p: Column, q: Column) -> Column:
        weighed = F.greatest(p * confidence, confidence.cast("double")) >= s.conf_prob_threshold
        return (u > v) & (u - v > s.min_proportion_diff) & (p > q) & (p - q > s.min_probability_diff) & weighed

    is_other = (uh < s.host_unique_prop_lo_threshold) & ahead(uo, uh, po, ph)
    call = F.when(sound & ahead(uh, uo, ph, po), F.lit(categories[host])).when(sound & is_other, F.lit(categories[other]))
    return scored.withColumn("confidence", F.coalesce(confidence, F.lit(0))).withColumn("call", call)
