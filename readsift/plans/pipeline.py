"""The three commands as plans: index, classify, dehost."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsift.config import ClassifySettings, DehostSettings, IndexSettings
from readsift.functions import columns as C
from readsift.operators import calling, counts, models, probe, training
from readsift.operators import index as ix
from readsift.operators.index import IndexModel
from readsift.operators.minimiser import minimisers, paired_minimisers
from readsift.sources.sequences import read_sequences

LOG = logging.getLogger("readsift")
#: Quality, length and repetition of short reads: least length of single reads and of pairs.
MIN_LENGTH, MIN_LENGTH_PAIRED = 140, 80


def references(spark: SparkSession, bins: DataFrame) -> DataFrame:
    """bin, seq of all files of a manifest, which has 255 at most."""
    parts = [read_sequences(spark, r["path"]).select(F.lit(r["bin"]).alias("bin"), "seq") for r in bins.orderBy("bin").collect()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index(spark: SparkSession, manifest: DataFrame, path: str, settings: IndexSettings = IndexSettings()) -> IndexModel:
    """Build and store the index of a manifest's files."""
    built = ix.save(ix.build(manifest, references(spark, manifest), settings), path)
    for r in ix.overfull(built.bin_stats, settings).collect():
        LOG.warning("bin %s holds %s hashes, more than %s", r["bin"], r["n_hashes"], r["max_num_hashes"])
    return built


def features(reads: DataFrame, index_: IndexModel, emission: str = "exact") -> DataFrame:
    """read_ord, id, length, mean_quality, compression, minimisers of single reads (seq, qual) or pairs (seq1, ...).

    Reads without bases are passed over.
    """
    k, w = index_.settings.kmer_size, index_.settings.window_size
    if "seq1" in reads.columns:
        one, two = F.col("seq1"), F.col("seq2")
        found = paired_minimisers(one, two, k, w, emission)
        size, quality, whole = C.length(one, two), C.mean_quality(F.col("qual1"), F.col("qual2")), F.concat(one, two)
    else:
        found, size, quality, whole = minimisers(F.col("seq"), k, w, emission), C.length(F.col("seq")), C.mean_quality(F.col("qual")), F.col("seq")
    if "mean_quality" in reads.columns:
        quality = F.col("mean_quality")
    return reads.where(size > 0).select("read_ord", "id", size.alias("length"), quality.alias("mean_quality"), C.compression_ratio(whole).alias("compression"), found.alias("minimisers"))


def score(reads: DataFrame, index_: IndexModel, settings) -> DataFrame:
    """Features and counts of the reads, by category."""
    hit = probe.hits(features(reads, index_, settings.emission), index_, settings.probe)
    return counts.category_scores(hit, index_.category_bins())


def fitted(scored: DataFrame, categories: int, settings) -> list[models.Model]:
    """Priors, or models fitted to the first reads that speak for or against each category."""
    if settings.training == "none":
        return [models.prior(settings.dist, settings.kde_prior) for _ in range(categories)]
    seen = scored.where(F.col("read_ord") < settings.training_window) if settings.training_window else scored
    sample = training.first_n(training.candidates(seen, settings.lo_hi_threshold), settings.num_reads_to_fit)
    return models.fit(sample, categories, settings.dist, settings.num_reads_to_fit, settings.kde_prior)


def call(reads: DataFrame, index_: IndexModel, settings: ClassifySettings | DehostSettings) -> DataFrame:
    """One row per read with its scores, probabilities, confidence and call."""
    paired = "seq1" in reads.columns
    rule = settings.paired_rule if paired and settings.rule == "host" else settings.rule
    categories = index_.categories()
    host = index_.host_index() if rule == "host" else -1
    if rule == "host" and len(categories) != 2:
        raise ValueError("the rule of host against other needs exactly two categories")
    scored = score(reads, index_, settings)
    if settings.training != "none":
        from pyspark import StorageLevel

        scored = scored.persist(StorageLevel.DISK_ONLY)  # read twice: for the models and for the calls; freed with the plan
    likely = models.probabilities(scored, fitted(scored, len(categories), settings))
    least = settings.min_length if settings.min_length is not None else MIN_LENGTH_PAIRED if paired else MIN_LENGTH
    if rule == "host":
        return calling.call_host(likely, categories, host, settings, least)
    return calling.call_category(likely, categories, settings, least)


def classify(reads: DataFrame, index_: IndexModel, settings: ClassifySettings = ClassifySettings()) -> DataFrame:
    return call(reads, index_, settings)


def dehost(reads: DataFrame, index_: IndexModel, settings: DehostSettings = DehostSettings()) -> DataFrame:
    return call(reads, index_, settings)
