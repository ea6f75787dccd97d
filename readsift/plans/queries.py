"""Queries of the operators over the supplied tables, and the same in SQL.

There is no DNA in the tables, so letters stand for bases (``text_as_bases``). Every document is a read. References are
the other texts: bin 0 is ``benchmark``, bin 1 ``conversations``, and bins 2 to 6 are ``pages`` by the language that
the markup names (en, de, es, fr, other).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsift.config import ClassifySettings, DehostSettings, IndexSettings
from readsift.functions import columns as C
from readsift.functions import stats
from readsift.operators import calling, counts, models, probe, sinks, training
from readsift.operators import index as ix
from readsift.operators.minimiser import minimisers, minimisers_by_windows, paired_minimisers
from readsift.plans import pipeline

SETTINGS = IndexSettings()
PAGE_BINS = {"en": 2, "de": 3, "es": 4, "fr": 5}
BINARY = ["human", "human", "human", "microbe", "microbe", "microbe", "microbe"]
BY_LANGUAGE = ["misc", "misc", "en", "de", "es", "fr", "other"]
TO_FIT = 10
DEHOST = DehostSettings(dist="beta", emission="distinct", confidence=1, min_proportion_diff=0.0, min_quality=11, host_unique_prop_lo_threshold=0.5)
CLASSIFY = ClassifySettings(emission="distinct", min_quality=11, min_compression=0.0, confidence=1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    quality = (10 + F.col("n_chars") % 20).cast("double")
    return docs.select(F.col("doc_id").alias("read_ord"), F.concat(F.lit("doc"), F.col("doc_id")).alias("id"), C.text_as_bases(F.col("text")).alias("seq"), F.lit(None).cast("string").alias("qual"), quality.alias("mean_quality"))


def refs(spark, sf_dir) -> DataFrame:
    bases = lambda c: C.text_as_bases(F.coalesce(F.col(c), F.lit(""))).alias("seq")
    lang = F.regexp_extract(F.coalesce("html", F.lit("")), 'lang="([a-z]+)"', 1)
    bin_ = F.coalesce(F.create_map(*(F.lit(x) for kv in PAGE_BINS.items() for x in kv))[lang], F.lit(6))
    parts = [
        table(spark, sf_dir, "benchmark").select(F.lit(0).alias("bin"), bases("text")),
        table(spark, sf_dir, "conversations").select(F.lit(1).alias("bin"), bases("text")),
        table(spark, sf_dir, "pages").select(bin_.alias("bin"), bases("html")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def bins(spark, categories=BINARY) -> DataFrame:
    names = sorted(set(categories))
    return spark.createDataFrame([(i, f"bin{i}", c, names.index(c)) for i, c in enumerate(categories)], "bin int, path string, category string, category_idx int")


def index(spark, sf_dir, categories=BINARY) -> ix.IndexModel:
    return ix.build(bins(spark, categories), refs(spark, sf_dir), SETTINGS)


def scored(spark, sf_dir, categories=BINARY, how="join") -> DataFrame:
    model = index(spark, sf_dir, categories)
    settings = DehostSettings(emission="distinct", probe=how)
    return pipeline.score(reads(spark, sf_dir), model, settings)


def likely(spark, sf_dir, categories=BINARY, dist="beta") -> DataFrame:
    return models.probabilities(scored(spark, sf_dir, categories), [models.prior(dist)] * len(set(categories)))


def _r(c, name=None):
    return F.round(c, 6).alias(name or c)


# --- minimisers and index


def minimisers_distinct(spark, sf_dir):
    found = reads(spark, sf_dir).select("read_ord", F.explode(minimisers(F.col("seq"), SETTINGS.kmer_size, SETTINGS.window_size, "distinct")).alias("h"))
    return found


def minimisers_emitted(spark, sf_dir):
    exact, distinct = (F.size(minimisers(F.col("seq"), emission=e)).alias(f"n_{e}") for e in ("exact", "distinct"))
    return reads(spark, sf_dir).select("read_ord", exact, distinct)


def kmer_window_min(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", C.text_as_bases(F.col("text")).alias("seq"))
    return minimisers_by_windows(items, "item_id", "seq")


def bin_stats(spark, sf_dir):
    return index(spark, sf_dir).bin_stats


def bins_by_size(spark, sf_dir):
    from pyspark.sql import Window

    return bin_stats(spark, sf_dir).withColumn("place", F.row_number().over(Window.orderBy("n_hashes", "bin")))


def max_bin(spark, sf_dir):
    return ix.largest(bin_stats(spark, sf_dir))


def bloom_sizing(spark, sf_dir):
    return ix.filter_bits(bin_stats(spark, sf_dir), SETTINGS)


def bloom_capacity(spark, sf_dir):
    small = IndexSettings(bits=12_000)
    return ix.overfull(bin_stats(spark, sf_dir), small)


def optimize_layout(spark, sf_dir):
    return ix.optimize_layout(index(spark, sf_dir)).bin_stats


# --- probe and counts


def membership_probe(spark, sf_dir):
    found = probe.probe_rows(minimisers_distinct(spark, sf_dir), index(spark, sf_dir))
    return found.select("read_ord", "h", F.concat_ws(",", F.col("bins").cast("array<string>")).alias("bins"))


def hits_per_bin(spark, sf_dir):
    return counts.hits_per_bin(scored(spark, sf_dir))


def hits_per_bin_local(spark, sf_dir):
    return counts.hits_per_bin(scored(spark, sf_dir, how="local"))


def hits_per_bin_filter(spark, sf_dir):
    return counts.hits_per_bin(scored(spark, sf_dir, how="bloom"))


def category_scores(spark, sf_dir):
    rows = counts.long_scores(scored(spark, sf_dir))
    return rows.select("read_ord", "category_idx", "num_hashes", "best_bin", "count", "unique_count", _r("prop"), _r("unique_prop"))


def category_scores_by_language(spark, sf_dir):
    rows = counts.long_scores(scored(spark, sf_dir, BY_LANGUAGE))
    return rows.select("read_ord", "category_idx", "num_hashes", "best_bin", "count", "unique_count", _r("prop"), _r("unique_prop"))


# --- training and models


def training_candidates(spark, sf_dir):
    return training.candidates(scored(spark, sf_dir)).select("read_ord", "category_idx", "side", _r("value"))


def training_first_n(spark, sf_dir):
    return training.first_n(training.candidates(scored(spark, sf_dir)), TO_FIT).select("read_ord", "category_idx", "side", _r("value"))


def _events(spark, sf_dir) -> DataFrame:
    """All events; the values, which are 0 and more, come to lie between 0 and 1."""
    share = (F.col("value") + 1) / (F.col("value") + 1000)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("category_idx"), F.lit("pos").alias("side"), share.alias("value"))


def gamma_fit(spark, sf_dir):
    shape, scale = stats.gamma_fit(F.col("mean_above"), F.col("mean_log"))
    return models.moments(_events(spark, sf_dir)).select(F.col("category_idx").alias("event_type"), "n", _r("mean"), _r(shape, "shape"), _r(scale, "scale"))


def beta_fit(spark, sf_dir):
    alpha, beta = stats.beta_fit(F.col("mean"), F.col("variance"))
    return models.moments(_events(spark, sf_dir)).select(F.col("category_idx").alias("event_type"), "n", _r("variance"), _r(alpha, "alpha"), _r(beta, "beta"))


def kde_bandwidth(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.col("category_idx").alias("event_type")).agg(_r(stats.bandwidth(F.col("value")), "h"))


def kde_density(spark, sf_dir):
    """Density of the account balances of each nation's suppliers, at the balance of its customers on average."""
    values = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), (F.col("s_acctbal") / 10000).alias("value"))
    at = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.round(F.avg("c_acctbal") / 10000, 6).alias("x"))
    return models.sample_density(at, values, 0.1).select(F.col("key").alias("c_nationkey"), "x", _r("density"))


def _scores(dist):
    def query(spark, sf_dir):
        rows = likely(spark, sf_dir, dist=dist)
        return rows.select("read_ord", F.posexplode_outer("probabilities").alias("category_idx", "p")).select("read_ord", "category_idx", _r("p", "probability"))

    return query


# --- calls and outputs


def _called(spark, sf_dir):
    return calling.call_host(likely(spark, sf_dir), sorted(set(BINARY)), index(spark, sf_dir).host_index(), DEHOST)


def call_host(spark, sf_dir):
    return _called(spark, sf_dir).select("read_ord", "length", "confidence", "call")


def call_category(spark, sf_dir):
    rows = calling.call_category(likely(spark, sf_dir, BY_LANGUAGE), sorted(set(BY_LANGUAGE)), CLASSIFY)
    return rows.select("read_ord", "length", "confidence", "call")


def result_rollup(spark, sf_dir):
    return counts.rollup(_called(spark, sf_dir), sorted(set(BINARY)))


def assignment_rows(spark, sf_dir):
    rows = sinks.assignments(_called(spark, sf_dir), sorted(set(BINARY)))
    each = rows.select("status", "read_id", "call", "length", "num_hashes", "mean_quality", "confidence", F.explode_outer("details").alias("d"))
    return each.select("status", "read_id", "call", "length", "num_hashes", "mean_quality", "confidence", "d.category", "d.count", _r(F.col("d.prop"), "prop"), _r(F.col("d.unique_prop"), "unique_prop"), _r(F.col("d.probability"), "probability"))


def assignment_text(spark, sf_dir):
    return sinks.assignment_text(sinks.assignments(_called(spark, sf_dir), sorted(set(BINARY))))


def minimisers_of_items(spark, sf_dir):
    """Every emission of the benchmark's items, with its place."""
    items = table(spark, sf_dir, "benchmark").where("text is not null")
    return items.select("item_id", F.posexplode(minimisers(C.text_as_bases(F.col("text")))).alias("place", "h"))


def filter_contains_hits(spark, sf_dir):
    """The exact hits per bin, and whether the filter has them all."""
    exact = hits_per_bin(spark, sf_dir)
    rough = counts.hits_per_bin(scored(spark, sf_dir, how="bloom")).select("read_ord", "bin", F.col("hits").alias("rough"))
    return exact.join(rough, ["read_ord", "bin"], "left").select("read_ord", "bin", "hits", (F.coalesce("rough", F.lit(0)) >= F.col("hits")).alias("contained"))


def _trained(dist):
    """Scores by models that are fitted to the first reads where there are enough of them."""

    def query(spark, sf_dir):
        settings = DehostSettings(dist=dist, emission="distinct", training="first_n", num_reads_to_fit=TO_FIT)
        rows = pipeline.score(reads(spark, sf_dir), index(spark, sf_dir), settings).persist(StorageLevel.DISK_ONLY)  # read twice
        rows = models.probabilities(rows, pipeline.fitted(rows, len(set(BINARY)), settings))
        return rows.select("read_ord", F.posexplode_outer("probabilities").alias("category_idx", "p")).select("read_ord", "category_idx", F.round("p", 5).alias("probability"))

    return query


def read_quality(spark, sf_dir):
    """Mean quality of reads whose quality string is the visible ASCII of a document, alone and with that of its mate."""
    qual = F.regexp_replace(F.coalesce("text", F.lit("")), "[^!-~]", "")
    docs = table(spark, sf_dir, "documents").select("doc_id", qual.alias("q"), F.reverse(F.substring(qual, 1, 100)).alias("r"))
    return docs.select("doc_id", _r(C.mean_quality(F.col("q")), "single"), _r(C.mean_quality(F.col("q"), F.col("r")), "paired"))


def normalised_bases(spark, sf_dir):
    """The letters of a document as bases: upper case, U as T, all but A, C, G and T as N."""
    docs = table(spark, sf_dir, "documents").select("doc_id", C.normalise(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")).alias("s"))
    return docs.select("doc_id", C.length(F.col("s")).alias("length"), F.md5("s").alias("digest"))


def paired_hashes(spark, sf_dir):
    """Hashes of the first turns of users and assistants as mates: no window spans the two."""
    one, two = _mates(spark, sf_dir)
    both = one.select("read_ord", F.col("seq").alias("a")).join(two.select("read_ord", F.col("seq").alias("b")), "read_ord", "full_outer")
    return both.select("read_ord", F.size(paired_minimisers(F.col("a"), F.col("b"), emission="distinct")).alias("n"), C.length(F.col("a"), F.col("b")).alias("length"))


def assignment_lines(spark, sf_dir):
    """The text of the assignments but for the compression ratio, which depends on the build of a library and is 0 here."""
    rows = sinks.assignments(_called(spark, sf_dir).withColumn("compression", F.lit(0.0)), sorted(set(BINARY)))
    return sinks.assignment_text(rows)


def extract_human(spark, sf_dir):
    return sinks.extract(_called(spark, sf_dir), reads(spark, sf_dir), "human").select("read_ord", "id", F.length("seq").alias("n"))


def dehost_trained(spark, sf_dir):
    """The whole command with exact emission and kernel densities fitted to the first reads."""
    settings = DehostSettings(training="first_n", num_reads_to_fit=TO_FIT, confidence=1, min_quality=11)
    return pipeline.dehost(reads(spark, sf_dir), index(spark, sf_dir), settings).select("read_ord", "num_hashes", "confidence", "call")


def read_features(spark, sf_dir):
    return reads(spark, sf_dir).where("seq <> ''").select("read_ord", C.read_id(F.concat_ws(" ", "id", "mean_quality")).alias("id"), C.length(F.col("seq")).alias("length"), "mean_quality")


def compression_ratio(spark, sf_dir):
    return reads(spark, sf_dir).select("read_ord", _r(C.compression_ratio(F.col("seq")), "ratio"))


def pair_join(spark, sf_dir):
    """First turns of users and assistants as mates, of the conversations that have both."""
    from readsift.sources.sequences import pair

    a, b = _mates(spark, sf_dir)
    joined = pair(a.join(b, "read_ord", "left_semi"), b.join(a, "read_ord", "left_semi"))
    return joined.select("read_ord", "id", F.length("seq1").alias("n1"), F.length("seq2").alias("n2"))


def _mates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    talk = table(spark, sf_dir, "conversations").where("text is not null")
    mate = lambda role, n: talk.where(F.col("role") == role).groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")).select(F.col("conv_id").alias("read_ord"), F.concat("conv_id", F.lit(f"/{n}")).alias("id"), C.text_as_bases(F.col("t")).alias("seq"), F.lit(None).cast("string").alias("qual"))
    return mate("user", 1), mate("assistant", 2)


QUERIES = {
    q.__name__: q
    for q in (
        minimisers_distinct, minimisers_emitted, minimisers_of_items, kmer_window_min, bin_stats, bins_by_size, max_bin, bloom_sizing, bloom_capacity, optimize_layout,
        membership_probe, hits_per_bin, hits_per_bin_local, hits_per_bin_filter, filter_contains_hits, category_scores, category_scores_by_language,
        training_candidates, training_first_n, gamma_fit, beta_fit, kde_bandwidth, kde_density,
        call_host, call_category, result_rollup, assignment_rows, assignment_text, assignment_lines, extract_human, dehost_trained, read_features, read_quality, normalised_bases, compression_ratio, pair_join, paired_hashes,
    )
} | {f"trained_{d}": _trained(d) for d in ("gamma", "beta", "kde")} | {f"{d}_score": _scores(d) for d in ("gamma", "beta", "kde")}
