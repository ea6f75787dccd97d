"""Counts, samples, models and calls, against a plain model and by hand."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.config import ClassifySettings, DehostSettings, IndexSettings
from readsift.functions import kernel, stats
from readsift.operators import calling, counts, index, models, probe, training
from readsift.plans import pipeline

SMALL = IndexSettings(kmer_size=7, window_size=12)
CATEGORIES = ["human", "human", "microbe", "microbe", "virus"]
NAMES = sorted(set(CATEGORIES))


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def mutated(r, s, share):
    return "".join(r.choice("ACGT") if r.random() < share else c for c in s)


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(8)
    genomes = [dna(r, 600) for _ in CATEGORIES]
    genomes[1] = mutated(r, genomes[0], 0.1)
    reads = []
    for i in range(40):
        g = r.choice(genomes)
        a = r.randrange(400)
        reads.append((i, f"r{i}", mutated(r, g[a : a + r.randint(5, 200)], 0.03), None))
    reads += [(40, "short", "ACG", None), (41, "empty", "", None), (42, "n", "N" * 100, None)]
    refs = spark.createDataFrame([(i, g) for i, g in enumerate(genomes)], "bin int, seq string")
    bins = spark.createDataFrame([(i, f"f{i}", c, NAMES.index(c)) for i, c in enumerate(CATEGORIES)], "bin int, path string, category string, category_idx int")
    return genomes, reads, index.build(bins, refs, SMALL), spark.createDataFrame(reads, "read_ord long, id string, seq string, qual string")


def plain(genomes, seq, emission="exact"):
    """Counts, unique counts and number of hashes of a read."""
    sets = [set(kernel.minimisers([g.encode()], 7, 12, "distinct")[1].tolist()) for g in genomes]
    hashes = kernel.minimisers([seq.encode()], 7, 12, emission)[1].tolist()
    hits = [sum(h in s for h in hashes) for s in sets]
    best = []
    for name in NAMES:
        mine = [i for i, c in enumerate(CATEGORIES) if c == name]
        best.append(max(mine, key=lambda i: (hits[i], -i)))
    unique = Counter()
    for h in hashes:
        where = [c for c, b in enumerate(best) if h in sets[b]]
        if len(where) == 1:
            unique[where[0]] += 1
    return len(hashes), best, [hits[b] for b in best], [unique[c] for c in range(len(NAMES))]


@pytest.mark.parametrize("how", ["join", "local", "bloom"])
@pytest.mark.parametrize("emission", ["exact", "distinct"])
def test_counts_as_the_plain_model(world, how, emission):
    genomes, reads, model, frame = world
    found = {r.read_ord: r for r in pipeline.score(frame, model, DehostSettings(emission=emission, probe=how)).collect()}
    assert set(found) == set(range(43)) - {41}
    for i, _, seq, _ in reads:
        if not seq:
            continue
        n, best, count, unique = plain(genomes, seq, emission)
        row = found[i]
        assert row.num_hashes == n and row.length == len(seq)
        if how == "bloom":
            assert all(a >= b for a, b in zip(row.counts, count))
            continue
        assert (row.best_bin, row.counts, row.unique_counts) == (best, count, unique)
        assert sum(unique) <= n and all(u <= c for u, c in zip(unique, count))
        if n:
            assert row.props == [c / n for c in count]
        else:
            assert all(map(math.isnan, row.props))


def test_filter_stays_near_its_rate(world):
    _, _, model, frame = world
    exact, rough = (counts.hits_per_bin(pipeline.score(frame, model, DehostSettings(probe=p))).agg(F.sum("hits")).collect()[0][0] for p in ("join", "bloom"))
    assert exact <= rough <= exact * 1.1 + 20


def test_pieces_of_a_long_reference(world, monkeypatch):
    genomes, _, model, _ = world
    refs = model.bins.sparkSession.createDataFrame(list(enumerate(genomes)), "bin int, seq string")
    cut = index.pieces(refs, 12, 50).select("bin", index.minimisers(F.col("seq"), 7, 12, "distinct").alias("m")).select("bin", F.explode("m").alias("h")).distinct()
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, model.hashes.select("bin", "h").collect()))


def test_store(world, tmp_path):
    model = world[2]
    again = index.save(model, f"file://{tmp_path}/x.idx")
    assert again.settings == SMALL and again.categories() == NAMES and again.category_bins() == [[0, 1], [2, 3], [4]]
    assert again.hashes.count() == model.hashes.count()
    assert sorted(map(tuple, again.bin_stats.collect())) == sorted(map(tuple, model.bin_stats.collect()))
    with pytest.raises(Exception):
        index.save(model, f"file://{tmp_path}/x.idx")
    assert again.host_index() == 0


def test_packing():
    rows = [(0, "a", 5), (1, "a", 10), (2, "a", 12), (3, "b", 11), (4, "b", 100), (5, "a", 60)]
    # half of the largest is 50: bins 0, 1, 2 share a bucket until a sum would reach it
    assert index.packed_layout(rows) == {0: 0, 1: 0, 3: 1, 2: 0, 5: 2, 4: 3}
    assert index.packed_layout([]) == {}


def test_packed_index(world):
    model = world[2]
    packed = index.optimize_layout(model)
    assert packed.bin_stats.agg(F.sum("n_records")).collect()[0][0] == 5
    assert {r.category for r in packed.bins.collect()} == set(NAMES)


def test_sizes():
    assert stats.capacity(2**32 - 3, 0.01, 3) == 347_372_157
    with pytest.raises(ValueError):
        IndexSettings(kmer_size=20, window_size=10)
    with pytest.raises(ValueError):
        ClassifySettings(dist="kde")
    assert "kmer_size: 19" in str(IndexSettings())


def scores(spark, rows):
    """Rows of dictionaries with defaults for two categories."""
    base = {"read_ord": 0, "num_hashes": 100, "mean_quality": 30.0, "length": 500, "compression": 0.5, "counts": [0, 0], "unique_counts": [0, 0], "props": [0.0, 0.0], "unique_props": [0.0, 0.0], "probabilities": [0.0, 0.0]}
    schema = "read_ord long, num_hashes long, mean_quality double, length long, compression double, counts array<long>, unique_counts array<long>, props array<double>, unique_props array<double>, probabilities array<double>"
    full = [base | {"read_ord": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in full], schema)


def host(spark, rows, **settings):
    called = calling.call_host(scores(spark, rows), ["host", "other"], 0, DehostSettings(**settings)).orderBy("read_ord").collect()
    return [(r.call, r.confidence) for r in called]


def test_host_rule(spark):
    wins = {"unique_counts": [37, 30], "unique_props": [0.37, 0.30], "probabilities": [0.9, 0.1]}
    other = {"unique_counts": [5, 40], "unique_props": [0.05, 0.40], "probabilities": [0.1, 0.9]}
    assert host(spark, [
        wins,  # confidence 7 is enough
        wins | {"unique_counts": [36, 30]},
        wins | {"unique_counts": [1000, 0]},
        other,  # the host's proportion must lie below the threshold
        other | {"unique_props": [0.04, 0.40]},
        wins | {"unique_counts": [10, 10]},
        wins | {"mean_quality": 14.9},
        wins | {"num_hashes": 0, "unique_props": [math.nan, math.nan]},
        wins | {"unique_props": [0.33, 0.30]},
        wins | {"probabilities": [0.1, 0.9]},
        wins | {"length": 139},
    ]) == [("host", 7), (None, 6), ("host", 255), (None, 35), ("other", 35), (None, 0), (None, 7), (None, 7), (None, 7), (None, 7), (None, 7)]
    with pytest.raises(ValueError):
        calling.call_host(scores(spark, [wins]), ["a", "b", "c"], 0, DehostSettings())


def category(spark, rows, names=("a", "b"), **settings):
    called = calling.call_category(scores(spark, rows), list(names), ClassifySettings(**settings)).orderBy("read_ord").collect()
    return [(r.call, r.confidence) for r in called]


def test_category_rule(spark):
    wins = {"unique_counts": [10, 5], "counts": [20, 10], "props": [0.2, 0.1], "probabilities": [0.9, 0.2]}
    assert category(spark, [
        wins,
        wins | {"unique_counts": [7, 5]},  # more than the confidence is asked for
        wins | {"unique_counts": [5, 5], "probabilities": [0.9, 0.0]},
        wins | {"unique_counts": [1000, 0]},
        wins | {"props": [0.1, 0.2]},
        wins | {"counts": [10, 20]},
        wins | {"mean_quality": 9.0},
        wins | {"num_hashes": 0},
        wins | {"compression": 0.1},
        wins | {"probabilities": [0.2, 0.9]},
    ]) == [("a", 5), (None, 2), ("a", 0), ("a", 255), (None, 5), (None, 5), (None, 5), (None, 5), (None, 5), (None, 5)]
    three = {"unique_counts": [3, 9, 9], "counts": [5, 20, 10], "props": [0.1, 0.2, 0.1], "probabilities": [0.1, 0.9, 0.0]}
    assert category(spark, [three], "abc") == [("b", 0)]


def test_training_candidates(spark):
    rows = [{"unique_props": p} for p in ([0.3, 0.3], [0.1, 0.05], [0.5, 0.02], [0.5, 0.0], [0.0, 0.0], [0.1, 0.1])] + [{"num_hashes": 0, "unique_props": [math.nan] * 2}]
    found = sorted(map(tuple, training.candidates(scores(spark, rows)).collect()))
    assert found == [(1, 1, "neg", 0.05), (2, 0, "pos", 0.5), (2, 1, "neg", 0.02), (3, 0, "pos", 0.5), (5, 0, "neg", 0.1), (5, 1, "neg", 0.1)]


def test_first_n(spark):
    rows = spark.createDataFrame([(i, i % 2, "pos", float(i)) for i in range(50)], "read_ord long, category_idx int, side string, value double")
    assert sorted(r.read_ord for r in training.first_n(rows, 3).collect()) == [0, 1, 2, 3, 4, 5]


def test_fits(spark):
    r = np.random.default_rng(1)
    sample = [(i, 0, "pos", float(v)) for i, v in enumerate(r.beta(6, 4, 3000))] + [(i, 0, "neg", float(v)) for i, v in enumerate(r.beta(2, 40, 3000))]
    frame = spark.createDataFrame(sample, "read_ord long, category_idx int, side string, value double")
    beta = models.fit(frame, 2, "beta", 3000)
    assert abs(beta[0]["pos"].params[0] - 6) < 0.7 and abs(beta[0]["neg"].params[1] - 40) < 5
    assert beta[1] == models.prior("beta")
    assert models.fit(frame, 1, "beta", 3001)[0] == models.prior("beta")
    gamma = models.fit(spark.createDataFrame([(i, 0, "pos", float(v)) for i, v in enumerate(r.gamma(9, 0.05, 3000))], frame.schema), 1, "gamma", 3000)
    assert abs(gamma[0]["pos"].params[0] - 9) < 1 and abs(gamma[0]["pos"].params[2] - 0.05) < 0.006
    assert gamma[0]["neg"].params == (10.0, -0.05, 0.005)  # no sample at all: the loc of an empty one
    kde = models.fit(frame, 1, "kde", 3000)
    assert len(kde[0]["pos"].sample) == 3000 and kde[0]["pos"].h == 0.1
    rows = models.parameters([*beta, *gamma, *kde])
    assert spark.createDataFrame(rows, models.MODEL_ROWS).count() == 8


@pytest.mark.parametrize("dist", ["gamma", "beta", "kde"])
def test_probabilities(spark, dist):
    x = [0.0, 0.01, 0.1, 0.2, 0.5, 0.9, 1.0]
    rows = models.probabilities(scores(spark, [{"unique_props": [v, v]} for v in x]), [models.prior(dist)] * 2).orderBy("read_ord").collect()
    p = [r.probabilities[0] for r in rows]
    assert all(0 <= v <= 1 for v in p) and p[1] < 0.1 and p[4] > 0.9
    model = models.prior(dist)
    if dist == "gamma":
        density = lambda v, s: math.exp((s[0] - 1) * math.log(v) - v / s[2] - math.lgamma(s[0]) - s[0] * math.log(s[2]))
        pos, neg = (density(0.2, model[s].params) for s in ("pos", "neg"))
        assert abs(p[3] - pos / (pos + neg + 300 * math.exp(-60))) < 1e-9


def test_prior_from_a_file(tmp_path):
    path = tmp_path / "prior.txt"
    path.write_text("pos 0.5\npos\t0.7\n\nneg 0.02\n")
    held = models.prior("kde", str(path))
    assert (held["pos"].sample, held["neg"].sample) == ([0.5, 0.7], [0.02])
    path.write_text("pos 0.5\n")
    with pytest.raises(ValueError):
        models.prior("kde", str(path))


def test_training_window(world):
    _, _, model, frame = world
    settings = DehostSettings(dist="beta", training="first_n", num_reads_to_fit=3)
    from dataclasses import replace

    scored = pipeline.score(frame, model, settings)
    assert pipeline.fitted(scored, 3, replace(settings, training_window=1000)) == pipeline.fitted(scored, 3, settings)
    assert pipeline.fitted(scored, 3, replace(settings, training_window=1)) == [models.prior("beta")] * 3


def test_distributions_add_up():
    import random as plain_random

    r = plain_random.Random(2)
    for shape, loc, scale in ((25.0, 0.0, 0.02), (0.4, 0.1, 2.0), (1.0, 0.0, 1.0)):
        x = np.sort([loc + r.gammavariate(shape, scale) for _ in range(4000)])
        assert abs(stats.gamma_cdf(x, shape, loc, scale) - (np.arange(4000) + 0.5) / 4000).max() < 0.035
    assert abs(stats.gamma_cdf(np.array([1.0, 2.0]), 1.0, 0.0, 1.0) - (1 - np.exp([-1.0, -2.0]))).max() < 1e-6
    for a, b in ((6.0, 40.0), (0.5, 0.5), (2.0, 1.0)):
        x = np.sort([r.betavariate(a, b) for _ in range(4000)])
        assert abs(stats.beta_cdf(x, a, b) - (np.arange(4000) + 0.5) / 4000).max() < 0.035
    x = np.array([r.betavariate(6, 40) for _ in range(500)])
    assert stats.anderson_darling(x, lambda v: stats.beta_cdf(v, 6, 40)) < stats.anderson_darling(x, lambda v: stats.beta_cdf(v, 6, 20))


def test_short_numbers(spark):
    from readsift.operators.sinks import short

    values = [0.0, 0.5, 1.0, -2.25, 0.123456789, 123456.4, 999999.6, 1234567.0, 0.0001, 0.00001234567, 0.01953125, 0.05859375, 1e20, 100.0, 12.0, float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(short(F.col("v"))).collect()]
    assert got == [None if v is None else "%.6g" % v for v in values]


def test_scores_are_written_once_in_a_plan(spark, sf):
    """Expressions over scores stand once in the plan, however often they are mentioned."""
    from readsift.plans.queries import QUERIES

    for name in ("assignment_rows", "beta_score", "gamma_score", "training_candidates"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("transform(") < 20, name


def test_beta_loc(spark):
    assert spark.range(1).select(stats.beta_loc(F.lit(0.5), F.lit(6.0), F.lit(4.0))).collect()[0][0] == pytest.approx(-0.1)


def test_long_reference_is_cut_in_linear_time(spark):
    """A sequence of 300 MB, through the pass that cuts it."""
    import time

    frame = spark.range(1).selectExpr("0 bin", f"repeat('{'ACGTA' * 200}', 300000) seq")
    began = time.time()
    rows = index.pieces(frame, 41).selectExpr("length(seq) n").collect()
    assert len(rows) == -(-(300_000_000 - 40) // index.PIECE) and sum(r.n for r in rows) == 300_000_000 + 40 * (len(rows) - 1)
    assert time.time() - began < 60


def test_kernel_density_prior_has_its_moments():
    for side in ("pos", "neg"):
        sample = np.array(models.prior("kde")[side].sample)
        mean, sd, n, _ = models.KDE[side]
        assert len(sample) == n and abs(sample.mean() - mean) < 0.002 and abs(sample.std() - sd) < 0.005


def test_anderson_darling_prefers_the_right_distribution():
    x = np.random.default_rng(2).random(500)
    assert stats.anderson_darling(x, lambda v: v) < 2.5 < stats.anderson_darling(x, lambda v: v**3)


def test_moments_of_arrays(spark):
    rows = spark.createDataFrame([([],), ([2.0],), ([1.0, 3.0],)], "x array<double>")
    found = rows.select(stats.mean(F.col("x")), stats.variance(F.col("x"), stats.mean(F.col("x")))).collect()
    assert list(map(tuple, found)) == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]


def test_rollup(spark):
    calls = spark.createDataFrame([("a",), ("a",), (None,)], "call string")
    assert sorted(map(tuple, counts.rollup(calls, ["a", "b"]).collect())) == [("a", 2), ("b", 0), ("unclassified", 1)]


def test_partitions_do_not_matter(world):
    _, _, model, frame = world
    one, many = (sorted((r.read_ord, r.call, r.confidence) for r in pipeline.classify(f, model, ClassifySettings(min_quality=0, min_length=20, min_compression=0)).collect()) for f in (frame.coalesce(1), frame.repartition(7)))
    assert one == many and any(c for _, c, _ in one)


def test_probe_keeps_misses(world):
    _, _, model, frame = world
    hashes = frame.where("read_ord = 42").select("read_ord", F.explode(index.minimisers(F.col("seq"), 7, 12)).alias("h"))
    assert probe.probe_rows(hashes, model).where("bins is null").count() == hashes.count() > 0
