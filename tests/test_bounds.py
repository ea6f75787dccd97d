"""What holds at any size: memory of a worker, the probes beyond their bounds, passes over the reads."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readsift.config import IndexSettings
from readsift.functions.columns import text_as_bases
from readsift.operators import index, minimiser, models, probe
from readsift.operators.sinks import short

SMALL = IndexSettings(kmer_size=7, window_size=12)


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(3)
    genomes = ["".join(r.choice("ACGT") for _ in range(9000)) for _ in range(3)]
    bins = spark.createDataFrame([(i, f"f{i}", f"c{i}", i) for i in range(3)], "bin int, path string, category string, category_idx int")
    refs = spark.createDataFrame(list(enumerate(genomes)), "bin int, seq string")
    reads = spark.createDataFrame([(i, genomes[i % 3][50 * i : 50 * i + 300]) for i in range(60)], "read_ord long, seq string")
    return index.build(bins, refs, SMALL), reads.select("read_ord", minimiser.minimisers(F.col("seq"), 7, 12, "distinct").alias("minimisers"))


def patterns(model, reads, how):
    rows = probe.hits(reads, model, how).collect()
    return sorted((r.read_ord, r.num_hashes, sorted((tuple(p.bins), p.n) for p in r.patterns)) for r in rows)


@pytest.mark.parametrize("emission", ["distinct", "exact"])
def test_a_batch_of_reads_takes_little_memory(emission):
    r = random.Random(1)
    text = "".join(r.choice("ACGT") for _ in range(3_000))
    batch = pa.array([text[i % 1000 :] for i in range(3_200)])  # 8 million bases
    tracemalloc.start()
    try:
        minimiser._lists(batch, 19, 41, emission)
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()


def test_minimisers_of_a_read_are_computed_once(spark):
    reads = spark.createDataFrame([(1, "ACGTTGCAAT" * 9), (2, ""), (3, None)], "read_ord long, seq string")
    found = reads.select("read_ord", minimiser.minimisers(F.col("seq"), 7, 12, "distinct").alias("minimisers"))
    each = found.select("read_ord", F.explode("minimisers").alias("h"))
    assert each._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {r.read_ord for r in each.collect()} == {1}
    alone = reads.select("read_ord", F.explode(minimiser.minimisers(F.col("seq"), 7, 12, "distinct")).alias("h"))
    assert alone._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(alone.collect()) == sorted(each.collect())


def test_pieces_held_at_once_are_bounded_by_bytes():
    batch = pa.record_batch([pa.array([0] * 300, pa.int32()), pa.array(["A" * 100_000] * 300)], names=["bin", "seq"])
    held = [sum(len(s) for _, s in x) for x in index._cut([batch], 41, index.PIECE)]
    assert sum(held) == 30_000_000 and max(held) <= index.HELD + 100_000


def test_text_as_bases(spark):
    texts = ["", None, "Abc z!", "\u0130\u212a\u00e9\u4e2d\U0001f600 x", "123"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    plain = F.translate(F.regexp_replace(F.lower("t"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    found = rows.select(text_as_bases(F.col("t")).alias("x"), plain.alias("y")).collect()
    assert [r.x for r in found] == [r.y for r in found]


def test_a_large_index_is_joined(world, monkeypatch):
    model, reads = world
    monkeypatch.setattr(probe, "MOST_LOCAL", 10)
    monkeypatch.setattr(probe, "MOST_BROADCAST", 10, raising=False)
    assert patterns(model, reads, "local") == patterns(model, reads, "join")


def test_numbers_round_their_exact_value(spark):
    values = [k / n for n in (640, 1280, 3200) for k in range(1, n)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    assert [r[0] for r in rows.select(short(F.col("v"))).collect()] == ["%.6g" % v for v in values]


def test_a_filter_is_probed_by_slabs_of_blocks(world, monkeypatch):
    model, reads = world
    assert probe._blocks(model) > 1
    whole = patterns(model, reads, "bloom")
    assert "CoGroup" not in probe.by_filter(reads, model)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(probe, "SLAB", 1)
    assert patterns(model, reads, "bloom") == whole
    assert all(a[1] == b[1] and sum(n for _, n in a[2]) >= sum(n for _, n in b[2]) for a, b in zip(whole, patterns(model, reads, "join")))


def test_models_are_fitted_in_one_pass(spark, monkeypatch):
    frame = spark.createDataFrame([(i, 0, "pos", i / 50) for i in range(40)], "read_ord long, category_idx int, side string, value double")
    calls, collect = [], type(frame).collect
    monkeypatch.setattr(type(frame), "collect", lambda self: calls.append(1) or collect(self))
    fitted = models.fit(frame, 1, "kde", 40)
    assert len(calls) == 1 and fitted[0]["pos"].sample == [i / 50 for i in range(40)]
