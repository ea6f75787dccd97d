import hashlib
from collections import defaultdict

import numpy as np
import tiktoken
from pyspark.sql import functions as F
from test_minhash import brute as near_classes
from test_mixing import targets

import corpus_pipeline
from readsift.llm import bpe, langid, mixing, secrets


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name in ("language", "near_duplicates"):
            assert 0.5 * before < docs.count() <= before
        if name == "secrets":
            assert docs.count() == before
            assert not docs.where("text rlike 'password=[0-9a-f]{18}'").count()
    tokens = corpus_pipeline.tokens(spark, docs, sf)
    assert tokens.count() == docs.count()


def test_run(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids"} <= set(found.columns)
    assert found.count() > 0 and found.where("size(ids) <> n_tokens").count() == 0


def test_mixed_documents_follow_the_plan(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect() if r.copies}
    for most in (10_000, 0):
        monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
        found = {r.doc_id: r["count"] for r in mixing.mix_documents(docs).groupBy("doc_id").count().collect()}
        assert found == plan


def test_language_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = langid.accepted(docs, langid.fit(docs))
    assert kept.count() >= 0.99 * docs.count()


def plain(rows, model):
    """The stages one document at a time: rows of (doc_id, text, source)."""
    kept = []
    for doc, text, source in rows:
        seen = langid.presence(text or "", model.settings)
        if seen.any():
            f = np.sort(model.weights[seen].sum(0) / np.sqrt(seen.sum()))
            if f[-1] - f[-2] >= model.settings.least_margin:
                kept.append((doc, text, source))
    first = {d for d, _, k in near_classes([(d, t) for d, t, _ in kept]) if k}
    kept = [r for r in kept if r[0] in first]
    clean = []
    for doc, text, source in kept:
        for a, b, _, p in reversed(secrets.scan([text], [source], secrets.default_forest())[0]):
            if p >= secrets.THRESHOLD:
                text = text[:a] + "<secret>" + text[b:]
        clean.append((doc, text, source))
    sizes = defaultdict(int)
    for _, text, source in clean:
        sizes[source] += len(text.encode().split())
    want = targets(sizes)
    path, pattern = bpe.vocabulary()
    encoding = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=bpe._ranks(path), special_tokens={})
    for doc, text, source in clean:
        rate = want[source] / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"readsift-mix:{doc}".encode()).hexdigest()[:13], 16) / 2**52
        ids = encoding.encode_ordinary(text)
        said = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        yield from [(doc, len(ids), said, hashlib.sha256(text.encode()).hexdigest())] * (int(rate) + (draw < rate - int(rate)))


def test_run_as_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(plain(rows, langid.fit(docs)))


CLASHES = ["accepted", "gone", "mark", "of", "rate", "copy", "node", "component", "size", "label"]


def test_stages_on_odd_tables(spark, sf):
    """No rows; nulls in every column, empty texts, repeated rows, and columns named like those that stages use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clean = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 400").limit(30).collect()]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(None, None, None, None, None), (100, None, "en", None, None), (101, "", "en", "s", 0), (102, " \n", None, "s", 2), rows[0], rows[0], (None, clean[1], "en", "s", 5), (103, clean[2], "en", None, 9)]
    for given in ([], rows):
        docs = spark.createDataFrame(given, schema)
        for name in CLASHES:
            docs = docs.withColumn(name, F.lit(1))
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf)
            n = found.count()
            assert n == 0 if not given else n > 0, name
            if name != "tokens":
                assert found.columns == docs.columns, name
            if name == "near_duplicates" and given:
                ids = [r.doc_id for r in found.collect() if r.doc_id is not None]
                assert len(ids) == len(set(ids)) and 103 not in ids
            if name == "secrets" and given:
                assert n == len(rows)
