import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readsift.llm import langid, queries

SMALL = langid.Settings(per_language=60, landmarks=20)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = queries.op2_langid(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    out = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out) > 0
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows(spark, sf):
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), SMALL)
    rows = [(1, None), (2, ""), (3, "1234 !!"), (4, "the and of that " * 50_000), (4, "the and of that " * 50_000), (None, "und der die das ist")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    found = langid.predict(docs, model).collect()
    assert [r.lang_pred for r in found[:3]] == ["und"] * 3 and [r.score for r in found[:3]] == [0.0] * 3
    assert found[3][1:] == found[4][1:] and found[3].lang_pred == "en"
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 3


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert langid.predict(docs, None).collect()[0].lang_pred == "und"
    assert langid.predict(docs.limit(0), None).count() == 0
    assert langid.accepted(docs, None).count() == 1


def test_presence_counts_grams_once():
    one, two = langid.presence("abc", SMALL), langid.presence("abc abc", SMALL)
    assert one.sum() == 6 and (one <= two).all()


def invented(seed):
    """Texts of a language of its own syllables."""
    r = random.Random(seed)
    syllables = [r.choice("bcdfghjklmnprstvwz") + r.choice("aeiouäöåéyı") + r.choice(["", "n", "s", "r", "l"]) for _ in range(40)]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(400)]
    return lambda n: " ".join(r.choice(words) for _ in range(n))


@pytest.mark.parametrize("languages", [1, 2, 4, 24])
def test_foreign_texts_go_and_short_clean_ones_stay(spark, languages):
    r = random.Random(5)
    known = {f"x{k:02}": invented(k) for k in range(languages)}
    rows = [(i, write(r.randint(20, 200)), name) for i, (name, write) in enumerate((n, w) for n, w in known.items() for _ in range(80))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), SMALL)
    clean = [write(10) for write in known.values() for _ in range(-(-100 // languages))]
    foreign = [invented(100 + k)(r.randint(20, 200)) for k in range(100)]
    foreign += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(r.randint(60, 600))) for _ in range(100)]
    foreign += ["".join(r.choice("абвгдежзиклмнопрст   ") for _ in range(r.randint(60, 600))) for _ in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + foreign)], "doc_id long, text string")
    kept = [x.doc_id for x in langid.accepted(docs, model).select("doc_id").collect()]
    assert sum(i < len(clean) for i in kept) >= 0.95 * len(clean)
    assert sum(i >= len(clean) for i in kept) <= 0.1 * len(foreign)


def test_predictions_as_kernel_ridge_regression_one_text_at_a_time(spark, sf):
    """The query's path, against kernels of texts with landmarks, the Nystrom map and ridge regression written out."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    settings = langid.Settings(landmarks=8, per_language=30)
    rows = sorted(langid.sample(docs, settings).collect(), key=lambda r: (r["lang"], r["n"]))
    seen = [np.unpackbits(np.frombuffer(r["seen"], np.uint8)).astype(bool) for r in rows]
    names = sorted({r["lang"] for r in rows})
    marks = [s for i, s in enumerate(seen) if sum(r["lang"] == rows[i]["lang"] for r in rows[:i]) < settings.landmarks]
    kernel = lambda a, b: (a & b).sum() / np.sqrt(a.sum() * b.sum())
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    z = np.array([[kernel(a, b) for b in marks] for a in seen]) @ root
    y = np.array([[1.0 if r["lang"] == n else -1.0 for n in names] for r in rows])
    size = np.array([[sum(q["lang"] == r["lang"] for q in rows)] for r in rows])
    w = (z / size).T @ z
    beta = np.linalg.solve(w + settings.ridge * np.eye(len(w)) * np.trace(w) / len(w), (z / size).T @ y)
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.fit(docs, settings)).collect()}
    for doc in docs.limit(80).collect():
        s = langid.presence(doc.text or "", settings)
        if not s.any():
            assert found[doc.doc_id] == ("und", 0.0)
            continue
        f = np.array([kernel(s, m) for m in marks]) @ root @ beta
        share = np.exp(4 * f) / np.exp(4 * f).sum()
        assert found[doc.doc_id][0] == names[int(f.argmax())] and abs(found[doc.doc_id][1] - share.max()) < 1e-3
