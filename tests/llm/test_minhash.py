import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from readsift.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def brute(rows):
    root = {d: d for d, _ in rows if d is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d == e or (s and jaccard(s, t) >= 0.8):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return sorted(((d, top(d) if d is not None else None, d is None or top(d) == d) for d, _ in rows), key=repr)


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    common = [word() for _ in range(60)]
    rows = []
    for d in range(n):
        words = [word() for _ in range(r.randint(1, 200))]
        if d % 3 == 0:
            words = common + words[:30]
        rows.append((2 * d, " ".join(words)))
        for i in range(r.choice([0, 0, 1, 5])):
            edited = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 6])):
                edited[r.randrange(len(edited))] = word()
            rows.append((1000 + 10 * d + i, r.choice([" ", "\n "]).join(edited)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 4)])
def test_as_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = made(seed) + [(None, "a b c"), (5000, None), (5001, ""), (5002, "a b c"), (5003, "a  b\nc"), (5004, "x " * 3000), (5005, "x " * 2900), (7, "twice"), (7, "twice"), (7, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", minhash.F.lit(1)).repartition(4)
    got = sorted((tuple(r) for r in minhash.deduplicate(docs).collect()), key=repr)
    assert got == brute(rows)
    kept = [r.doc_id for r in minhash.representatives(docs).collect()]
    assert sorted(kept, key=repr) == sorted({d for d, _, k in brute(rows) if k}, key=repr)


def test_repeated_rows_and_ids(spark):
    """Of rows that share an id one stays; an id with two texts joins the classes of both; rows without an id stay once a
    text."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(7, a), (7, a), (7, b), (8, b), (9, a + " z"), (3, c), (3, c), (None, c), (None, c), (None, None), (None, None), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, gone string").withColumnRenamed("gone", "text").withColumn("gone", minhash.F.lit(1)).withColumn("mark", minhash.F.lit(2))
    got = {(r.doc_id, r.component_id) for r in minhash.deduplicate(docs).collect()}
    assert got == {(7, 7), (8, 7), (9, 7), (3, 3), (None, None), (5, 5)}
    left = minhash.representatives(docs)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(7, a), (3, c), (None, c), (None, None), (None, None), (5, None)], key=repr)


def test_intersections_by_products(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    r = np.random.default_rng(3)
    left, right = ([np.unique(r.integers(0, 60, n)) for n in r.integers(1, 40, k)] for k in (5, 9))
    got = minhash.shared_elements(left, right)
    assert (got == [[len(np.intersect1d(x, y)) for y in right] for x in left]).all()


def test_no_documents(spark):
    assert minhash.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert minhash.deduplicate(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].kept


def signed(sets):
    return minhash.signatures(np.concatenate(sets), np.array([len(x) for x in sets]))


def test_signatures_in_pieces(monkeypatch):
    r = np.random.default_rng(5)
    sets = [r.integers(0, 1 << 63, n, dtype=np.uint64) for n in (3, 1000, 40, 1, 700)]
    whole = signed(sets)
    monkeypatch.setattr(minhash, "THROWERS", 64)
    assert (signed(sets) == whole).all()


def test_elements_are_weighted_shingles():
    texts = ["a b c", None, "", "x " * 7, "a b c d e f a b c d e", " \n"]
    values, size, prints = minhash.elements(pa.array(texts))
    assert size.tolist() == [sum(shingles(t).values()) for t in texts]
    assert len(np.unique(values)) == len(values) and len(prints) == 6


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(4)
    for share in (0.3, 0.8, 0.95):
        pairs = []
        for _ in range(40):
            n = int(r.integers(5, 2000))
            x = r.integers(0, 1 << 63, n, dtype=np.uint64)
            y = x.copy()
            y[: int(n * (1 - share) / (1 + share))] = r.integers(0, 1 << 63, int(n * (1 - share) / (1 + share)), dtype=np.uint64)
            pairs += [x, y]
        sig = signed(pairs)
        same = (sig[::2] == sig[1::2]).mean()
        true = np.mean([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(pairs[::2], pairs[1::2])])
        assert abs(same - true) < 0.03


def test_a_signature_depends_on_its_set_alone():
    x = [np.arange(1, n, dtype=np.uint64) * np.uint64(12345678987654321) for n in (2, 5, 300)]
    assert (signed(x)[1] == signed(x[1:2])[0]).all()
