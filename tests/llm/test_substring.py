import os
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from readsift.llm import common, rolling, sketch, substring

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def brute(rows, size):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    return out


def made(seed, n, vocabulary=3000):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passages = [[word() for _ in range(r.randint(45, 130))] for _ in range(4)]
    rows = []
    for d in range(n):
        words = [word() for _ in range(r.randint(0, 150))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, 20)
            at = r.randint(0, len(words))
            words[at:at] = p[a : a + r.randint(30, 120)]
        rows.append((d, r.choice([" ", "\n", " \t"]).join(words)))
        if r.random() < 0.2:
            rows.append((n + d, " ".join(words[: r.randint(1, max(1, len(words)))])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_as_brute_force(spark, seed):
    rows = made(seed, 60)
    rows += [(500, "a b " * 300), (501, "b a " * 200), (502, "a b " * 40), (None, rows[0][1]), (503, None), (504, ""), (0, rows[3][1]), (0, rows[3][1]), (505, "ü " * 60), (506, "x" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", substring.F.lit(1)).repartition(5)
    got = [(r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in substring.deduplicate(docs).collect()]
    want = brute(rows, 50)
    assert sum(w[3] for w in want) > 500
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_documents(spark):
    assert substring.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert substring.deduplicate(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].n_words == 0


def test_sketch_loses_nothing(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000).tolist()
    lists = [keys[:3000], keys[2000:], keys[100:200]]
    frame = spark.createDataFrame([(x,) for x in lists], "keys array<long>").repartition(3)
    found = sketch.build(frame, "keys", 16, 3, 2)
    twice = found(np.array(keys).view(np.uint64))
    assert twice[2000:3000].all() and twice[100:200].all() and twice.mean() < 0.4


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_sketch_merged_in_groups_has_the_same_bits(spark, monkeypatch, threshold):
    r = random.Random(5)
    rows = [([r.randrange(400) for _ in range(r.randint(0, 30))],) for _ in range(120)]
    frame = spark.createDataFrame(rows, "keys array<bigint>").repartition(9)
    at_once = sketch.build(frame, "keys", 2000, 3, threshold)
    monkeypatch.setattr(sketch, "KEYS_A_MERGE", 500)
    in_groups = sketch.build(frame, "keys", 2000, 3, threshold)
    count = np.bincount([k for keys, in rows for k in keys], minlength=500)
    for row in range(3):
        assert (at_once.rows[row] == in_groups.rows[row]).all()
        at = sketch.places(np.arange(500, dtype=np.uint64), row, at_once.bits).astype(np.int64)
        want = np.bincount(at, weights=count, minlength=1 << at_once.bits) >= threshold
        assert (np.unpackbits(at_once.rows[row]).astype(bool) == want).all()


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 1 << 60, 300, dtype=np.uint64)
    for size in (1, 2, 3, 43, 64, 300):
        assert (rolling.sliding_min(x, size) == [x[i : i + size].min() for i in range(301 - size)]).all()


def test_words_split_at_six_characters(monkeypatch):
    raw = " a\x1cb\tc\x85d\n\né\r".encode()
    assert list(common.pieces(raw)) == [raw]
    for most in (1, 2, 5):
        assert [w for p in common.pieces(raw * 20, most) for w in p.split()] == (raw * 20).split()
    texts = pa.array(["x y", raw.decode(), None, "", "a\x1cb c", "q" * 300, "q" * 299 + "r"])[1:]
    lanes, counts, prints = rolling.hashed(texts, prints=True)
    assert counts.tolist() == [3, 0, 0, 2, 1, 1] and len(set(prints)) == 5
    assert lanes[0][0] == lanes[0][3] and len(set(lanes[0].tolist())) == len(set(lanes[1].tolist())) == 6
    monkeypatch.setattr(rolling, "SEGMENT", 3)
    again = rolling.hashed(texts, prints=True)
    assert (np.array(again[0]) == np.array(lanes)).all() and (again[1] == counts).all() and again[2] == prints


def test_windows_and_spans():
    lanes, _, _ = rolling.hashed(pa.array([" ".join(str(i % 37) for i in range(400))]))
    for size in (1, 2, 5, 8, 50):
        of = rolling.windows(lanes[0], size)
        assert len(of) == 401 - size and len(set(of.tolist())) == min(37, 401 - size)
        assert (of[:-37] == of[37:]).all()
    start, length = np.arange(300), np.arange(300) % 99 + 1
    k = rolling.spans(lanes[0], start, length)
    text = [tuple(i % 37 for i in range(a, a + n)) for a, n in zip(start, length)]
    assert len(set(k.tolist())) == len(set(text))


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse sequences and their complements agree under every polynomial modulo a power of two."""
    odd = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = odd.translate(str.maketrans("ab", "ba"))
    common_ = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{common_} {odd}"), (2, f"{common_} {other}"), (3, f"{common_} {odd}"), (4, " ".join(odd)), (5, " ".join(other))]
    got = {r.doc_id: r.n_removed for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {d: n for d, _, _, n in brute(rows, 50)}
    assert got == want and got[2] == 0 and got[3] == 50


def test_long_text_is_cut_into_chunks(monkeypatch, spark):
    monkeypatch.setattr(substring, "CHUNK", 97)
    r = random.Random(3)
    text = " ".join(f"v{r.randrange(500)}" for _ in range(2000))
    words = text.split()
    rows = [(1, text), (2, " ".join(["x"] * 13 + words[300:900] + ["y"] * 7)), (3, " ".join(words[1000:1049])), (4, " ".join(words[1000:1050]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = docs.selectExpr("doc_id", "text", "xxhash64(text) print").toArrow().to_batches()
    lists = [[], []]
    for batch in given:
        for runs in substring._runs(batch.column("text"), 50, 8):
            hashes, run, start = runs.windows()
            for d, s, a, b in zip(batch.column("doc_id").to_numpy()[runs.text[run]], start, *hashes):
                lists[0].append((int(d), int(s)))
                lists[1].append((int(a), int(b)))
    want = [(d, i) for d, t in rows for i in range(len(t.split()) - 49)]
    assert sorted(lists[0]) == sorted(want)
    texts = {(d, i): tuple(t.split()[i : i + 50]) for d, t in rows for i in range(len(t.split()) - 49)}
    assert len(set(lists[1])) == len(set(texts.values())) == len({(h, texts[p]) for p, h in zip(*lists)})


@pytest.mark.parametrize("kind", ["words", "one word"])
def test_a_text_of_100_mb(kind, tmp_path):
    """Hashing and removal of a text of 100 MB in a process of its own, with the most memory it ever held."""
    code = f"""
import resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {ROOT!r})
from readsift.llm import minhash, substring
raw = np.random.default_rng(1).integers(97, 123, 100_000_000, dtype=np.uint8)
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before = most()
if {kind!r} == "words":
    raw[::6] = 32
column = pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int32)), pa.py_buffer(raw)])
found = sum(len(r.anchor) for r in substring._runs(column, 50, 8))
print(most() - before, "runs", file=sys.stderr)
batch = pa.record_batch([pa.array([1]), column], names=["doc_id", "text"])
signed = next(minhash._sign(iter([batch])))
print(most() - before, "signed", file=sys.stderr)
kept = next(substring._apply(iter([batch]), 50))
print(most() - before)
assert kept.column("n_words")[0].as_py() == {{"words": 100_000_000 // 6 + 1, "one word": 1}}[{kind!r}]
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 1024, out.stderr
