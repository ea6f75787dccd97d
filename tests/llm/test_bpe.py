import hashlib
import random

import tiktoken

from readsift.llm import bpe

ALPHABET = ["a", "bc", "Ω", "é", "1", "22", "'s", "'", "!", "...", " ", "  ", "   ", "\n", "\t", " ", " ", "\x1c", "\r\n", "日本", "🙂", "_"]


def public(path_pattern):
    path, pattern = path_pattern
    return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe._ranks(path), special_tokens={})


def texts(n=400):
    r = random.Random(5)
    made = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]
    return [None, "", " ", "  ", "a ", "a\n ", "\n \n", "word " * 3000, "<|endoftext|> x", *made]


def test_as_the_public_library(spark):
    given = list(enumerate(texts())) + [(7, "again"), (7, "again"), (None, "no id")]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("ids", bpe.F.lit("clash")).repartition(3)
    found = bpe.digest(bpe.decode(bpe.encode(docs))).collect()
    enc = public(bpe.vocabulary())
    want = []
    for i, t in given:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs)).count() == 0


def test_blocks_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1)
    docs = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs).collect()}
    enc = public(bpe.vocabulary())
    assert got == {1: enc.encode_ordinary("one two"), 2: enc.encode_ordinary("two three"), 3: []}


def test_round_trip_is_decoded_encoding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, 0), (-1, "é\n\n  x", None, None, 6)], "doc_id long, text string, lang string, source string, n_chars long"))
    once = sorted((repr(tuple(r)) for r in bpe.round_trip(docs).collect()))
    assert once == sorted((repr(tuple(r)) for r in bpe.decode(bpe.encode(docs)).collect()))
