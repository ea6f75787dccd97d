import random
import re
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

from readsift.llm import quality, queries

TEXTS = [
    None,
    "",
    " \t\n",
    "a b c a b c a b c d",
    "x y\nx y\n\n\nx y\nz",
    "#tag $5 <b>&amp;</b> | %",
    "naïve café  straße\x1cword",
    "same " * 70,
    "日本語 の 文章 です",
    "word" * 40_000 + " tail",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def check(found, texts):
    for r, t in zip(found, texts):
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute(t), t and t[:80]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_base_counts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).withColumn("kept", F.lit("clash"))
    check(quality.measure(docs).collect(), TEXTS)
    assert quality.measure(docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op6_fertility(spark, sf).collect()
    assert len(found) == len(docs)
    check(found, [docs[r.doc_id] for r in found])


def test_tokens_of_words(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=quality.vocabulary())
    text = "tokens of words, ☃ 日本 and bytes"
    want = [t for w in text.split() for t in model.encode(w)]
    row = quality.measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.n_tokens == len(want)
    assert abs(row.byte_share - sum(map(model.is_byte, want)) / len(want)) < 1e-12


def test_junk_is_rejected_and_prose_kept(spark, sf):
    prose = next(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text.split()) > 200 and "***" not in r.text)
    junk = " ".join(chr(0x13000 + i % 7) for i in range(100))
    rows = quality.measure(spark.createDataFrame([(1, prose), (2, junk)], "doc_id long, text string")).collect()
    assert rows[0].kept and not rows[1].kept


def test_bands_reject_random_characters_and_keep_clean_text(spark):
    r = random.Random(2)
    blocks = [(0xE000, 0xF8FF), (0x1F300, 0x1F5FF), (0x900, 0xE00), (0x590, 0x780), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xE1000, 0xE9000)]
    junk = [" ".join("".join(chr(r.randrange(a, b)) for _ in range(r.randint(2, 9))) for _ in range(120)) for a, b in blocks]
    clean = [
        "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है",
        "ସମସ୍ତ ମନୁଷ୍ୟ ଜନ୍ମକାଳରୁ ସ୍ୱାଧୀନ ଏବଂ ମର୍ଯ୍ୟାଦା ଓ ଅଧିକାରରେ ସମାନ",
        "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል።",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神互相对待。",
        "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며",
        "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון",
        "All human beings are born free and equal in dignity and rights 😀. They are endowed with reason and conscience 👍",
    ]
    rows = quality.measure(spark.createDataFrame(list(enumerate(junk + clean)), "doc_id long, text string")).collect()
    said = {row.doc_id: row.in_band for row in rows}
    assert [said[i] for i in range(len(rows))] == [False] * len(junk) + [True] * len(clean)


def test_script_counts_letters_alone():
    assert quality.script("[_{|}~^`@ ab жжж") == "greek_cyrillic"
    assert quality.script("[_{|}~^` 12 !!") == "other" and quality.script("") == "other"
    assert quality.script("देवनागरी ab") == "indic" and quality.script("日本語 a") == "cjk"


def test_verdicts_of_the_whole_table(spark, sf):
    """kept and in_band, one document at a time."""
    import unicodedata

    import numpy as np

    model = sentencepiece.SentencePieceProcessor(model_file=quality.vocabulary())
    found = {r.doc_id: r for r in quality.measure(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for doc in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = doc.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        ids = [t for w in words for t in model.encode(w)]
        p = np.array(list(Counter(ids).values())) / max(1, len(ids))
        entropy, share = float(-(p * np.log2(p)).sum()), sum(map(model.is_byte, ids)) / max(1, len(ids))
        far = [c for c in text if ord(c) > 127]
        odd = sum(unicodedata.category(c)[0] == "S" or unicodedata.category(c) in ("Cn", "Co", "Cs") for c in far) / max(1, len(far))
        low, high, most, least = quality.BANDS[quality.script(text)]
        inside = bool(ids) and low <= sum(map(len, words)) / len(ids) <= high and share <= most and entropy >= least and (odd <= quality.ODD or share <= quality.ODD_BYTES)
        n, *_, repeated = brute(text)
        assert found[doc.doc_id].in_band == inside
        assert found[doc.doc_id].kept == (inside and n >= 50 and 100 * repeated <= 50 * n)
