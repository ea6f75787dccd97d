import hashlib
import random
import re

from pyspark.sql import functions as F

from readsift.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    spans = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), k, kind, m.end()))
    spans.sort()
    counts = [sum(s[2] == kind for s in spans) for kind in PLAIN]
    base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
    return (*counts, hashlib.sha256(base.encode()).hexdigest())


def texts():
    r = random.Random(9)
    bits = ["a@b.c", "_d@e.f", "x", "@", ".", "1.2.3.4", "256.1.1.1", "0010.2.3.4", "4111111111111111", "4111-1111 1111-1111", "5", " ", "-", "+1 (499) 555-6503", "+49.30.123456", "é", "\n", "a.b+c%d@mail-1.example.com", "12", "+", "日本", ")"]
    made = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(600)]
    long_ = ["a" * 60_000, "a." * 30_000 + "@", "1" * 60_000, "1-" * 40_000, "1." * 40_000, "+1" + " " * 40_000, "x@y" * 20_000, "a@b.c " * 3_000]
    return [None, "", *made, *long_]


def test_base_kinds_as_the_plain_patterns(spark):
    given = texts()
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").withColumn("pii", F.lit("clash")).repartition(4)
    for r in pii.digest(pii.find(docs)).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute(given[r.doc_id]), given[r.doc_id] and given[r.doc_id][:200]


def test_cards_with_a_separator_between_all_digits(spark):
    cards = ["4111111111111111", "30569309025904", "6304000000000000000"]
    given = [f"é {sep.join(c)}{end}" for c in cards for sep in (" ", "-") for end in ("", " x", ".")] + [" -".join(cards[0]), "4 1 1 1", "4 1-" * 8 + "1"]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = pii.digest(pii.find(docs)).collect()
    for r in got:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute(given[r.doc_id]), given[r.doc_id]
    assert sum(r.n_card for r in got) >= 12


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, sf).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute(docs[r.doc_id])


def found(spark, text):
    rows = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    return [(s.kind, text[s.start : s.stop], s.score) for s in rows[0].pii]


def test_checksums_and_context_of_added_kinds(spark):
    assert [x[:2] for x in found(spark, "AT61 1904 3002 3457 3201 NOW")] == [("iban", "AT61 1904 3002 3457 3201")]
    assert [x[:2] for x in found(spark, "PAY DE89370400440532013000 TODAY")] == [("iban", "DE89370400440532013000")]
    assert [x[:2] for x in found(spark, "é GB82 WEST 1234 5698 7654 32 is one")] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert found(spark, "GB83 WEST 1234 5698 7654 32") == []
    assert [x[:2] for x in found(spark, "his SSN: 219-09-9999.")] == [("ssn", "219-09-9999")]
    assert found(spark, "part 219-09-9999 of") == []
    near, far = (found(spark, t)[0][2] for t in ("write a@b.cd", "plain a@b.cd"))
    assert near > far


def test_native(spark, sf):
    plan = queries.op1_pii(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a@b.c"), (1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")
    assert [r.n_email for r in pii.digest(pii.find(docs)).collect()] == [1, 1, 1]
    assert pii.find(docs.limit(0)).count() == 0
