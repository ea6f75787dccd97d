from collections import defaultdict

from readsift.llm import mixing


def targets(sizes):
    """Shares by weight, stopping at three times the size, the rest shared anew, in rounds."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, left, out = set(names), float(sum(sizes.values())), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * sizes[s]}
        if not over:
            return out | {s: weight[s] * share for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets_and_copies(spark):
    rows = [(i, "w " * (i % 37), f"s{(i * i) % 11}") for i in range(900)] + [(i, "w " * 50, "hot") for i in range(1000, 1500)]
    rows += [(2000, None, "empty"), (2001, "a\x1cb c", None), (2002, "x y", "Ü"), (2002, "x y", "Ü"), (None, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.F.lit("clash")).repartition(4)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    sizes = defaultdict(int)
    for r in plan:
        sizes[r.source] += r.size
    want = targets(sizes)
    taken = defaultdict(int)
    for r in plan:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.25 * t + 100
    again = {(r.doc_id, r.source): r.copies for r in mixing.mix_plan(docs.repartition(2)).collect()}
    assert all(again[r.doc_id, r.source] == r.copies for r in plan)


def test_no_documents(spark):
    assert mixing.mix_plan(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert mixing.mix_plan(one).collect()[0].copies == 0
    assert mixing.mix_documents(one).count() == 0


def test_rows_without_an_id_draw_by_their_text(spark):
    rows = [(None, f"a b c d{i}", "s" if i % 4 else "t") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("of", mixing.F.lit(1)).withColumn("rate", mixing.F.lit(2))
    per = {r.source: (r["sum(copies)"], r["max(rate)"]) for r in mixing.mix_plan(docs).selectExpr("source", "copies", "target / source_size rate").groupBy("source").agg({"copies": "sum", "rate": "max"}).collect()}
    for source, n in (("s", 900), ("t", 300)):
        assert abs(per[source][0] - n * per[source][1]) < 0.12 * n
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(a for a, _ in per.values())
