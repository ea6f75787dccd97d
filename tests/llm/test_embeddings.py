import math

import numpy as np
import pytest

from readsift.llm import embeddings, queries
from readsift.llm.components import components
from readsift.llm.hnsw import Graph


def brute(rows):
    """Links and least reachable ids, by comparing all."""
    usable = lambda v: bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = [0] * len(rows)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, u, k) in enumerate(rows):
        for j in range(i):
            b, v, m = rows[j]
            if a is None or b is None or k is None or k != m or not usable(u) or not usable(v) or len(u) != len(v):
                continue
            x, y = np.array(u, np.float64), np.array(v, np.float64)
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98:
                n[i] += 1
                n[j] += 1
                root[max(top(i), top(j), key=lambda r: rows[r][0])] = min(top(i), top(j), key=lambda r: rows[r][0])
    least = {}
    for i, (a, _, _) in enumerate(rows):
        if a is not None:
            least[top(i)] = min(a, least.get(top(i), a))
    return [(a, n[i], least.get(top(i)), a is not None and a == least[top(i)]) for i, (a, _, _) in enumerate(rows)]


def made(seed, n=240, d=8):
    r = np.random.default_rng(seed)
    rows, base = [], r.normal(size=(12, d))
    for i in range(n):
        v = base[r.integers(12)] + r.normal(size=d) * r.choice([0.02, 0.2, 1.0])
        rows.append((int(i), v.astype(np.float32).tolist(), int(r.integers(3))))
    rows += [(n + i, rows[i % 4][1], rows[i % 4][2]) for i in range(20)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * d, 1), (903, [None] + [1.0] * (d - 1), 1), (904, [math.nan] * d, 1), (905, [math.inf] * d, 1)]
    return rows + [(906, rows[0][1], None), (None, rows[0][1], rows[0][2]), (907, rows[0][1][:4], rows[0][2]), (1, rows[1][1], rows[1][2])]


@pytest.mark.parametrize("shard", [8192, 50])
def test_as_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(embeddings, "SHARD", shard)
    rows = made(3)
    rows += [(i, rows[i][1], (rows[i][2] + 1) % 3) for i in range(0, 40, 3)]  # ids that several labels hold
    rows += [(i, rows[i + 60][1], rows[i + 60][2]) for i in range(1, 40, 3)]  # and ids of other vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", embeddings.F.lit(0)).repartition(3)
    found = [tuple(r) for r in embeddings.link(frame).collect()]
    want = brute(rows)
    assert sum(w[1] for w in want) > 500
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.op5_embeddings(spark, sf).collect())) == sorted(brute(rows))


def test_no_vectors(spark):
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_graph_recall():
    v = np.random.default_rng(0).normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = Graph.load(Graph.build(v).save())
    q = v[::30]
    best = np.argsort(-(q @ v.T), axis=1)[:, :10]
    ids, _ = g.search(q.astype(np.float32), 64)
    assert sum(len(set(a) & set(b[:10])) for a, b in zip(best, ids)) >= 0.95 * best.size


@pytest.mark.parametrize("n_links", [5, 400])
def test_audit_of_sparse_links(monkeypatch, n_links):
    r = np.random.default_rng(4)
    points = embeddings._unit(r.normal(size=(1500, 32)))
    first = set(np.linspace(0, 1199, embeddings.AUDIT).astype(int).tolist())  # none of the first audit's queries has a link
    linked = [i for i in range(1200) if i not in first][:n_links]
    queries_ = embeddings._unit(r.normal(size=(1200, 32)))
    queries_[linked] = embeddings._unit(points[linked] + r.normal(size=(len(linked), 32)) * 1e-3)
    monkeypatch.setattr(embeddings, "search", lambda graph, q, beam, threshold: np.zeros((len(q), len(points)), bool))  # finds nothing
    found = embeddings.links(Graph(points, 1), queries_)
    assert (found == (queries_ @ points.T >= embeddings.THRESHOLD)).all() and found.sum() == n_links


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (202, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in (200, 201, 202)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
