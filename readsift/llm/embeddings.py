"""Near-duplicate embeddings within a label: HNSW graphs per shard, every shard queried, links verified, components united.

Copies of a vector within a label stand as one node. The nodes of a label are dealt into shards of bounded size; a graph
is built per shard and written as a file to the shared folder, and each shard's vectors query every shard of their
label: what is shuffled is the files' names. A query's beam is widened while all
that it holds lies above the threshold; queries of an audit are compared with all vectors of the shard, more of them
where links are sparse, and the beams of all are widened until the audit finds no link missing. Links are verified in double precision. A task keeps links as
bits and sends counts and a spanning forest, so that a dense group sends rows in proportion to its members.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsift.llm.common import cut, file_system, new_folder, release, remove, settled
from readsift.llm.components import components
from readsift.llm.hnsw import Graph

THRESHOLD = 0.98
#: Vectors of a shard, beam to begin with, queries of the audit of a pair of shards, least share of links it must find.
SHARD, BEAM, AUDIT, RECALL = 8192, 48, 128, 1.0
#: A label below SHARDS full shards is dealt into so many of at least LEAST vectors, so that it isn't one task.
SHARDS, LEAST = 6, 1024
#: True links that an audit must see before it says anything; it takes further queries until then, or until none is left.
AUDIT_LINKS = 128
#: How far single precision may stray from the threshold before a candidate is dropped unverified.
SLACK = 1e-4


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that neither huge nor tiny components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def search(graph: Graph, queries: np.ndarray, beam: int, threshold: float, wide: int | None = None) -> np.ndarray:
    """Bits of the graph's points with a similarity of ``threshold`` or more, per query; full beams are widened."""
    n = len(graph.vectors)
    found = np.zeros((len(queries), n), bool)
    rows = np.arange(len(queries))
    while len(rows):
        beam = min(beam, n)
        full = []
        step = max(1, min(256, (1 << 17) // beam))
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            ids, sims = graph.search(queries[r], beam)
            at, column = np.nonzero((sims >= threshold) & (ids >= 0))
            found[r[at], ids[at, column]] = True
            full.append(r[(sims[:, -1] >= threshold) & (beam < n)])
        rows = np.concatenate(full)
        beam *= 2
    return found


def links(graph: Graph, queries: np.ndarray, threshold: float = THRESHOLD, *, same: bool = False) -> np.ndarray:
    """Bits of the verified links between unit vectors (rows) and the graph's points (columns)."""
    points = _unit(graph.vectors.astype(np.float64)) if not hasattr(graph, "exact") else graph.exact
    q32 = queries.astype(np.float32)
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int))
    rest = np.random.default_rng(1).permutation(np.setdiff1d(np.arange(len(queries)), audit))

    def compared(some: np.ndarray) -> np.ndarray:
        true = queries[some] @ points.T >= threshold
        if same:
            true[np.arange(len(some)), some] = False
        return true

    truths = [compared(audit)]
    seen = truths[0].sum()
    while seen < AUDIT_LINKS and len(rest):
        audit, rest, some = np.concatenate([audit, rest[:512]]), rest[512:], rest[:512]
        truths.append(compared(some))
        seen += truths[-1].sum()
    truth = np.concatenate(truths)
    if not len(rest):  # all are compared: these are the links
        found = np.zeros(truth.shape, bool)
        found[audit] = truth
        return found
    del truths
    beam = BEAM
    while True:
        found = search(graph, q32, beam, threshold - SLACK)
        if same:
            np.fill_diagonal(found, False)
            found |= found.T
        hit, all_ = (found[audit] & truth).sum(), truth.sum()
        if hit >= RECALL * all_ or beam >= len(points):
            break
        beam *= 4
    for a in range(0, len(queries), 512):
        row, column = np.nonzero(found[a : a + 512])
        for b in range(0, len(row), 1 << 18):
            r, c = row[b : b + (1 << 18)] + a, column[b : b + (1 << 18)]
            found[r, c] = np.einsum("ij,ij->i", queries[r], points[c]) >= threshold
    if hit < RECALL * all_:  # the graph does not reach everything: its rows are compared with all
        for a in range(0, len(queries), 512):
            found[a : a + 512] |= queries[a : a + 512] @ points.T >= threshold
        if same:
            np.fill_diagonal(found, False)
    return found


def _forest(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> dict[int, int]:
    """The least id that each linked vector reaches by these links."""
    root = {int(x): int(x) for x in np.concatenate([left[found.any(1)], right[found.any(0)]])}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in np.flatnonzero(found.any(1)).tolist():
        row = np.flatnonzero(found[i])
        ends = {top(int(left[i]))} | {top(y) for y in right[row].tolist()}
        least = min(ends)
        for e in ends:
            root[e] = least
    return {x: top(x) for x in root}


def _build(rows: pa.Table, folder: str) -> pa.Table:
    """The file of a shard: nodes, copies, unit vectors and graph. A task that runs twice leaves two, one of them named."""
    order = np.argsort(rows.column("node").to_numpy())
    vectors = _unit(_matrix(rows.column("embedding"), rows.num_rows))[order]
    body = Graph.build(vectors, seed=1).save()
    name = uuid.uuid4().hex
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        sink = io.BytesIO()
        np.savez(sink, node=rows.column("node").to_numpy()[order], copies=rows.column("copies").to_numpy()[order], vectors=vectors, graph=np.frombuffer(body, np.uint8))
        out.write(sink.getvalue())
    release()
    first = rows.slice(0, 1)
    return pa.table([first.column("label"), first.column("dim"), first.column("shard"), pa.array([name])], names=["label", "dim", "shard", "file"])


def _load(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/{name}") as file:
        held = np.load(io.BytesIO(file.read()))
        graph = Graph.load(held["graph"].tobytes())
        graph.exact = held["vectors"]
        return held["node"], held["copies"], held["vectors"], graph


FOUND = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])


def _query(batches, folder: str):
    """Links between two shards (or within one): per linked node its least reachable node and its links."""
    for batch in batches:
        for one, other in zip(batch.column("file").to_pylist(), batch.column("other_file").to_pylist()):
            left, copies, a, _ = _load(folder, one)
            right, others, _, graph = _load(folder, other)
            same = one == other
            found = links(graph, a, same=same)
            root = _forest(found, left, right)
            n = dict(zip(left.tolist(), (found @ others).tolist()))
            if not same:
                n |= dict(zip(right.tolist(), (found.T @ copies).tolist()))
            yield pa.RecordBatch.from_pylist([{"node": x, "root": r, "n": int(n[x])} for x, r in root.items()], schema=FOUND)
            del found, graph
    release()


#: Pairs of shards that a task works through, at most.
MOST_TASKS = 100_000


def link(vectors: DataFrame, *, vec_id="vec_id", embedding="embedding", label="label") -> DataFrame:
    """Per row: vec_id, n_links (rows linked directly), component_id (least vec_id reached), kept (it is its own).

    Two rows link if their labels are equal and not null, their vectors have one length and a cosine of THRESHOLD or
    more. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a
    null vec_id (component null, kept false). Rows that repeat an id, with equal or other vectors, of one label or of
    several, are vectors of their own: their links and components are those of their label and vector. Other columns are
    ignored.
    """
    spark = vectors.sparkSession
    folder = new_folder(spark, "shards")
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound)
    nodes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = cut(nodes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()))
    many = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    wide = F.greatest(F.ceil(F.col("n") / F.lit(SHARD)), F.least(F.lit(SHARDS), F.ceil(F.col("n") / F.lit(LEAST))))
    dealt = nodes.join(many.select("label", "dim", wide.alias("shards")), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")))
    kind = nodes.schema["label"].dataType.simpleString()
    dealt = dealt.select("label", "dim", "shard", "node", "copies", "embedding").groupBy("label", "dim", "shard")
    shards = settled(dealt.applyInArrow(lambda rows: _build(rows, folder), f"label {kind}, dim int, shard long, file string"))
    other = shards.select("label", "dim", F.col("shard").alias("other"), F.col("file").alias("other_file"))
    pairs = settled(shards.join(other, ["label", "dim"]).where("other >= shard").select("file", "other_file"))
    spread = pairs.repartition(max(1, min(pairs.count(), MOST_TASKS)), "file", "other_file")
    found = settled(spread.mapInArrow(lambda batches: _query(batches, folder), "node long, root long, n long"))
    remove(folder)
    joined = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "root")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    rooted = nodes.select("node", "least").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = nodes.select("node", "copies", F.col("label").alias("label_"), F.col("embedding").alias("embedding_")).join(counts, "node", "left").join(rooted.join(heads, "root").select("node", "component"), "node")
    members = given.join(classes, F.col("vec_id").isNotNull() & (F.col("label") == F.col("label_")) & (F.col("embedding") == F.col("embedding_")), "left")
    links_ = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("n", F.lit(0))
    component = F.coalesce("component", "vec_id")
    return members.select("vec_id", links_.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
