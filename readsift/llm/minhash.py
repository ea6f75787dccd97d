"""Near-duplicate documents by DartMinHash signatures and banded joins.

A document is a weighted set: its five-word shingles by the times they occur. Each shingle owns a strip of unit width
per occurrence; darts fall on every strip as a hashed Poisson process along the axis of ranks, each with a coordinate,
and the signature keeps the earliest dart of each coordinate. A document of weight W looks at ranks up to about
K (ln K + 2) / W, so it throws that many darts whatever its length; two documents agree in a coordinate with the
probability of their weighted Jaccard similarity.

Equal texts stand as one node. In each bucket of a band all members are paired with the one that most buckets share,
which is the one nearest to the middle of a group; pairs whose signatures do not rule them out are compared exactly.
What is not yet one component is paired with the next such member. Buckets whose members are still apart then are
compared exactly in blocks of bounded size that send a spanning forest, so that no link between members is lost, no
bucket gathers in one task, and rows grow with the members of a group, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readsift.llm import rolling, sketch
from readsift.llm.common import WORD, cut, fresh, release, settled, slices
from readsift.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Two documents at SIMILARITY share a bucket with probability 1 - (1 - 0.8**5)**32, which is 0.999997.
BANDS, ROWS = 32, 5
K = BANDS * ROWS
#: Estimates below and from which a pair is decided by its signatures. A pair at SIMILARITY falls below the first, or a pair
#: under it reaches the second (156 of 160 coordinates), with a probability of less than 1e-8 and 1e-10.
SURELY_NOT, SURELY = SIMILARITY - 0.2, 0.975
#: Rounds in which a bucket's members are paired with one of them; members of a block, and elements at once, after that.
ROUNDS, BLOCK, COLUMNS = 2, 1024, 2048
#: Elements of sets that throw darts at once.
THROWERS = 1 << 20
_ROUND = np.uint64(0x9E3779B97F4A7C15)


def elements(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the weighted shingles of texts, one per unit of weight, text after text; how many each has; and 128-bit
    digests of the sequences of words (two columns).

    A text of fewer words than a shingle has one, of all its words; a text without words has none.
    """
    (hashes, _), counts, digests = rolling.hashed(texts, prints=True)
    del _
    prints = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    first = np.cumsum(counts) - counts
    size = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    upto = np.cumsum(size) - size
    found = np.zeros(int(size.sum()), np.uint64)
    for n in range(1, shingle):
        some = np.flatnonzero(counts == n)
        if len(some):
            found[upto[some]] = rolling.windows(hashes, n)[first[some]]
    if (counts >= shingle).any():
        all_ = rolling.windows(hashes, shingle)
        for at, a, n in zip(upto.tolist(), first.tolist(), np.where(counts >= shingle, size, 0).tolist()):
            found[at : at + n] = all_[a : a + n]
            found[at : at + n].sort()
        del all_
    del hashes
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[upto[size > 0]] = True
    again = np.flatnonzero(~new)
    if len(again):
        place = np.flatnonzero(new)
        times = again - place[np.searchsorted(place, again) - 1]
    for a in range(0, len(found), THROWERS):
        found[a : a + THROWERS] = rolling.scramble(found[a : a + THROWERS])
    if len(again):
        found[again] = rolling.scramble(found[again] + times.astype(np.uint64) * _ROUND)
    return found, size, prints


def signatures(values: np.ndarray, size: np.ndarray, k: int = K) -> np.ndarray:
    """Signatures (rows of 32-bit hashes of the earliest darts) of sets that are not empty: elements, set after set, and
    the number of each set's."""
    out = np.zeros((len(size), k), np.uint32)
    first = np.cumsum(size) - size
    todo = np.arange(len(size))
    reach = k * (np.log(k) + 2)
    while len(todo):
        limit = reach / size[todo]
        ends = np.cumsum(size[todo])
        ranks, keys, darts = [], [], []
        for a in range(0, int(ends[-1]), THROWERS):
            at = np.arange(a, min(a + THROWERS, int(ends[-1])))
            owner = np.searchsorted(ends, at, side="right")
            seed = values[first[todo[owner]] + at - (ends[owner] - size[todo[owner]])]
            rank = np.zeros(len(seed))
            turn = 0
            while len(seed):
                turn += 1
                dart = rolling.scramble(seed + np.array([turn], np.uint64) * _ROUND)
                rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                inside = rank < limit[owner]
                seed, owner, rank, dart = seed[inside], owner[inside], rank[inside], dart[inside]
                thrown = rolling.scramble(dart)
                ranks.append(rank)
                keys.append(owner * k + (thrown % np.uint64(k)).astype(np.int64))
                darts.append((thrown >> np.uint64(32)).astype(np.uint32))
        key, rank, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        best = np.full(len(todo) * k, np.inf)
        np.minimum.at(best, key, rank)
        earliest = np.flatnonzero(rank == best[key])
        out[todo[key[earliest] // k], key[earliest] % k] = dart[earliest]
        todo = todo[np.isinf(best).reshape(-1, k).any(1)]  # a coordinate without a dart: look further along the ranks
        reach *= 2
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found, size, prints = elements(batch.column("text"))
        some = np.flatnonzero(size)
        if not len(some):
            continue
        signed, prints = signatures(found, size[some]), prints[some].view(np.int64)
        del found
        body = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.arange(len(some) + 1, dtype=np.int32) * 4 * K), pa.py_buffer(signed)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), body], names=["doc_id", "k1", "k2", "sig"])


def _unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = _unpack(batch.column("sig")).astype(np.uint64).reshape(-1, BANDS, ROWS)
            held = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]) + np.uint64(1)
            for i in range(ROWS):
                held = rolling.scramble(held * _ROUND + sig[:, :, i])
            flat = pa.array(np.ascontiguousarray(held).view(np.int64).reshape(-1))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([batch.column("node"), bands], names=["node", "bands"])


#: Two components and, of a text in each, the id and the key.
PAIR = ["a", "b", "doc_a", "key_a", "doc_b", "key_b"]


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            same = (_unpack(batch.column("sig_a")) == _unpack(batch.column("sig_b"))).mean(1)
            out = batch.select(PAIR).append_column("sure", pa.array(same >= SURELY))
            yield out.filter(pa.array(same >= SURELY_NOT))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("set_a", "set_b"))
            both = len(np.intersect1d(x, y, assume_unique=True))
            links.append(both >= SIMILARITY * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))
    release()


def _sets(wanted: DataFrame, docs: DataFrame, expected: int) -> DataFrame:
    """(doc, key, set) of the texts in ``wanted`` (doc): a bitmap of the ids, of bounded size, chooses them where texts are
    read, so that no other document is among them but by chance or for sharing an id."""
    held = sketch.build(wanted.select(F.array(F.xxhash64("doc")).alias("keys")), "keys", expected, 2, 1)
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (batch.filter(pa.array(shared.value(batch.column("at").to_numpy().view(np.uint64)))) for batch in batches)
        for part in slices(some, "text"):
            found, size, prints = elements(part.column("text"))
            ends = np.concatenate([[0], np.cumsum(8 * size)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints[:, 0].copy().view(np.int64)), _bodies(found, ends)], names=["doc", "key", "set"])

    return docs.where("doc_id is not null and text is not null").withColumn("at", F.xxhash64("doc_id")).mapInArrow(sets, "doc long, key long, set binary")


def _bodies(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array, by their ends in bytes, as binary values."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def _exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose weighted Jaccard similarity, by their shingles, is SIMILARITY or more, as links (a, b)."""
    side = lambda x: sets.select(F.col("doc").alias(f"doc_{x}"), F.col("key").alias(f"key_{x}"), F.col("set").alias(f"set_{x}"))
    return pairs.join(side("a"), ["doc_a", "key_a"]).join(side("b"), ["doc_b", "key_b"]).select("a", "b", "set_a", "set_b").mapInArrow(_compared, "a long, b long")


def shared_elements(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets (rows) with sets (columns): a product over the elements that both sides have."""
    size = [np.array([len(x) for x in side]) for side in (left, right)]
    flat = [np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right)]
    common = np.intersect1d(*map(np.unique, flat), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    rows, places = [], []
    for n, values in zip(size, flat):
        at = np.searchsorted(common, values)
        hit = at < len(common)
        hit[hit] = common[at[hit]] == values[hit]
        rows.append(np.repeat(np.arange(len(n)), n)[hit])
        places.append(at[hit])
    for a in range(0, len(common), COLUMNS):
        sides = []
        for n, row, place in zip(size, rows, places):
            here = (place >= a) & (place < a + COLUMNS)
            m = np.zeros((len(n), min(COLUMNS, len(common) - a)), np.float32)
            m[row[here], place[here] - a] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _block_links(rows: pa.Table) -> pa.Table:
    """A spanning forest of the links between two blocks of a bucket, or within one, over its components."""
    comp, block = (rows.column(c).to_numpy() for c in ("component", "block"))
    sets = [np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("set")]
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b = [], []
    if len(left) and len(right):
        both = shared_elements([sets[x] for x in left], [sets[x] for x in right])
        size = np.array([len(x) for x in sets], np.float64)
        least = size[left][:, None] + size[right][None, :]
        least -= both
        least *= SIMILARITY
        linked = both >= least
        del both, least, sets
        root = np.unique(comp, return_inverse=True)[1].reshape(-1)
        for x in np.flatnonzero(linked.any(1)):
            to = right[np.flatnonzero(linked[x])]
            ends, at = np.unique(root[to], return_index=True)
            new = ends != root[left[x]]
            if new.any():
                a += [int(comp[left[x]])] * int(new.sum())
                b += comp[to[at[new]]].tolist()
                root[np.isin(root, ends[new])] = root[left[x]]
    release()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _united(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with their components replaced by those that ``found`` (component, to) names."""
    joined = rows.join(found, "component", "left")
    return joined.withColumn("component", F.coalesce("to", "component")).drop("to")


def _merged(edges: DataFrame) -> DataFrame:
    """(component, to) of the components that edges between them unite."""
    return settled(components(settled(edges)).select(F.col("node").alias("component"), F.col("component").alias("to")))


def _apart(placed: DataFrame) -> DataFrame:
    """Bands whose members are in several components; of bands with the same members one."""
    members = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("node").alias("least"))
    return members.where("low <> high").groupBy("members", "sum", "least").agg(F.min("band").alias("band")).select("band", "members")


def classes(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and component_id, the least doc_id of its class, for every document with words and an id.

    Documents are linked if the weighted Jaccard similarity of their five-word shingles is SIMILARITY or more; classes
    are the components of these links. Rows that share an id are of one class, whatever their texts.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = cut(given.where("doc_id is not null and text is not null").mapInArrow(_sign, "doc_id long, k1 long, k2 long, sig binary"))
    texts = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"))
    nodes = cut(texts.withColumn("node", F.monotonically_increasing_id()))
    members = settled(signed.select("doc_id", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("other")))
    several = signed.select("doc_id", "k1", "k2").join(members.where("node <> other").select("doc_id", F.col("node").alias("least")), "doc_id")
    alike = several.join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select(F.col("least").alias("a"), F.col("node").alias("b")).where("a <> b")

    banded = nodes.select("node", "sig").mapInArrow(_banded, "node long, bands array<bigint>").select("node", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = settled(banded.join(full, "band"))
    scores = settled(shared.groupBy("node").agg(F.sum("n").alias("score")))
    sets = cut(_sets(nodes.join(scores, "node").select("doc"), given, scores.count()))
    signs = lambda x: nodes.select(F.col("node").alias(f"of_{x}"), F.col("doc").alias(f"doc_{x}"), F.col("k1").alias(f"key_{x}"), F.col("sig").alias(f"sig_{x}"))

    roots = nodes.select("node", F.col("node").alias("component"))
    rows = shared.join(scores, "node").select("band", "node", "score", F.col("node").alias("component"))
    for turn in range(ROUNDS):
        if turn:
            rows = rows.join(_apart(rows).select("band"), "band")
        heads = rows.groupBy("band").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"), "component")).alias("h"))
        heads = heads.select("band", (-F.col("h.minus")).alias("head"), F.col("h.component").alias("over"))
        rows = settled(rows.join(heads, "band").where("node <> head"))
        stars = rows.where("component <> over").select(F.col("over").alias("a"), F.col("component").alias("b"), F.col("head").alias("of_a"), F.col("node").alias("of_b")).distinct()
        pairs = stars.join(signs("a"), "of_a").join(signs("b"), "of_b")
        likely = settled(pairs.mapInArrow(_estimated, ", ".join(f"{c} long" for c in PAIR) + ", sure boolean"))
        merged = _merged(likely.where("sure").select("a", "b").unionByName(_exact(likely.where("not sure"), sets)))
        rows = settled(_united(rows.drop("head", "over"), merged))
        roots = _united(roots, merged)

    blocks = _apart(rows).select("band", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = settled(rows.join(blocks, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    spread = dealt.join(nodes.select("node", "doc", F.col("k1").alias("key")), "node").join(sets, ["doc", "key"]).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("band", "component", "set", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    late = spread.groupBy("band", "i", "j").applyInArrow(lambda rows: _block_links(rows), "a long, b long")
    roots = settled(roots)
    side = lambda x: roots.select(F.col("node").alias(x), F.col("component").alias(f"to_{x}"))
    alike = alike.join(side("a"), "a").join(side("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
    roots = settled(_united(roots, _merged(late.unionByName(alike))))
    least = nodes.select("node", "doc").join(roots, "node").groupBy("component").agg(F.min("doc").alias("component_id"))
    return members.select("doc_id", "node").join(roots, "node").join(least, "component").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, component_id, kept (it is the least id of its class).

    A document without words is a class of its own; so is a row with a null id, whose component is null. Other columns
    are ignored.
    """
    found = classes(docs, text=text, doc_id=doc_id).withColumnRenamed("doc_id", "of")
    given = docs.select(F.col(doc_id).alias("doc_id"))
    joined = given.join(found, F.col("doc_id") == F.col("of"), "left")
    component = F.coalesce("component_id", F.col("doc_id").cast("long"))
    return joined.select("doc_id", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does, with all their columns.

    Only the ids of what goes are joined to the texts. Rows that share an id are one class, of which one row stays, the
    one with the least text; of rows without an id, one of each text stays, and all without words.
    """
    name = fresh(docs, "gone")
    gone = classes(docs, text=text, doc_id=doc_id).where("component_id <> doc_id").select(F.col("doc_id").alias(name))
    left = docs.join(gone, docs[doc_id] == F.col(name), "left_anti")
    again = settled(left.groupBy(doc_id).agg(F.count("*").alias(name)).where(f"{name} > 1").select(F.col(doc_id).alias(name)))
    if not again.count():
        return left
    alone = left.join(again, left[doc_id].eqNullSafe(F.col(name)), "left_anti")
    twice = left.join(again, left[doc_id].eqNullSafe(F.col(name)), "left_semi")
    bare = F.col(doc_id).isNull() & ~F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    same = Window.partitionBy(doc_id, F.when(F.col(doc_id).isNull(), F.col(text))).orderBy(text)
    one = twice.where(~bare).withColumn(name, F.row_number().over(same)).where(f"{name} = 1").drop(name)
    return alone.unionByName(twice.where(bare)).unionByName(one)
