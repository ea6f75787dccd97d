"""Removal of word windows that an earlier document also has, with a count-min prefilter.

A window is SIZE consecutive words. Of its inner grams of GRAM words the one with the least hash is its anchor; equal
windows have equal anchors, and consecutive windows with one anchor form a run, so anchors stand for windows at a
twentieth of their number. 1. Partition sketches of anchors, merged, tell which may occur in more than one document;
the sketch overestimates and loses none. 2. Runs with such anchors are grouped exactly: by the 128-bit hash of all
their windows; a document that is not the first with a run loses it whole. 3. Only where an anchor has runs of several
kinds can single windows be shared between kinds: the windows of the first document of each kind are grouped by their
own 128-bit hash. Only the texts of documents that lose words meet what is removed in a join; a bitmap of their ids, of
bounded size, chooses them where texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsift.llm import rolling, sketch
from readsift.llm.common import cut, pieces, release, settled, slices

SIZE, GRAM = 50, 8
#: A run is cut after this many windows, counted from its start, so that rows stay small in periodic texts.
LONGEST_RUN = 64
#: Words whose windows are looked at together; a longer text is cut there, and its runs with it.
CHUNK = 1 << 19
DEPTH = 3
#: Bytes of text that are expected to bring one anchor; only the sketch's width depends on it.
BYTES_PER_ANCHOR = 100


class _Runs:
    """Runs of windows of some texts: the text of each, anchor, start in its text, number of windows."""

    def __init__(self, lanes: list[np.ndarray], first: np.ndarray, counts: np.ndarray, a: int, size: int, gram: int):
        upto = min(a + CHUNK, len(lanes[0]))
        self.lanes, self.size = [x[a : upto + size - 1] for x in lanes], size
        low, high = np.maximum(first, a), np.minimum(first + counts - size + 1, upto)
        some = np.flatnonzero(high > low)
        at = rolling.ranges(low[some] - a, (high - low)[some])
        owner = np.repeat(some, (high - low)[some])
        anchors = rolling.sliding_min(rolling.windows(self.lanes[0], gram), size - gram + 1)[at] if len(at) else np.zeros(0, np.uint64)
        new = np.ones(len(at), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
        change = np.flatnonzero(new)
        length = np.diff(np.append(change, len(at)))
        if len(length) and length.max() > LONGEST_RUN:
            parts = -(-length // LONGEST_RUN)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            change = np.repeat(change, parts) + inner * LONGEST_RUN
            length = np.diff(np.append(change, len(at)))
        self.text, self.anchor, self.at, self.length = owner[change], anchors[change], at[change], length
        self.start = self.at + a - first[self.text]

    def take(self, some: np.ndarray) -> None:
        for name in ("text", "anchor", "at", "length", "start"):
            setattr(self, name, getattr(self, name)[some])

    def kinds(self) -> list[np.ndarray]:
        """What tells runs apart: all words that their windows cover, and their number."""
        return [rolling.spans(x, self.at, self.length + self.size - 1) for x in self.lanes]

    def windows(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Hashes of all windows of the runs, the run of each, and its start in its text."""
        wide = self.length + self.size - 1
        inner = rolling.ranges(self.at, wide)
        begin = np.cumsum(wide) - wide
        own = rolling.ranges(begin, self.length)
        run = np.repeat(np.arange(len(wide)), self.length)
        hashes = [rolling.windows(x[inner], self.size)[own] if len(own) else np.zeros(0, np.uint64) for x in self.lanes]
        return hashes, run, own - begin[run] + self.start[run]


def _runs(column: pa.Array, size: int, gram: int) -> Iterator[_Runs]:
    lanes, counts, _ = rolling.hashed(column)
    first = np.cumsum(counts) - counts
    for a in range(0, len(lanes[0]) - size + 1, CHUNK):
        yield _Runs(lanes, first, counts, a, size, gram)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _id_key(doc: np.ndarray) -> np.ndarray:
    return rolling.scramble(np.asarray(doc, np.int64).view(np.uint64))


def _head_key(kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return rolling.scramble(kind ^ _id_key(doc))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def removed_words(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Runs of windows to be removed: doc_id, print (of the text), start, n. ``docs`` has doc_id, text, print."""
    spark = docs.sparkSession
    whole = docs.where("doc_id is not null and text is not null")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for runs in _runs(batch.column("text"), size, gram):
                order = np.lexsort((runs.anchor, runs.text))  # once per text
                text, keys = runs.text[order], runs.anchor[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
                keys = keys[new].view(np.int64)
                if len(keys):
                    yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(keys))], names=["keys"])

    length = whole.agg(F.sum(F.octet_length("text")).alias("n")).collect()[0]["n"] or 0
    expected = length // BYTES_PER_ANCHOR
    repeated = sketch.build(whole.select("text").mapInArrow(anchors, "keys array<bigint>"), "keys", expected, DEPTH, 2)
    shared = spark.sparkContext.broadcast(repeated)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, print_ = _ids(batch), batch.column("print").to_numpy()
            for runs in _runs(batch.column("text"), size, gram):
                runs.take(np.flatnonzero(shared.value(runs.anchor)))
                if len(runs.anchor):
                    k1, k2 = runs.kinds()
                    yield pa.RecordBatch.from_arrays([_signed(c) for c in (runs.anchor, k1, k2, doc[runs.text], print_[runs.text], runs.start, runs.length)], names=["anchor", "k1", "k2", "doc_id", "print", "start", "n"])

    runs = cut(whole.select("doc_id", "print", "text").mapInArrow(candidates, "anchor long, k1 long, k2 long, doc_id long, print long, start long, n long"))
    heads = cut(runs.groupBy("anchor", "k1", "k2").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows")))
    later = runs.join(heads.where("rows > 1").select("k1", "k2", "head"), ["k1", "k2"]).where("doc_id > head").select("doc_id", "print", "start", "n")

    several = heads.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    mixed = heads.join(several, "anchor").select("k1", "head")

    def head_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, head = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "head"))
            keys = np.concatenate([_head_key(kind.view(np.uint64), head), np.unique(_id_key(head))]).view(np.int64)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), pa.array(keys))], names=["keys"])

    of_heads = spark.sparkContext.broadcast(sketch.build(mixed.mapInArrow(head_keys, "keys array<bigint>"), "keys", expected, 2, 1))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (batch.filter(pa.array(of_heads.value(_id_key(_ids(batch))))) for batch in batches)
        for batch in slices(named, "text"):
            doc, print_ = _ids(batch), batch.column("print").to_numpy()
            for runs in _runs(batch.column("text"), size, gram):
                runs.take(np.flatnonzero(shared.value(runs.anchor)))
                if len(runs.anchor):
                    runs.take(np.flatnonzero(of_heads.value(_head_key(runs.kinds()[0], doc[runs.text]))))
                if len(runs.anchor):
                    both, run, start = runs.windows()
                    text = runs.text[run]
                    yield pa.RecordBatch.from_arrays([_signed(c) for c in (*both, doc[text], print_[text], start)], names=["w1", "w2", "doc_id", "print", "start"])

    windows = cut(whole.select("doc_id", "print", "text").mapInArrow(single, "w1 long, w2 long, doc_id long, print long, start long"))
    owners = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("last > owner")
    alone = windows.join(owners, ["w1", "w2"]).where("doc_id > owner").select("doc_id", "print", "start", F.lit(1).cast("long").alias("n"))
    return later.unionByName(alone)


def _kept(raw: bytes, gone: np.ndarray | None) -> tuple[bytes, int]:
    """The words that are not gone, joined by a space, and the number of all."""
    kept, n = [], 0
    for piece in pieces(raw):
        words = piece.split()
        some = words if gone is None else [words[j] for j in np.flatnonzero(~gone[n : n + len(words)]).tolist()]
        n += len(words)
        if some:
            kept.append(b" ".join(some))
    return b" ".join(kept), n


def _apply(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The texts without what is removed: runs of windows in ``starts`` and ``lengths``, where there are such columns."""
    for batch in slices(batches, "text"):
        kept, n_words, n_removed = [], [], []
        has = "starts" in batch.schema.names
        for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            raw, gone = raw or b"", None
            if has and batch.column("starts")[i].is_valid:
                a = batch.column("starts")[i].values.to_numpy(zero_copy_only=False)
                b = a + batch.column("lengths")[i].values.to_numpy(zero_copy_only=False) + size - 1
                marks = np.zeros(int(b.max()) + 1, np.int32)
                np.add.at(marks, a, 1)
                np.add.at(marks, b, -1)
                gone = np.cumsum(marks) > 0
                gone = np.concatenate([gone, np.zeros(max(0, len(raw) // 2 + 1 - len(gone)), bool)])
            text, n = _kept(raw, gone)
            kept.append(text)
            n_words.append(n)
            n_removed.append(0 if gone is None else int(gone.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["doc_id", "kept_text", "n_words", "n_removed"])
    release()


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, kept_text (kept words joined by one space), n_words, n_removed.

    A word goes if a window over it also starts in a document with a smaller doc_id, judged on the input as given. A
    null text has no words. Rows with a null doc_id are kept whole and take nothing from others. Rows that share an id
    do not take from each other; each loses by its own text. Other columns are ignored. doc_id is a whole number.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("print"))
    gone = removed_words(given, size, gram).distinct().groupBy("doc_id", "print")
    gone = settled(gone.agg(F.collect_list(F.struct("start", "n")).alias("runs")))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("print").alias("p"), F.col("runs.start").alias("starts"), F.col("runs.n").alias("lengths"))
    losers = sketch.build(gone.select(F.array(F.xxhash64("d")).alias("keys")), "keys", gone.count(), 2, 1)
    shared = docs.sparkSession.sparkContext.broadcast(losers)

    def chosen(batches: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = shared.value(batch.column("key").to_numpy().view(np.uint64)) == inside
            if hit.any():
                yield batch.filter(pa.array(hit)).drop_columns(["key"])

    keyed = given.withColumn("key", F.xxhash64("doc_id"))
    schema = "doc_id long, kept_text string, n_words long, n_removed long"
    some = keyed.mapInArrow(partial(chosen, inside=True), given.schema).join(gone, (F.col("doc_id") == F.col("d")) & (F.col("print") == F.col("p")), "left")
    lost = some.select("doc_id", "text", "starts", "lengths").mapInArrow(lambda batches: _apply(batches, size), schema)
    return keyed.mapInArrow(lambda batches: _apply(chosen(batches, False), size), schema).unionByName(lost)
