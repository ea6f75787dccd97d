"""Which bins hold the hashes of a read: a join, a broadcast of a small index, or an approximate filter.

All three give one row per read: read_ord, num_hashes, and patterns, an array of (bins, n) with the number n of hashes
that hit exactly these bins. A read has few patterns, so all that follows is arithmetic on one row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readsift.functions import memory
from readsift.operators.index import IndexModel

#: Hashes up to which an index is broadcast to the workers of a stream, about 300 MB in each.
MOST_LOCAL = 20_000_000
#: The same for tables, where a larger index is joined instead: about 50 MB in each worker, 100 MB on the driver.
MOST_BROADCAST = 4_000_000
PATTERNS = "array<struct<bins:array<int>,n:bigint>>"


def probe_rows(read_hashes: DataFrame, index: IndexModel) -> DataFrame:
    """The rows of (read_ord, h) with the bins that hold h; null where none does. A miss still counts."""
    return read_hashes.join(index.by_hash(), "h", "left")


def _gather(probed: DataFrame) -> DataFrame:
    """Rows (read_ord, bins) to one row per read. Equal patterns are combined before the shuffle."""
    counted = probed.groupBy("read_ord", "bins").agg(F.count("*").alias("n"))
    hit = F.when(F.col("bins").isNotNull(), F.struct("bins", "n"))
    return counted.groupBy("read_ord").agg(F.sum("n").alias("num_hashes"), F.collect_list(hit).alias("patterns"))


def by_join(reads: DataFrame, index: IndexModel) -> DataFrame:
    """The probe as a left equi-join on the hash; a hot hash is split by adaptive execution."""
    return _gather(probe_rows(reads.select("read_ord", F.explode("minimisers").alias("h")), index))


#: Bits of a block of a filter: a hash chooses a block, and all its places lie there, so that one look answers.
BLOCK_BITS = 1 << 13


#: Blocks times bins of a slab, which is built and probed at once: 16 MB when each bit is a byte, 2 MB packed.
SLAB = 1 << 11


def _slab(index: IndexModel) -> int:
    """Blocks of a slab."""
    return max(1, SLAB // max(1, len(index.bin_rows())))


def filter_blocks(index: IndexModel, n: int | None = None) -> DataFrame:
    """block, bins, bits: the filters of all bins, block by block; a row holds BLOCK_BITS bits for every bin with a hash there.

    Every bin has places for the largest bin at ``max_fpr``, so that a smaller bin errs less; no hit is lost. This table
    can be stored and probed instead of the hashes. A call of Python builds a slab of blocks.
    """
    num_hash, n = index.settings.num_hash, n or _blocks(index)

    def build(rows: pa.Table) -> pa.Table:
        h = rows.column("h").to_numpy()
        keys, row = np.unique(rows.column("block").to_numpy() << 32 | rows.column("bin").to_numpy(), return_inverse=True)
        packed = np.empty((len(keys), BLOCK_BITS // 8), np.uint8)
        order = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[order], np.arange(0, len(keys) + SLAB, SLAB))
        for a, low, high in zip(range(0, len(keys), SLAB), edges, edges[1:]):  # blocks overfull with bins are more than one round
            bits = np.zeros((min(SLAB, len(keys) - a), BLOCK_BITS), np.uint8)
            for i in range(num_hash):
                bits[row[order[low:high]] - a, _place(h[order[low:high]], i)] = 1
            packed[a : a + SLAB] = np.packbits(bits, axis=1)
        blocks, first = np.unique(keys >> 32, return_index=True)
        at = np.append(first, len(keys)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array((keys & 0xFFFFFFFF).astype(np.int32)))
        flat = [packed[x:y].tobytes() for x, y in zip(at, at[1:])]
        memory.release()
        return pa.table([pa.array(blocks), lists, pa.array(flat, pa.binary())], names=["block", "bins", "bits"])

    keyed = index.hashes.select(_block(n).alias("block"), F.col("bin").cast("long").alias("bin"), "h")
    return keyed.groupBy((F.col("block") / _slab(index)).cast("long").alias("slab")).applyInArrow(lambda rows: build(rows), "block long, bins array<int>, bits binary")


def _blocks(index: IndexModel) -> int:
    s = index.settings
    most = index.bin_stats.agg(F.max("n_hashes")).collect()[0][0] or 1
    bits = max(1, min(s.bits, math.ceil(-(most * s.num_hash) / math.log(1 - math.exp(math.log(s.max_fpr) / s.num_hash)))))
    return -(-bits // BLOCK_BITS)


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("h"), F.lit(n))


def _place(h: np.ndarray, i: int) -> np.ndarray:
    """The place of each hash in its block, the i-th of them."""
    x = h.view(np.uint64) + np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - 13)).astype(np.int64)


class _Slab:
    """The blocks of one slab, and the test of hashes against them."""

    def __init__(self):
        self.block, self.bins, self.bits = [], [], []

    def add(self, rows: pa.RecordBatch) -> None:
        self.block += rows.column("block").to_pylist()
        for body in rows.column("body").to_pylist():
            bins, _, bits = body.partition(b":")
            self.bins.append([int(b) for b in bins.split(b",")])
            self.bits.append(bits)

    def ready(self) -> None:
        if isinstance(self.block, list):
            order = np.argsort(np.array(self.block, np.int64))
            self.block = np.array(self.block, np.int64)[order]
            self.size = np.array([len(self.bins[i]) for i in order], np.int64)
            self.start = np.cumsum(self.size) - self.size
            self.names = np.array([x for i in order for x in self.bins[i]], np.int32)
            self.rows = np.frombuffer(b"".join(self.bits[i] for i in order), np.uint8).reshape(len(self.names), BLOCK_BITS // 8)
            self.bins = self.bits = None

    def test(self, h: np.ndarray, block: np.ndarray, num_hash: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the hash, bin) of all hits, by place and bin."""
        self.ready()
        if not len(self.block):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        at = np.minimum(np.searchsorted(self.block, block), len(self.block) - 1)
        size = np.where(self.block[at] == block, self.size[at], 0)
        places = [_place(h, i) for i in range(num_hash)]
        which, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in range(int(size.max(initial=0))):
            mine = np.flatnonzero(size > j)
            row = self.start[at[mine]] + j
            for p in places:  # the few that are left after each place
                hit = (self.rows[row, p[mine] >> 3] >> (7 - (p[mine] & 7)).astype(np.uint8)) & 1 > 0
                mine, row = mine[hit], row[hit]
            which.append(mine)
            found.append(row)
        which, found = np.concatenate(which), np.concatenate(found)
        order = np.argsort(which, kind="stable")
        return which[order], self.names[found[order]]


def by_filter(reads: DataFrame, index: IndexModel) -> DataFrame:
    """The probe with filters in place of exact sets: a hash seems to be in a bin if all its places are set. Each distinct
    hash of the reads meets its block once.

    Slabs and the hashes that they answer stand in one sorted partition and stream by, so a worker holds one slab and one
    batch whatever the sizes. Few slabs are repeated, each for a part of the hashes, so that no task has all of them.
    """
    num_hash, n, slab = index.settings.num_hash, _blocks(index), _slab(index)
    tasks = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-tasks // -(-n // slab)))

    def probed(batches):
        held, now = _Slab(), None
        for batch in batches:
            key = batch.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now != key[a] >> 1:
                    held, now = _Slab(), key[a] >> 1
                rows = batch.slice(a, b - a)
                if key[a] & 1 == 0:
                    held.add(rows)
                    continue
                h = rows.column("h").to_numpy()
                which, bins = held.test(h, rows.column("block").to_numpy(), num_hash)
                some, size = np.unique(which, return_counts=True)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.record_batch([pa.array(h[some]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bins, pa.int32()))], names=["h", "bins"])
        memory.release()

    # few columns, since every row that goes to Python costs by their number; a slab's part comes first, then its hashes
    key = lambda part, kind: ((F.floor(F.col("block") / slab) * parts + part) * 2 + kind).cast("long").alias("key")
    wanted = reads.select(F.explode("minimisers").alias("h")).distinct().select("h", _block(n).alias("block"))
    hashes = wanted.select(key(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(parts)), 1), "block", "h", F.lit(None).cast("binary").alias("body"))
    body = F.concat(F.encode(F.concat(F.concat_ws(",", F.col("bins").cast("array<string>")), F.lit(":")), "utf-8"), "bits")
    repeated = filter_blocks(index, n).select("block", body.alias("body"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    slabs = repeated.select(key(F.col("part"), 0), "block", F.lit(0).cast("long").alias("h"), "body")
    dealt = slabs.unionByName(hashes).repartition(tasks, F.shiftright("key", 1)).sortWithinPartitions("key")
    by_hash = dealt.mapInArrow(probed, "h long, bins array<int>")
    return _gather(reads.select("read_ord", F.explode("minimisers").alias("h")).join(by_hash, "h", "left"))


def by_broadcast(reads: DataFrame, index: IndexModel) -> DataFrame:
    """The probe without a shuffle: a sorted array of hashes on every executor, searched per batch.

    An index of more than MOST_BROADCAST hashes is joined, which gives the same rows, so the size of the index is counted
    first. A stream can't be joined; its index is broadcast up to MOST_LOCAL hashes, and a larger one is an error.
    """
    size = index.hashes.select("h").distinct().count()
    if not reads.isStreaming and size > MOST_BROADCAST:
        return _joined(reads, by_join(reads, index))
    if size > MOST_LOCAL:
        raise ValueError(f"an index of more than {MOST_LOCAL} hashes is not broadcast to a stream")
    rows = index.by_hash().select("h", F.concat_ws(",", F.col("bins").cast("array<string>")).alias("bins")).toArrow()
    h = rows.column("h").to_numpy()
    coded = rows.column("bins").combine_chunks().dictionary_encode()  # few kinds of bins, and no list a hash
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    kinds = [tuple(map(int, x.split(","))) for x in coded.dictionary.to_pylist()]
    order = np.argsort(h)
    shared = reads.sparkSession.sparkContext.broadcast((h[order], coded.indices.to_numpy()[order], kinds))
    from pyspark.sql.types import LongType, StructType

    schema = StructType([f for f in reads.schema.fields if f.name != "minimisers"]).add("num_hashes", LongType())
    schema = StructType([*schema.fields, *StructType.fromDDL(f"patterns {PATTERNS}").fields])
    out_type = pa.list_(pa.struct([("bins", pa.list_(pa.int32())), ("n", pa.int64())]))

    def run(batches):
        hashes, kind, kinds = shared.value
        for batch in batches:
            column = batch.column("minimisers")
            count = np.diff(np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in column])]))
            values = column.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), count)
            at = np.minimum(np.searchsorted(hashes, values), max(0, len(hashes) - 1))
            hit = hashes[at] == values if len(hashes) else np.zeros(len(values), bool)
            patterns = [[] for _ in range(batch.num_rows)]
            code, n = np.unique(owner[hit] * max(1, len(kinds)) + kind[at[hit]], return_counts=True) if hit.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for c, m in zip(code.tolist(), n.tolist()):
                patterns[c // len(kinds)].append({"bins": list(kinds[c % len(kinds)]), "n": m})
            keep = [i for i, name in enumerate(batch.schema.names) if name != "minimisers"]
            columns = [batch.column(i) for i in keep] + [pa.array(count, pa.int64()), pa.array(patterns, out_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in keep] + ["num_hashes", "patterns"])

    return reads.mapInArrow(run, schema)


def hits(reads: DataFrame, index: IndexModel, how: str = "join") -> DataFrame:
    """reads, minus their minimisers, plus num_hashes and patterns; reads without hashes stay."""
    if how == "local":
        return by_broadcast(reads, index)
    return _joined(reads, (by_filter if how == "bloom" else by_join)(reads, index))


def _joined(reads: DataFrame, found: DataFrame) -> DataFrame:
    joined = reads.drop("minimisers").join(found, "read_ord", "left")
    return joined.withColumn("num_hashes", F.coalesce("num_hashes", F.lit(0).cast("long"))).withColumn("patterns", F.coalesce("patterns", F.array().cast(PATTERNS)))
