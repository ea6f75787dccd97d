"""Count-min sketches and bitmaps of 64-bit keys, built by partition, merged by block, of a size that does not exceed a bound.

A partition sends, for each row of the sketch and each block of places, the places it has counted. Blocks are merged
where the shuffle brings them together; what remains is one bit per place, set where the count has reached a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readsift.llm.rolling import scramble

#: Places of a row: as many as keys are expected, times SPARE, but no more than MOST (16 MB of bits a row).
LEAST_BITS, MOST_BITS, SPARE = 16, 27, 4
BLOCKS_BITS = 6
#: Values that one merge of all blocks takes; above it partitions are merged in groups first.
KEYS_A_MERGE = 1 << 32
_SALTS = np.random.default_rng(7).integers(0, 1 << 63, 8, dtype=np.uint64)


def width_bits(expected: int) -> int:
    return int(np.clip(int(np.ceil(np.log2(max(1, expected) * SPARE))), LEAST_BITS, MOST_BITS))


def places(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return scramble(keys ^ _SALTS[row]) >> np.uint64(64 - bits)


@dataclass
class Repeated:
    """Bits of the places whose count has reached the threshold, by row."""

    bits: int
    rows: list[np.ndarray]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Whether the estimate of each key reaches the threshold; never false for a key that does."""
        found = np.ones(len(keys), bool)
        for row, held in enumerate(self.rows):
            at = places(keys, row, self.bits)
            found &= (held[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0
        return found


def build(keyed: DataFrame, column: str, expected: int, depth: int, threshold: int) -> Repeated:
    """The sketch of all values (arrays of long) in ``column`` of ``keyed``, each array counted once per value it holds.

    ``expected`` is about how many values there are; it sets the width and the number of first merges. A block is merged as
    its parts stream by, in one byte a place, and beyond KEYS_A_MERGE values first by groups of partitions, so that no task
    holds or reads what grows with the input. What comes to the driver is ``depth * 2**bits`` bits, 48 MB at most with
    three rows.
    """
    import zstandard

    bits = width_bits(expected)
    block_bits = bits - BLOCKS_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            keys = np.concatenate(pending)
            rows, blocks, bodies = [], [], []
            for row in range(depth):
                at = np.sort(places(keys, row, bits))
                most = np.ones(len(at), bool)  # a place more often than the threshold says no more
                most[threshold:] = at[threshold:] != at[:-threshold]
                at = at[most]
                cuts = np.searchsorted(at, np.arange((1 << BLOCKS_BITS) + 1, dtype=np.uint64) << np.uint64(block_bits))
                for block in np.flatnonzero(np.diff(cuts)).tolist():
                    inner = (at[cuts[block] : cuts[block + 1]] & np.uint64((1 << block_bits) - 1)).astype("<u4")
                    rows.append(row)
                    blocks.append(block)
                    bodies.append(zstandard.ZstdCompressor(level=1).compress(np.diff(inner, prepend=np.uint32(0)).astype("<u4").tobytes()))
            return pa.record_batch([pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(bodies, pa.binary())], names=["row", "block", "body"])

        for batch in batches:
            keys = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            pending.append(keys)
            held += len(keys)
            if held >= 1 << 21:
                yield out()
                pending.clear()
                held = 0
        if held:
            yield out()

    def of_places(count: np.ndarray, raw: bytes) -> None:
        at, n = np.unique(np.cumsum(np.frombuffer(raw, "<u4"), dtype=np.int64), return_counts=True)
        count[at] = np.minimum(threshold, count[at] + np.minimum(threshold, n))

    def of_planes(count: np.ndarray, raw: bytes) -> None:
        planes = np.frombuffer(raw, np.uint8).reshape(threshold, -1)
        count[:] = np.minimum(threshold, count + np.unpackbits(planes, axis=1).sum(axis=0, dtype=np.uint8))

    def merge(add, first_plane: int):
        """A group's counts as packed planes, of which plane c has the places counted c + 1 times or more."""

        def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = np.zeros(1 << block_bits, np.uint8)
            for batch in batches:
                for body in batch.column("body"):
                    add(count, zstandard.ZstdDecompressor().decompress(body.as_py()))
            planes = b"".join(np.packbits(count >= c).tobytes() for c in range(first_plane, threshold + 1))
            ids = [pa.array([k.as_py()], pa.int32()) for k in key[:2]]
            yield pa.record_batch([*ids, pa.array([zstandard.ZstdCompressor(level=1).compress(planes)], pa.binary())], names=["row", "block", "body"])

        return merged

    schema = "row int, block int, body binary"
    parts = keyed.select(column).mapInArrow(counted, schema)
    merges = 1 + expected // KEYS_A_MERGE
    if merges > 1:
        by_task = parts.withColumn("part", F.spark_partition_id() % merges)
        parts = by_task.groupBy("row", "block", "part").applyInArrow(merge(of_places, 1), schema)
    last = parts.groupBy("row", "block").applyInArrow(merge(of_planes if merges > 1 else of_places, threshold), schema)
    rows = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(depth)]
    step = 1 << (block_bits - 3)
    for part in last.collect():  # no more bytes than the sketch has, whatever the input
        rows[part["row"]][part["block"] * step : (part["block"] + 1) * step] = np.frombuffer(zstandard.ZstdDecompressor().decompress(part["body"]), np.uint8)
    return Repeated(bits, rows)
