"""Minimisers of reads: an Arrow function for use, window functions as the specification."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readsift.functions import kernel, memory

#: Bases that the kernel holds at once: 8 bytes each, several times over. Exact emission steps through all reads together,
#: so that more of them cost less.
BASES = {"distinct": 1 << 18, "exact": 1 << 21}


def _lists(seqs: pa.Array, k: int, w: int, emission: str) -> pa.Array:
    import numpy as np

    parts = []
    for _, reads in memory.runs(seqs, BASES[emission]):
        owner, value = kernel.minimisers(reads, k, w, emission)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(reads)))]).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(value)))
    out = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))
    del parts
    memory.release()
    return out


def minimisers(seq: Column, k: int = 19, w: int = 41, emission: str = "exact") -> Column:
    """Minimiser hashes of a sequence (array of long): with multiplicity in order of emission, or the sorted set.

    Null and short sequences give an empty array. The planner takes it for nondeterministic: the filter on empty arrays that
    it infers from an explode would else compute it again, in one more worker a core.
    """
    return F.arrow_udf(lambda seqs: _lists(seqs, k, w, emission), "array<bigint>").asNondeterministic()(seq)


def paired_minimisers(first: Column, second: Column, k: int = 19, w: int = 41, emission: str = "exact") -> Column:
    """Minimisers of mate 1, then of mate 2; no window spans the two."""
    return F.concat(minimisers(first, k, w, emission), minimisers(second, k, w, emission))


def minimisers_by_windows(reads: DataFrame, key: str, seq: str, k: int = 19, w: int = 41) -> DataFrame:
    """Distinct (key, h) by window functions: digits, k-mer hashes by doubling, and a sliding minimum. For reference."""
    digits = F.translate(F.col(seq), "ACGNT", "01234")
    rows = reads.select(key, F.posexplode(F.filter(F.split(digits, ""), lambda c: c != "")).alias("i", "c")).select(key, "i", F.col("c").cast("long").alias("d"))
    order = Window.partitionBy(key).orderBy("i")
    turned = F.element_at(F.array(*map(F.lit, [4, 2, 1, 3, 0])), (F.col("d") + 1).cast("int")).cast("long")
    f = sum((F.lead("d", j).over(order) * F.lit(5 ** (k - 1 - j)) for j in range(1, k)), F.col("d") * F.lit(5 ** (k - 1)))
    r = sum((F.lead("t", j).over(order) * F.lit(5**j) for j in range(1, k)), F.col("t"))
    seed = F.lit(kernel.SEED - (1 << 64))
    hashed = rows.withColumn("t", turned).withColumn("f", f).withColumn("r", r).where("f is not null")
    hashed = hashed.select(key, "i", F.least(F.col("f").bitwiseXOR(seed), F.col("r").bitwiseXOR(seed)).alias("x"))
    width = w - k + 1
    least = hashed.withColumn("h", F.min("x").over(order.rowsBetween(0, width - 1)))
    least = least.withColumn("n", F.count("*").over(order.rowsBetween(0, width - 1)))
    return least.where((F.col("n") == width) | (F.col("i") == 0)).select(key, "h").distinct()
