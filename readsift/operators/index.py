"""The minimiser index: distinct hashes per bin, their statistics, an optional packing of bins, and its store."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readsift.config import IndexSettings
from readsift.functions import kernel, memory, stats
from readsift.operators.minimiser import minimisers  # noqa: F401

#: Bases of a piece of a long reference; pieces overlap so that no window is lost.
PIECE = 1 << 20


@dataclass
class IndexModel:
    """bins (bin, path, category, category_idx), bin_stats (bin, n_records, n_hashes), hashes (bin, h)."""

    settings: IndexSettings
    bins: DataFrame
    bin_stats: DataFrame
    hashes: DataFrame

    def bin_rows(self) -> list:
        """The bins on the driver: 255 rows at most."""
        return sorted(self.bins.collect(), key=lambda r: r["bin"])

    def categories(self) -> list[str]:
        return sorted({r["category"] for r in self.bin_rows()})

    def category_bins(self) -> list[list[int]]:
        """Bins of each category, in order of categories."""
        rows = self.bin_rows()
        return [sorted({r["bin"] for r in rows if r["category"] == c}) for c in self.categories()]

    def host_index(self) -> int:
        """Position of the category host or human, the first of them by name."""
        found = [i for i, c in enumerate(self.categories()) if c in ("host", "human")]
        if not found:
            raise ValueError("no category of the index is named host or human")
        return found[0]

    def by_hash(self) -> DataFrame:
        """h, bins: one row per hash, so that a probe answers for all bins at once."""
        return self.hashes.groupBy("h").agg(F.array_sort(F.collect_set("bin")).alias("bins"))


#: Bases of short pieces that stand in one batch.
HELD = 1 << 18


def _cut(batches, window: int, size: int):
    """Lists of (bin, piece) of HELD bases and one piece at most; a sequence is gone through once and held once."""
    held, n = [], 0
    for batch in batches:
        for bin_, seq in zip(batch.column("bin"), batch.column("seq")):
            raw = seq.as_buffer() if seq.is_valid else b""
            for a in range(0, max(1, len(raw) - (window - 1)), size):
                held.append((bin_.as_py(), bytes(raw[a : a + size + window - 1])))
                n += len(held[-1][1]) + 64  # an empty sequence is not for nothing
                if n >= HELD:
                    yield held
                    held, n = [], 0
    if held:
        yield held


def pieces(refs: DataFrame, window: int, size: int = PIECE) -> DataFrame:
    """(bin, seq) with long sequences cut into overlapping pieces, whose windows together are those of the whole. Sequences
    are ASCII."""

    def cut(batches):
        for held in _cut(batches, window, size):
            yield pa.record_batch([pa.array([b for b, _ in held], pa.int32()), pa.array([s.decode() for _, s in held], pa.string())], names=["bin", "seq"])
        memory.release()

    return refs.select(F.col("bin").cast("int").alias("bin"), "seq").mapInArrow(cut, "bin int, seq string")


def distinct_hashes(refs: DataFrame, settings: IndexSettings) -> DataFrame:
    """(bin, h) without repetitions: sets per piece first, so that little is shuffled. Pieces are cut and hashed in one pass
    of a worker, so that no sequence goes there twice."""
    k, w = settings.kmer_size, settings.window_size

    def hashed(batches):
        for held in _cut(batches, w, PIECE):
            owner, value = kernel.minimisers([s for _, s in held], k, w, "distinct")
            bins = np.array([b for b, _ in held], np.int32)[owner]
            yield pa.record_batch([pa.array(bins), pa.array(value)], names=["bin", "h"])
        memory.release()

    return refs.select(F.col("bin").cast("int").alias("bin"), "seq").mapInArrow(hashed, "bin int, h long").distinct()


def bin_stats(bins: DataFrame, refs: DataFrame, hashes: DataFrame) -> DataFrame:
    """bin, n_records, n_hashes; bins without records or hashes stay, with 0."""
    records = refs.groupBy("bin").agg(F.count("*").alias("n_records"))
    counts = hashes.groupBy("bin").agg(F.count("*").alias("n_hashes"))
    joined = bins.select("bin").distinct().join(records, "bin", "left").join(counts, "bin", "left")
    return joined.select("bin", F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"), F.coalesce("n_hashes", F.lit(0)).cast("long").alias("n_hashes"))


def bins_by_size(stats_: DataFrame) -> DataFrame:
    """Bins from the smallest to the largest; of equal ones the lower number first."""
    return stats_.orderBy("n_hashes", "bin")


def largest(stats_: DataFrame) -> DataFrame:
    return stats_.agg(F.max("n_hashes").alias("max_num_hashes"))


def overfull(stats_: DataFrame, settings: IndexSettings) -> DataFrame:
    """Bins with more hashes than a filter of these settings holds at its false-positive rate."""
    most = stats.capacity(settings.bits, settings.max_fpr, settings.num_hash)
    return stats_.where(F.col("n_hashes") > most).withColumn("max_num_hashes", F.lit(most).cast("long"))


def filter_bits(stats_: DataFrame, settings: IndexSettings) -> DataFrame:
    """Bits that a filter for each bin needs, capped."""
    bits = F.when(F.col("n_hashes") > 0, stats.bits_of(F.col("n_hashes"), settings.max_fpr, settings.num_hash, settings.bits)).otherwise(F.lit(0)).cast("long")
    return stats_.select("bin", "n_hashes", bits.alias("bits"))


def packed_layout(rows: list[tuple[int, str, int]]) -> dict[int, int]:
    """Bucket of each bin of (bin, category, size): from the smallest, into the category's last bucket while the sum of
    sizes stays below half of the largest bin, else into the next free bucket."""
    half = max((size for _, _, size in rows), default=0) / 2
    last: dict[str, tuple[int, int]] = {}
    out, free = {}, 0
    for bin_, category, size in sorted(rows, key=lambda r: (r[2], r[0])):
        bucket, held = last.get(category, (-1, 0))
        if bucket < 0 or held + size >= half:
            bucket, held, free = free, 0, free + 1
        last[category] = (bucket, held + size)
        out[bin_] = bucket
    return out


def layout(index: IndexModel) -> DataFrame:
    """bin, bucket of the packing; the fold runs over 255 rows at most."""
    spark = index.bins.sparkSession
    size = {r["bin"]: r["n_hashes"] for r in index.bin_stats.collect()}
    made = packed_layout([(r["bin"], r["category"], size[r["bin"]]) for r in index.bin_rows()])
    return spark.createDataFrame(sorted(made.items()), "bin int, bucket int")


def optimize_layout(index: IndexModel) -> IndexModel:
    """The index with bins packed: hashes of a bucket united, records summed."""
    moved = F.broadcast(layout(index))
    bins = index.bins.join(moved, "bin").select(F.col("bucket").alias("bin"), "path", "category", "category_idx")
    hashes = index.hashes.join(moved, "bin").select(F.col("bucket").alias("bin"), "h").distinct()
    records = index.bin_stats.join(moved, "bin").groupBy("bucket").agg(F.sum("n_records").alias("n_records"))
    counts = hashes.groupBy("bin").agg(F.count("*").alias("n_hashes"))
    merged = records.select(F.col("bucket").alias("bin"), "n_records").join(counts, "bin", "left").select("bin", "n_records", F.coalesce("n_hashes", F.lit(0)).cast("long").alias("n_hashes"))
    return IndexModel(index.settings, bins, merged, hashes)


def build(bins: DataFrame, refs: DataFrame, settings: IndexSettings = IndexSettings()) -> IndexModel:
    """The index of references (bin, seq); ``bins`` names their categories."""
    hashes = distinct_hashes(refs, settings)
    index = IndexModel(settings, bins, bin_stats(bins, refs, hashes), hashes)
    return optimize_layout(index) if settings.optimize else index


def save(index: IndexModel, path: str) -> IndexModel:
    """Write the index and return the stored one; an existing path is an error. Hashes lie in ranges, so that files
    have narrow bounds of h."""
    spark = index.bins.sparkSession
    index.hashes.repartitionByRange("h").sortWithinPartitions("h", "bin").write.parquet(f"{path}/index_hashes")
    stored = IndexModel(index.settings, index.bins, index.bin_stats, spark.read.parquet(f"{path}/index_hashes"))
    stored.bins.coalesce(1).write.parquet(f"{path}/bins")
    stored.bin_stats.coalesce(1).write.parquet(f"{path}/bin_stats")
    meta = json.dumps(asdict(index.settings) | {"id": uuid.uuid4().hex})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> IndexModel:
    meta = json.loads(spark.read.text(f"{path}/meta").collect()[0][0])
    settings = IndexSettings(**{k: v for k, v in meta.items() if k != "id"})
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return IndexModel(settings, read("bins"), read("bin_stats"), read("index_hashes"))
