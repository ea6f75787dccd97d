"""Outputs: assignment rows, their text form, extracted reads and the summary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assignments(called: DataFrame, categories: list[str]) -> DataFrame:
    """status, read_id, call, length, num_hashes, mean_quality, confidence, compression, details by category."""
    names = F.array(*map(F.lit, categories))
    zipped = F.arrays_zip(names.alias("category"), F.col("counts"), F.col("props"), F.col("unique_props"), F.col("probabilities"))
    details = F.transform(zipped, lambda z: F.struct(z["category"].alias("category"), z["counts"].alias("count"), z["props"].alias("prop"), z["unique_props"].alias("unique_prop"), z["probabilities"].alias("probability")))
    status = F.when(F.col("call").isNull(), "U").otherwise("C")
    return called.select("read_ord", status.alias("status"), F.col("id").alias("read_id"), "call", "length", "num_hashes", "mean_quality", "confidence", "compression", details.alias("details"))


def short(x: Column) -> Column:
    """A number with six significant digits at most: no trailing zeros, an exponent below -4 and
    from 6 on.

    It is the exact binary value that is rounded, halves to the even digit. SQL rounds the shortest decimal of a value, which
    may be a half where the value is none, so batches pass through Arrow.
    """
    return F.arrow_udf(_short, "array<string>")(F.array(x))[0]


def _short(lists: pa.Array) -> pa.Array:
    said = pa.array([None if v is None else "%.6g" % v for v in lists.flatten().to_pylist()], pa.string())
    return pa.ListArray.from_arrays(pa.array(_offsets(lists)), said)


def _offsets(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)


def assignment_text(rows: DataFrame) -> DataFrame:
    """The rows as lines of tab-separated text, numbers with six significant digits."""
    numbers = F.concat(F.array("mean_quality", F.coalesce("compression", F.lit(0.0))), F.flatten(F.transform("details", lambda d: F.array(d["prop"], d["unique_prop"], d["probability"]))))
    rows = rows.withColumn("__said", F.arrow_udf(_short, "array<string>").asNondeterministic()(numbers))  # all of a line in one pass
    at = lambda i, j: F.get("__said", 3 * i + j)
    said = F.transform("details", lambda d, i: F.concat(F.concat_ws(":", d["category"], d["count"], at(i, 2), at(i, 3), at(i, 4)), F.lit(" ")))
    line = F.concat_ws("\t", "status", "read_id", F.coalesce("call", F.lit("")), "length", "num_hashes", F.get("__said", F.lit(0)), "confidence", F.get("__said", F.lit(1)), F.array_join(said, ""))
    return rows.select(line.alias("value"))


def write_assignments(rows: DataFrame, path: str) -> None:
    assignment_text(rows).write.text(path)


def extract_paths(wanted: str, categories: list[str], prefix: str, extension: str, paired: bool = False) -> dict[str, list[str]]:
    """Files of the categories to extract: one name, or "all" for each; an unknown name is an error."""
    if wanted != "all" and wanted not in categories:
        raise ValueError(f"no category {wanted} in the index")
    ends = ["_1", "_2"] if paired else [""]
    return {c: [f"{prefix}_{c}{end}{extension}.gz" for end in ends] for c in (categories if wanted == "all" else [wanted])}


def extract(called: DataFrame, reads: DataFrame, category: str) -> DataFrame:
    """The original reads of those called for a category."""
    mine = called.where(F.col("call") == category).select("read_ord")
    return reads.join(mine, "read_ord", "left_semi")


def write_reads(reads: DataFrame, path: str, seq: str = "seq", qual: str = "qual") -> None:
    """Reads as FASTQ where they have qualities, else FASTA, in order of read_ord, gzip-compressed.

    The folder's parts, in order of their names, are the file; mates written by two calls stay parallel.
    """
    header = F.coalesce("header", "id") if "header" in reads.columns else F.col("id")
    record = F.when(F.col(qual).isNotNull(), F.concat_ws("\n", F.concat(F.lit("@"), header), seq, F.lit("+"), qual)).otherwise(F.concat_ws("\n", F.concat(F.lit(">"), header), seq))
    reads.orderBy("read_ord").select(record.alias("value")).write.option("compression", "gzip").text(path)
