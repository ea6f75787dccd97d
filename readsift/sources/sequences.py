"""Reads of FASTA and FASTQ files, plain or compressed (the codec follows the extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readsift.functions.columns import normalise, read_id

FASTA = (".fa", ".fasta", ".fna", ".ffn", ".fas")
FASTQ = (".fq", ".fastq")


def _bare(path: str) -> str:
    for end in (".gz", ".bz2"):
        path = path.removesuffix(end)
    return path.lower()


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """path, read_ord, id, header, seq, qual (null). Records are split at ">" by the line reader, so a plain file is
    read in parallel; read_ord rises with a record's place in its file."""
    raw = spark.read.option("lineSep", "\n>").text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("read_ord"), "value")
    body = F.regexp_replace("value", r"^\s*>", "")
    rows = raw.select("path", "read_ord", F.regexp_extract(body, r"^([^\r\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s", "").alias("bases"))
    rows = rows.where("header <> '' or bases <> ''")
    return rows.select("path", "read_ord", read_id(F.col("header")).alias("id"), "header", normalise(F.col("bases")).alias("seq"), F.lit(None).cast("string").alias("qual"))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line (from 0 in its file), value.

    A line's number in its split comes from the reader's running id; what the splits before it hold is a running sum over
    one row a split. A plain file stays splittable; a compressed one is a single split by nature.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(splits, ["path", "split"]).select("path", (F.col("id") + F.col("shift")).alias("line"), "value")


def read_fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """path, read_ord, id, header, seq, qual of four-line records; read_ord is the record's number in its file. Raises
    where a record is not one."""
    lines = numbered_lines(spark, *paths).where("trim(value) <> '' or line % 4 in (1, 3)")
    records = lines.groupBy("path", F.floor(F.col("line") / 4).alias("read_ord")).agg(*(F.max(F.when(F.col("line") % 4 == i, F.col("value"))).alias(n) for i, n in enumerate(["header", "seq", "plus", "qual"])))
    sound = F.col("header").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    checked = records.where(F.col("header").isNotNull()).where(F.when(sound, True).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("header", F.lit("?")))).cast("boolean")))
    out = checked.select("path", "read_ord", F.substring("header", 2, 1 << 30).alias("header"), normalise(F.col("seq")).alias("seq"), "qual")
    return out.select("path", "read_ord", read_id(F.col("header")).alias("id"), "header", "seq", "qual")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """FASTA or FASTQ by extension."""
    bare = _bare(path)
    if bare.endswith(FASTQ):
        return read_fastq(spark, path)
    if bare.endswith(FASTA):
        return read_fasta(spark, path)
    raise ValueError(f"neither FASTA nor FASTQ by its extension: {path}")


def pair(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by ordinal: read_ord, id, seq1, qual1, seq2, qual2. Unequal numbers of reads, or ids that differ in more
    than the last character, raise an error."""
    a = first.select("read_ord", F.col("id").alias("id1"), F.col("seq").alias("seq1"), F.col("qual").alias("qual1"))
    b = second.select("read_ord", F.col("id").alias("id2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    both = a.join(b, "read_ord", "full_outer")
    cut = lambda c: F.expr(f"left({c}, length({c}) - 1)")
    sound = F.coalesce(cut("id1") == cut("id2"), F.lit(False))
    said = F.concat(F.lit("mates do not match: "), F.coalesce("id1", F.lit("none")), F.lit(", "), F.coalesce("id2", F.lit("none")))
    checked = both.where(F.when(sound, True).otherwise(F.raise_error(said).cast("boolean")))
    return checked.select("read_ord", F.col("id1").alias("id"), "seq1", "qual1", "seq2", "qual2")
