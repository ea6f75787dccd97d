"""The manifest of an index: one line per file, path and category separated by a tab."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readsift.config import MOST_BINS
from readsift.functions.columns import absolute


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """bin, path, category, category_idx: bins in order of lines, categories numbered in order of names.

    Lines with fewer than two fields are passed over, further fields are ignored; more than 255 files, or none, is an
    error. A manifest is small by that bound, so its rows are numbered on the driver.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    fields = lines.withColumn("f", F.split("value", "\t")).where(F.size("f") >= 2).orderBy("line").limit(MOST_BINS + 1)
    return bins_of(spark, [(r["f"][0], r["f"][1]) for r in fields.collect()])


def bins_of(spark: SparkSession, files: list[tuple[str, str]]) -> DataFrame:
    if not files:
        raise ValueError("the manifest names no file")
    if len(files) > MOST_BINS:
        raise ValueError(f"an index has at most {MOST_BINS} files")
    categories = sorted({c for _, c in files})
    rows = [(i, absolute(p), c, categories.index(c)) for i, (p, c) in enumerate(files)]
    return spark.createDataFrame(rows, "bin int, path string, category string, category_idx int")
