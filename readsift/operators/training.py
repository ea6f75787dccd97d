"""Samples for the models: which reads speak for or against a category, and the first N of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(scored: DataFrame, threshold: float = 0.15) -> DataFrame:
    """read_ord, category_idx, side (pos or neg), value, from unique proportions.

    A read whose highest value is the only highest, and the only one above the threshold, is positive for that category
    and negative for the others; a read with none above is negative for all but the highest, if that is the only one.
    Negative values are kept only above 0. Reads without hashes take no part.
    """
    up = F.col("unique_props")
    rows = scored.where("num_hashes > 0").select("read_ord", up, F.array_max(up).alias("top"), F.size(F.filter(up, lambda x: x > threshold)).alias("above"))
    tied = F.size(F.filter("unique_props", lambda x: x == F.col("top"))) > 1
    rows = rows.withColumn("pos", F.when((F.col("top") > 0) & ~tied, F.array_position("unique_props", F.col("top")).cast("int") - 1).otherwise(-1))
    positive = (F.col("pos") >= 0) & (F.col("above") == 1)
    each = rows.where(positive | (F.col("above") == 0)).select("read_ord", "pos", positive.alias("positive"), F.posexplode("unique_props").alias("category_idx", "value"))
    mine = F.col("category_idx") == F.col("pos")
    kept = each.where((mine & F.col("positive")) | (~mine & (F.col("value") > 0)))
    return kept.select("read_ord", "category_idx", F.when(mine, "pos").otherwise("neg").alias("side"), "value")


def first_n(found: DataFrame, n: int) -> DataFrame:
    """The first n rows of each category and side, by read_ord. The limit is applied before the shuffle as well."""
    order = Window.partitionBy("category_idx", "side").orderBy("read_ord")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")
