"""Bags, softmax and alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str], n: str) -> DataFrame:
    """SE3: counts of ``left`` less those of ``right``, what is left above 0."""
    other = right.groupBy(*keys).agg(F.sum(n).alias("_other"))
    joined = left.join(other, keys, "left").withColumn(n, F.col(n) - F.coalesce("_other", F.lit(0)))
    return joined.where(F.col(n) > 0).select(*keys, n)


def bag_sum(bags: list[DataFrame], keys: list[str], n: str) -> DataFrame:
    """SE4."""
    return reduce(DataFrame.unionByName, bags).groupBy(*keys).agg(F.sum(n).alias(n))


def softmax(rows: DataFrame, keys: list[str], log_p: str, out: str) -> DataFrame:
    """exp(x - max) over their sum in every group."""
    group = W.partitionBy(*keys)
    shifted = rows.withColumn("_e", F.exp(F.col(log_p) - F.max(log_p).over(group)))
    return shifted.withColumn(out, F.col("_e") / F.sum("_e").over(group)).drop("_e")


def align(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """PF15: the first rows of every group, as many as the largest multiple of ``size``."""
    group = W.partitionBy(*keys)
    numbered = rows.withColumn("_nth", F.row_number().over(group.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(group))
    return numbered.where(F.col("_nth") <= F.col("_n") - F.col("_n") % size).drop("_nth", "_n")
