"""Votes: predictions and probabilities of a group combined to one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(rows: DataFrame, group: str, prediction: str, extra: list[str] | None = None) -> DataFrame:
    """AG8: group, vote: the most frequent prediction, the smallest of equals. ``extra`` columns go with the group."""
    keys = [group, *(extra or [])]
    counts = rows.groupBy(*keys, prediction).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.max_by(prediction, F.struct("_n", -F.col(prediction))).alias("vote"))


def by_probabilities(rows: DataFrame, group: str, probabilities: str, how: Callable[[Column], Column]) -> DataFrame:
    """AG9 (F.sum) and AG10 (F.max): group, vote: the class whose probabilities combine to most, the first of equals."""
    each = rows.select(group, F.posexplode(probabilities).alias("_class", "_p"))
    combined = each.groupBy(group, "_class").agg(F.round(how(F.col("_p")), 9).alias("_p"))
    return combined.groupBy(group).agg(F.max_by("_class", F.struct("_p", -F.col("_class"))).cast("long").alias("vote"))


def directions(rows: DataFrame) -> DataFrame:
    """AG14: of (metric, d, range, pos): metric, the sum of d, and the most frequent range (the last seen of equals)."""
    per_range = rows.groupBy("metric", "range").agg(F.count(F.lit(1)).alias("_n"), F.max("pos").alias("_last"), F.sum("d").alias("_d"))
    return per_range.groupBy("metric").agg(F.sum("_d").alias("votes"), F.max_by("range", F.struct("_n", "_last")).alias("range"))
