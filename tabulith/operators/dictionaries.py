"""Dictionaries that come with the engine: what people write for data sets and metrics, and metrics that say the opposite of each other."""

from __future__ import annotations

from itertools import product
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.text import norm_dataset

_DATA = Path(__file__).resolve().parent.parent / "data"
#: Pairs of metrics of which one is the complement of the other, by their general names; those of the first k follow the same pattern.
_OPPOSITES = [("accuracy", "Error"), ("error", "Accuracy"), ("acc", "Err"), ("err", "Acc"), ("classification accuracy", "Classification Error"), ("classification error", "Classification Accuracy")]
_ONE_WAY = {"Accuracy": ("percentage error", "error rate"), "Word Accuracy": ("word error rate", "word error rate (wer)")}


def manual_evidence(spark: SparkSession, axis: str) -> DataFrame:
    """(name, evidence) of an axis: 'dataset' and 'metric' have a dictionary (a line for each evidence, with its names), tasks have none."""
    path = _DATA / f"{axis}_evidence.tsv"
    rows = []
    if path.exists():
        for line in path.read_text(encoding="utf-8").splitlines():
            evidence, names = line.split("\t")
            rows += [(name, evidence) for name in names.split("|")]
    return spark.createDataFrame(rows, "name string, evidence string")


def complements(spark: SparkSession) -> DataFrame:
    """(metric, complement): metrics in lower case and what one minus them is called."""
    rows = [*_OPPOSITES, *((metric, whole) for whole, metrics in _ONE_WAY.items() for metric in metrics)]
    for glue, k in product("- ", (1, 3, 5)):
        top = f"Top{glue}{k}"
        rows += [(f"{top} accuracy".lower(), f"{top} Error Rate"), (f"{top} error rate".lower(), f"{top} Accuracy"), (f"{top} error".lower(), f"{top} Accuracy")]
    return spark.createDataFrame(rows, "metric string, complement string")


def known_datasets(spark: SparkSession, taxonomy: DataFrame | None = None) -> DataFrame:
    """(name, key) of data sets that are known, with their normal forms: those of the dictionary and of a taxonomy."""
    names = manual_evidence(spark, "dataset").select("name")
    if taxonomy is not None:
        names = names.union(taxonomy.select("dataset"))
    return names.distinct().withColumn("key", norm_dataset(F.col("name")))
