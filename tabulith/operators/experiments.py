"""Experiments: settings, grids of them, and their results as tables."""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Experiment:
    """The settings of one run of a cell classifier."""

    name: str = "nbsvm"
    n_grams: int = 1
    tf_idf: bool = True
    merge_type: str = "concat"
    evidence_limit: int | None = None
    mask: bool = False
    distinguish_model_source: bool = True
    seed: int = 42

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def new(self, **settings: Any) -> Experiment:
        """ML8: the same with some settings changed."""
        return replace(self, **settings)


def experiments_grid(base: Experiment, **settings: list) -> list[Experiment]:
    """ML9: one experiment for every combination of settings."""
    return [base.new(**dict(zip(settings, values))) for values in itertools.product(*settings.values())]


def grid(spark: SparkSession, **settings: list) -> DataFrame:
    """ML9 as rows; the lists are settings of a program, so they are small."""
    return spark.createDataFrame(list(itertools.product(*settings.values())), list(settings)).select(
        *[F.col(k).cast("int") if isinstance(v[0], int) and not isinstance(v[0], bool) else F.col(k) for k, v in settings.items()])


def save_experiments(spark: SparkSession, runs: list[tuple[Experiment, dict[str, float]]], path: str) -> None:
    """SK7: settings and results appended as JSON lines; the next free number is the name of a run's row."""
    rows = [(e.to_json(), {k: float(v) for k, v in r.items()}) for e, r in runs]
    spark.createDataFrame(rows, "settings string, results map<string,double>").write.mode("append").json(path)


def load_experiments(spark: SparkSession, path: str) -> DataFrame:
    """SC14, AG21: all runs with defaults for settings that older ones lack."""
    rows = spark.read.schema("settings string, results map<string,double>").json(path)
    fields = "name string, n_grams int, tf_idf boolean, merge_type string, evidence_limit int, mask boolean, distinguish_model_source boolean, seed int"
    parsed = rows.select(F.from_json("settings", fields).alias("s"), "results")
    defaults = asdict(Experiment())
    columns = [F.coalesce(F.col(f"s.{k}"), F.lit(v)).alias(k) if v is not None else F.col(f"s.{k}").alias(k) for k, v in defaults.items()]
    return parsed.select(*columns, "results")
