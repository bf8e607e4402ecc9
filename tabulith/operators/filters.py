"""Filters of proposals: each adds the reason for which it rejects a row, and they chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Filter = Callable[[DataFrame], DataFrame]


def _reject(rows: DataFrame, reason: Column) -> DataFrame:
    """Rows still in play get ``reason`` where it isn't null."""
    return rows.withColumn("reason", F.coalesce("reason", reason))


def nothing(rows: DataFrame) -> DataFrame:
    """PF6."""
    return rows


def by_structure(rows: DataFrame) -> DataFrame:
    """PF4: cells of no model, and of development or training sets; the last named reason wins."""
    data = F.col("struct_dataset")
    reason = F.when(data.contains("train"), "train-dataset").when(data.contains("dev"), "dev-dataset").when(F.col("struct_model_type") == "", "empty-model-type")
    return _reject(rows, reason)


def by_confidence(least: float) -> Filter:
    """PF5."""

    def run(rows: DataFrame) -> DataFrame:
        text = F.concat(F.lit("confidence "), F.bround("confidence", 2).cast("string"), F.lit(f" < {least}"))
        return _reject(rows, F.when(F.col("confidence") < least, text))

    return run


def direction(rows: DataFrame, info: DataFrame | None) -> Column:
    """1 where higher is better, else -1, from d_key, d_metric (votes) or the metric's name."""
    name = F.lower("metric")
    votes = F.coalesce(*([F.col("d_key"), F.col("d_metric")] if info is not None else []), F.when(name.contains("error"), -1).when(name.contains("accuracy"), 1).otherwise(0))
    return F.when(votes >= 0, 1).otherwise(-1)


def with_directions(rows: DataFrame, info: DataFrame | None) -> DataFrame:
    """``rows`` with direction; ``info`` is (task, dataset, metric, votes), rows with null task and dataset for a metric alone."""
    if info is None:
        return rows.withColumn("direction", direction(rows, None))
    by_key = info.where("task IS NOT NULL").select("task", "dataset", "metric", F.col("votes").alias("d_key"))
    by_metric = info.where("task IS NULL").select("metric", F.col("votes").alias("d_metric"))
    joined = rows.join(by_key, ["task", "dataset", "metric"], "left").join(by_metric, "metric", "left")
    return joined.withColumn("direction", direction(rows, info)).select(*rows.columns, "direction")


def by_best_result(info: DataFrame | None = None, context: str = "paper") -> Filter:
    """Of a paper's (or table's) own results on a leaderboard only the best stays, the first of equals.

    Rows that have their paper_id need not move if those of a paper are together.
    """

    def run(rows: DataFrame) -> DataFrame:
        parts = F.split("cell_ext_id", "/")
        own = "paper_id" in rows.columns
        place = (F.col("paper_id") if own else parts[0]) if context == "paper" else F.concat_ws("/", parts[0], parts[1])
        marked = with_directions(rows, info).withColumn("_open", F.col("reason").isNull())
        marked = marked.withColumn("_runs", F.col("_open") & (F.col("model_type") == "model-best") & F.col("parsed").isNotNull() & ~F.isnan("parsed"))
        # rows that take no part get a group of their own, so that they don't gather in one task
        lone = F.when(~F.col("_runs"), F.col("cell_ext_id"))
        order = W.partitionBy(place, "task", "dataset", "metric", lone).orderBy((F.col("direction") * F.col("parsed")).desc(), "cell_ext_id")
        best = marked.withColumn("_best", F.first("cell_ext_id").over(order))
        lost = F.concat(F.lit("replaced by "), F.col("_best"))
        reason = (
            F.when(F.col("_runs") & (F.col("_best") == F.col("cell_ext_id")), None)
            .when(F.col("struct_model_type") == "model-competing", "model-competing")
            .when(F.col("_runs"), lost)
            .otherwise("")
        )
        return _reject(best, reason).select(*rows.columns)

    return run


def chain(*filters: Filter) -> Filter:
    """PF7: each filter sees what the ones before it left; a row's reason is that of the first that rejects it."""

    def run(rows: DataFrame) -> DataFrame:
        if "reason" not in rows.columns:
            rows = rows.withColumn("reason", F.lit(None).cast("string"))
        for f in filters:
            rows = f(rows)
        return rows

    return run


def kept(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NULL").drop("reason")


def production_chain(info: DataFrame | None = None) -> Filter:
    """Structure, confidence 0.8, best result of the paper, confidence 0.85."""
    return chain(by_structure, by_confidence(0.8), by_best_result(info, "paper"), by_confidence(0.85))


def first_k(rows: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of every group."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= k).drop("_nth")


def threshold_intervals(proposals: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """The thresholds between which a proposal is what its leaderboard keeps.

    max_threshold is its confidence; min_threshold the best confidence of a strictly
    better result of the same paper and leaderboard, else that of the first equal one
    before it, else 0. Ignored proposals get the empty interval (1, 0).
    """
    data = F.col("struct_dataset")
    ignored = (F.col("model_type") != "model-best") | (F.col("struct_model_type") == "") | data.contains("dev") | data.contains("train")
    value = F.col("direction") * F.col("parsed")
    rows = with_directions(proposals, info).withColumn("_ignored", ignored).withColumn("_value", value)
    lone = F.when(F.col("_ignored") | F.col("parsed").isNull(), F.col("cell_ext_id"))
    rows = rows.withColumn("_paper", F.split("cell_ext_id", "/")[0]).withColumn("_lone", lone)
    # everything before a value in falling order, its equals left out: the frame of strictly better ones
    frame = "PARTITION BY task, dataset, metric, _paper, _lone ORDER BY _value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-12D PRECEDING"
    upto = F.expr(f"max(confidence) OVER ({frame})")
    equal_first = F.first(F.struct("cell_ext_id", "confidence")).over(W.partitionBy("task", "dataset", "metric", "_paper", "_lone", "_value").orderBy("cell_ext_id"))
    found = rows.withColumn("_better", upto).withColumn("_first", equal_first)
    equal = F.when(F.col("_first.cell_ext_id") != F.col("cell_ext_id"), F.col("_first.confidence"))
    low = F.when(F.col("_ignored"), 1.0).when(F.col("parsed").isNull(), 0.0).otherwise(F.coalesce("_better", equal, F.lit(0.0)))
    return found.withColumn("min_threshold", low).withColumn("max_threshold", F.when(F.col("_ignored"), 0.0).otherwise(F.col("confidence"))).select(*proposals.columns, "min_threshold", "max_threshold")
