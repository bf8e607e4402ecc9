"""Queries of classifiers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import evaluation as e
from tabulith.operators import models as m
from tabulith.registry import register, table


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    return m.group_split(rows, "text", 5)


@register("ml1_nbsvm")
def ml1_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML1, AG6: NB-SVM for quality, trained on four fifths of the contents, judged on the rest."""
    rows = _labelled(spark, sf_dir)
    model = m.nbsvm(rows.where("NOT is_valid"))
    return e.class_metrics(model.transform(rows.where("is_valid")).withColumn("prediction", F.col("prediction").cast("int")), "prediction", "label")


@register("ml2_group_split")
def ml2_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML2: how many rows and contents either side of the split has."""
    return _labelled(spark, sf_dir).groupBy("is_valid").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("text").alias("contents"))


@register("ml5_table_types", """SELECT vec_id, CASE WHEN greatest(a, b) < 0.5 THEN 'irrelevant' WHEN a >= b THEN 'leaderboard' ELSE 'ablation' END AS type FROM (SELECT vec_id, abs(embedding[1])::DOUBLE AS a, abs(embedding[2])::DOUBLE AS b FROM embeddings)""")
def ml5_table_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML5, F31: types of tables from class probabilities."""
    p = F.transform(F.slice("embedding", 1, 2), lambda x: F.abs(x).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("paper_id"), F.lit("t").alias("table_name"), p.alias("probabilities"))
    return m.table_types(rows).select(F.col("paper_id").cast("long").alias("vec_id"), "type")


@register("ml6_predicted_tags", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 6 WHEN 0 THEN 'table-meta' WHEN 1 THEN 'dataset' WHEN 2 THEN 'model-paper' WHEN 3 THEN 'model-competing' ELSE 'dataset-metric' END AS predicted_tags FROM lineitem WHERE l_partkey % 6 <> 5""")
def ml6_predicted_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML6: class numbers as tags; the class of no tag is left out."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.struct("l_partkey", "l_suppkey").alias("table_name"), F.col("l_linenumber").alias("row"), F.lit(0).alias("col"), (F.col("l_partkey") % 6).cast("double").alias("prediction"))
    found = m.predicted_tags(lines)
    return found.select(F.col("paper_id").alias("l_orderkey"), F.col("row").alias("l_linenumber"), "table_name.l_partkey", "table_name.l_suppkey", "predicted_tags")


@register("ml10_contributions")
def ml10_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML10: the log-odds of every labelled document beside what its terms add up to."""
    rows = _labelled(spark, sf_dir)
    model = m.nbsvm(rows.where("NOT is_valid"))
    odds = model.transform(rows).select("doc_id", vector_to_array("rawPrediction")[1].alias("log_odds"))
    added = m.contributions(model, rows, "doc_id").groupBy("doc_id").agg(F.sum("contribution").alias("added"))
    own = F.coalesce("added", F.lit(0.0)) + F.lit(float(model.stages[-1].intercept))
    return odds.join(added, "doc_id", "left").select("doc_id", F.round("log_odds", 6).alias("log_odds"), F.round(own, 6).alias("of_terms"))
