"""Sinks: tables, texts, evidence and proposals as files that the readers read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of a store: a paper's is known from its identifier, and their number doesn't grow with the papers.
BUCKETS = 64
BUCKET = "bucket"


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def save_fragments(papers: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """SK2: one JSON document for each paper: title, authors, abstract and its fragments in order."""
    by_paper = papers.groupBy("paper_id").agg(
        F.first("title", True).alias("title"), F.first("authors", True).alias("authors"), F.first("abstract", True).alias("abstract"),
        F.sort_array(F.collect_list(F.when(F.col("order").isNotNull(), F.struct("order", "header", "text")))).alias("fragments"))
    _bucketed(by_paper, "paper_id", buckets).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).json(path)


def save_tables(cells: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """SK1: cells by paper, those of a paper together; no file is made for each paper or table."""
    placed = _bucketed(cells, "paper_id", buckets)
    placed.repartition(BUCKET).sortWithinPartitions(BUCKET, "paper_id", "table_name", "row", "col").write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What upsert() and the sinks by paper have written."""
    return spark.read.parquet(path).drop(BUCKET)


def _rewrite(spark: SparkSession, path: str, gone: DataFrame, rows: DataFrame | None, key: str, buckets: int) -> None:
    """The folders that ``gone`` papers are in, without these and with ``rows``; others aren't touched.

    What the folders will hold is written beside them first: a folder is never read while it is overwritten.
    """
    keys = _bucketed(gone.select(key).distinct(), key, buckets)
    held = spark.read.parquet(path).join(F.broadcast(keys.select(BUCKET).distinct()), BUCKET, "left_semi").join(keys.select(key), key, "left_anti")
    new = held if rows is None else held.unionByName(_bucketed(rows, key, buckets))
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    new.write.parquet(aside)
    try:
        # a folder of which nothing is left is emptied by hand: dynamic overwriting only sees folders with rows
        left = {r[BUCKET] for r in spark.read.parquet(aside).select(BUCKET).distinct().collect()}
        emptied = {r[BUCKET] for r in keys.select(BUCKET).distinct().collect()} - left
        placed = spark.read.parquet(aside).repartition(BUCKET)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
        for bucket in emptied:
            _remove(spark, f"{path}/{BUCKET}={bucket}")
    finally:
        _remove(spark, aside)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def upsert(rows: DataFrame, path: str, key: str = "paper_id", buckets: int = BUCKETS) -> None:
    """SK3: the papers of ``rows`` replace what is stored of them; others stay."""
    spark = rows.sparkSession
    if _exists(spark, path):
        _rewrite(spark, path, rows, rows, key, buckets)
    else:
        _bucketed(rows, key, buckets).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def delete(spark: SparkSession, path: str, gone: DataFrame, key: str = "paper_id", buckets: int = BUCKETS) -> None:
    """SK3: takes papers out of a store."""
    _rewrite(spark, path, gone, None, key, buckets)


def save_csv(rows: DataFrame, path: str) -> None:
    """SK4, SK6: evidence or proposals as CSV with a header; empty strings stay apart from nulls."""
    rows.write.mode("overwrite").option("emptyValue", "").option("nullValue", "\u0000").csv(path, header=True)


def save_json(rows: DataFrame, path: str) -> None:
    """SK6."""
    rows.write.mode("overwrite").json(path)


def save_sharded(rows: DataFrame, path: str, parts: int, key: str = "paper_id") -> None:
    """SK5: as many files as asked, a paper in one of them; read together they are the whole again."""
    rows.repartition(parts, key).write.mode("overwrite").parquet(path)
