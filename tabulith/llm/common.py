"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups that hold at least one row in so many are "hot"; there can be no more
#: hot groups than this, which is what makes a table of them safe to broadcast.
HOT_SHARE = 1000
#: Bytes of rows that a Python worker is given at once.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder for checkpoints; one of this machine only where all executors are on it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tabulith-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder, its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` computed once and written as a table in the shared folder, and that folder's path, for forget()."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Removes a folder through the file system that it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def quoted(name: str) -> Column:
    """The column of that name, whatever signs are in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(stem: str) -> str:
    """A column name that no table has."""
    return f"_{stem}_{uuid.uuid4().hex}"


def give_back() -> None:
    """Hands memory that this process has freed back to the machine; else idle Python workers keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which has no such function
        pass


Batches = Iterator[pa.RecordBatch]


def map_arrow(df: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    """mapInArrow over batches of about BATCH_BYTES, so that long texts can't fill a worker, which gives its free memory back at the end."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            give_back()

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(limit).rstrip("b") == str(64 << 20):  # Spark's own default: no one has set it
        df.sparkSession.conf.set(limit, str(BATCH_BYTES))
    return df.mapInArrow(whole, schema)


def strings(column: pa.Array, at_once: int = 200) -> Iterator[str]:
    """The texts of an Arrow column one by one, nulls as empty; few of them exist at a time."""
    for start in range(0, len(column), at_once):
        for text in column.slice(start, at_once).to_pylist():
            yield text or ""


def text_of(column: str | Column = "text") -> Column:
    """A text column, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, row_id: Column) -> DataFrame:
    """``rows`` inner-joined to ``groups`` on ``key``, where one group may own a third of the rows.

    ``groups`` has one row per key and the number of its rows in ``size``. Groups with at
    least 1/HOT_SHARE of all rows are at most HOT_SHARE, so they are broadcast; rows that
    found theirs there take no part in the shuffled join (their join key becomes a unique
    one). ``row_id`` is any expression that spreads the rows.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(1, -(-total // HOT_SHARE))
    values = [c for c in groups.columns if c != key]
    is_hot = F.col(size) >= F.lit(least)
    hot = groups.where(is_hot).select(F.col(key), F.struct(*values).alias("_hot"))
    cold = groups.where(~is_hot).select(F.col(key).alias("_key"), F.lit(False).alias("_gone"), F.struct(*values).alias("_cold"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("_found", F.col("_hot").isNotNull())
    elsewhere = F.xxhash64(row_id)
    if rows.schema[key].dataType == T.BinaryType():
        elsewhere = F.unhex(F.hex(elsewhere))
    spread = marked.withColumn("_key", F.when(F.col("_found"), elsewhere.cast(rows.schema[key].dataType)).otherwise(F.col(key)))
    joined = spread.withColumn("_gone", F.col("_found")).join(cold, ["_key", "_gone"], "left")
    both = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.where(both.isNotNull()).select(*rows.columns, *[both[v].alias(v) for v in values])
