"""How many tasks a step has: as many as its input needs, so that what one task holds doesn't grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes, as the files have them, of the columns that one task reads: about 100,000 narrow rows.
TASK_BYTES = 1 << 20
#: Sizes beyond this are no estimates: Spark says so of what it knows nothing about.
UNKNOWN = 1 << 50


def tasks_for(rows: DataFrame, each: int = TASK_BYTES) -> int:
    """How many tasks of ``each`` bytes the rows make, by Spark's own estimate (no job runs); 1 if it has none."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // each) if 0 < size < UNKNOWN else 1


def spread(rows: DataFrame, *keys: str, each: int = TASK_BYTES, like: DataFrame | None = None) -> DataFrame:
    """The rows over as many tasks as they need, those of equal ``keys`` in one; what follows within such keys needs no other shuffle.

    A number that is asked for stays, whatever the session says of partitions and of merging
    small ones. What fits one task is left as it is. With ``like`` there are as many tasks as
    those rows need, so that both sides of a join on the keys are already together.
    """
    n = tasks_for(rows if like is None else like, each)
    return rows if n == 1 else rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), *keys)
