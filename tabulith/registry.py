"""The registry of queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators.tasks import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query, and its SQL where SQL can express it."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of orders whose papers one task makes: about 50,000 papers.
PAPER_BYTES = 1 << 18


def order_papers(spark: SparkSession, sf_dir: str, text: str, name: str = "html") -> DataFrame:
    """Every order as a paper (paper_id, ``name``): ``text`` with the customer's key in place of @.

    A file of orders is small and a paper takes long, so orders are spread before they become papers.
    """
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", each=PAPER_BYTES)
    return orders.select(F.col("o_orderkey").alias("paper_id"), F.replace(F.lit(text), F.lit("@"), F.col("o_custkey").cast("string")).alias(name))
