"""Seams for services outside the engine: a document converter, a citation parser, a GraphQL source.

Each takes a picklable function that does the outside work for one value; the engine
spreads the calls over partitions, keeps failures as a status, and never stops a job for
one bad record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_each(rows: DataFrame, key: str, value: str, call: Callable[[str], str | None], tries: int = 3) -> DataFrame:
    """(key, status, result): ``call`` of every different value once, tried again when it raises.

    Equal values are asked once and joined back, which is what a cache would do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for asked in batch["_value"]:
                status, result = "processing-error", None
                for _ in range(tries):
                    try:
                        result = call(asked)
                        status = "success" if result is not None else "empty"
                        break
                    except Exception:  # noqa: BLE001 - whatever an outside service throws is a status
                        continue
                out.append((asked, status, result))
            yield pd.DataFrame(out, columns=["_value", "status", "result"])

    different = rows.select(F.col(value).alias("_value")).where("_value IS NOT NULL").distinct()
    answers = different.mapInPandas(run, "_value string, status string, result string")
    return rows.select(key, F.col(value).alias("_value")).join(answers, "_value", "left").select(key, F.coalesce("status", F.lit("empty")).alias("status"), "result")


def convert_papers(sources: DataFrame, convert: Callable[[str], str | None]) -> DataFrame:
    """TX17: (paper_id, source) to (paper_id, status, html) by a converter of LaTeX; tests pass a mock."""
    return call_each(sources, "paper_id", "source", convert).withColumnRenamed("result", "html")


def parse_citations(references: DataFrame, parse: Callable[[str], str | None]) -> DataFrame:
    """RF1, RF5: (ref_id, ref_str) to (ref_id, status, tei) by a citation service, in one batch over all partitions."""
    return call_each(references, "ref_id", "ref_str", parse).withColumnRenamed("result", "tei")


def graphql(papers: DataFrame, query: Callable[[str], str | None]) -> DataFrame:
    """SC5: (arxiv_id) to (arxiv_id, status, json) by a live GraphQL endpoint."""
    return call_each(papers, "arxiv_id", "arxiv_id", query).withColumnRenamed("result", "json")
