"""Paper archives: unpacking, and which file is the paper."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_AUX = (
    "appendix|supplement(?:ary|al)\\s+materials?|author\\s+guidelines|rebuttal\\s+|ieeetran\\.cls"
    "|formatting\\s+instructions|instructions\\s+(?:.*proceedings|for\\s+\\\\confname)"
)


def guess_main(files: DataFrame) -> DataFrame:
    """TX16: of (dir, name, content) the most likely main file of every folder, with its priority.

    ms.tex wins; a document class counts 10, a title after it 5 more; a title of an
    annex gives 5 in all. Equals go by their lower-cased name.
    """
    content = F.coalesce("content", F.lit(""))
    # everything after the line of the document class, null if there is none
    body = F.nullif(F.regexp_extract(content, "(?ms)^\\s*\\\\documentclass[^\\n]*\\n?(.*)\\z", 0), F.lit(""))
    after = F.coalesce(F.regexp_extract(content, "(?ms)^\\s*\\\\documentclass[^\\n]*\\n(.*)\\z", 1), F.lit(""))
    searched = F.when(body.isNotNull(), after).otherwise(F.lit(""))
    has_title = searched.rlike("(?m)^\\s*\\\\(icml)?title\\s*\\{")
    title = F.lower(F.trim(F.regexp_extract(searched, "(?m)^\\s*\\\\(icml)?title\\s*\\{([^%}]*)", 2)))
    priority = (
        F.when(F.lower("name") == "ms.tex", 30)
        .when(has_title & title.rlike(_AUX), 5)
        .otherwise(F.when(body.isNotNull(), 10).otherwise(0) + F.when(has_title, 5).otherwise(0))
    )
    stem = F.lower(F.regexp_replace("name", "\\.tex$", ""))
    ranked = files.where(F.col("name").endswith(".tex")).withColumn("priority", priority.cast("long"))
    nth = F.row_number().over(W.partitionBy("dir").orderBy(F.desc("priority"), stem, "name"))
    return ranked.withColumn("_nth", nth).where("_nth = 1").select("dir", "name", "priority")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """SC16: e-print archives as files: paper_id, status (success, withdrawn, no-tex, processing-error), name, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return unpack(files.select(paper_id(F.regexp_extract("path", "([^/]+)$", 1)).alias("paper_id"), F.col("content").alias("archive")))


def paper_id(name):
    """TX18: the identifier that a file name begins with; the whole name if there is none."""
    found = F.regexp_extract(name, "^(\\d{4}\\.\\d+(v\\d+)?)(\\..*)?$", 1)
    return F.when(found != "", found).otherwise(name)


def unpack(archives: DataFrame) -> DataFrame:
    """(paper_id, archive) to a row for each .tex file; archives without one give a row with their status."""

    def members(data: bytes) -> tuple[str, list[tuple[str, bytes]]]:
        if data[:4] == b"%PDF":
            return "withdrawn" if len(data) < 100 else "no-tex", []
        try:
            if data[:2] == b"\x1f\x8b":
                data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            return "processing-error", []
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as tar:
                found = [(m.name.split("/")[-1], tar.extractfile(m).read()) for m in tar if m.isfile() and m.name.endswith(".tex")]
            return ("success" if found else "no-tex"), found
        except tarfile.TarError:
            pass
        if not data.strip() or data.lstrip().startswith(b"%auto-ignore"):
            return "withdrawn", []
        return ("success", [("main.tex", data)]) if b"\\" in data else ("no-tex", [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for paper, data in zip(batch["paper_id"], batch["archive"]):
                status, found = members(bytes(data or b""))
                rows += [(paper, status, n, c.decode("utf-8", "ignore")) for n, c in found] or [(paper, status, None, None)]
            yield pd.DataFrame(rows, columns=["paper_id", "status", "name", "content"])

    return archives.select("paper_id", "archive").mapInPandas(run, "paper_id string, status string, name string, content string")
