"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, by their first characters and,
where these are equal, by a hash of the rest: samples stay small, and equal texts never
part. In each range an external sort places equal texts side by side, and a sort-based
aggregation compares each whole text with its neighbour's, closes one run of copies
after the other and hands the run's identifiers on. Nothing else decides what is equal.
A text with very many rows is cut into parts with ranges of their own; the few runs of
such parts are put together by their whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm import common
from tabulith.llm.common import cut, text_of

#: Characters of a text by which it is ranged and sorted first; all of them are compared.
HEAD = 32
#: A text with more rows than 1/HOT_SHARE of all is cut into parts of that many: never less, nor more, than these.
LEAST_PART, MOST_PART = 10_000, 100_000
WHITE = "[\\x20\\x09-\\x0D]+"


def normalise(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(text_of(text), WHITE, "")


def _ranged(rows: DataFrame, text: Column, column: Column, with_norm: bool) -> tuple[DataFrame, bool]:
    """``column`` with head, hash, parts and salt of each row's normalised text (and that text, norm), in ranges of these, and whether any text has parts.

    Equal texts have equal heads and hashes, so a range has all rows of a text, or of one of its parts.
    """
    hashed = rows.select(normalise(text).alias("norm"), F.monotonically_increasing_id().alias("nth"), column).withColumn("hash", F.xxhash64("norm"))
    part = min(max(LEAST_PART, -(-rows.count() // common.HOT_SHARE)), MOST_PART)
    sizes = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part)
    # at most a row for every ``part`` rows of the table
    hot = [(r["hash"], -(-r["n"] // part)) for r in sizes.collect()]
    if hot:
        parts = rows.sparkSession.createDataFrame(hot, "hash long, parts long")
        hashed = hashed.join(F.broadcast(parts), "hash", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    else:
        hashed = hashed.withColumn("parts", F.lit(1).cast("long"))
    names = [c for c in hashed.columns if c not in ("nth", "hash", "parts") and (c != "norm" or with_norm)]
    keyed = hashed.select(*names, F.substring("norm", 1, HEAD).alias("head"), "hash", "parts", F.pmod("nth", "parts").alias("salt"))
    return keyed.repartitionByRange("head", "hash", "salt"), bool(hot)


_RUN = ["head", "hash", "parts", "salt", "norm"]


def _rank(text: Column, doc_id: Column) -> Column:
    """The least stays: most code points of the original text, then the smallest doc_id (a null one comes first)."""
    return F.struct((-F.length(text_of(text))).alias("minus_points"), doc_id.alias("doc_id"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the row that stands for its text.

    Reads ``doc_id`` and ``text``; other columns are ignored, whatever their names.
    Returns doc_id, keep_id, group_size, kept, text_sha256. Null texts are equal to
    empty ones; very long texts are compared whole. Of equal texts the row with the most
    code points stays, then the one with the smallest doc_id (null before all others).
    Rows that repeat both doc_id and text are copies of each other: all are returned,
    exactly one of them can be kept. An empty table gives no rows.
    """
    text = F.col("text")
    ranged, parted = _ranged(docs, text, _rank(text, F.col("doc_id")).alias("rank"), True)
    runs = ranged.groupBy(*_RUN).agg(F.sort_array(F.collect_list("rank")).alias("members"))
    runs = runs.withColumn("sha", F.sha2("norm", 256)).withColumn("first", F.col("members")[0])
    size = F.size("members").cast("long")

    def members(some: DataFrame, keep: Column, group_size: Column, has_first: Column) -> DataFrame:
        each = some.select(keep.alias("keep_id"), group_size.alias("group_size"), has_first.alias("has_first"), "sha", F.posexplode("members").alias("at", "member"))
        kept = F.col("has_first") & (F.col("at") == 0)
        return each.select(F.col("member.doc_id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))

    if not parted:
        return members(runs, F.col("first.doc_id"), size, F.lit(True))
    # once for both branches; of texts only those of runs of parts
    runs = cut(runs.select("parts", "salt", "sha", "members", "first", F.when(F.col("parts") > 1, F.col("norm")).alias("norm")))
    cold = members(runs.where("parts = 1"), F.col("first.doc_id"), size, F.lit(True))
    hot = runs.where("parts > 1")
    whole = hot.groupBy("norm").agg(F.min(F.struct("first", "salt")).alias("best"), F.sum(size).alias("n"))
    return cold.unionByName(members(hot.join(whole, "norm"), F.col("best.first.doc_id"), F.col("n"), F.col("salt") == F.col("best.salt")))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup() keeps, all their columns unchanged: rows go through the sort whole.

    Null doc_ids and texts, ties, repeated rows and empty tables are as in exact_dedup();
    columns may have any names.
    """
    rows = docs.select(F.struct(F.col("*")).alias("row"))
    ranged, parted = _ranged(rows, F.col("row.text"), F.col("row"), False)
    rank = _rank(F.col("row.text"), F.col("row.doc_id"))
    runs = ranged.withColumn("norm", normalise(F.col("row.text"))).groupBy(*_RUN).agg(F.min_by("row", rank).alias("row"))
    if parted:
        hot = runs.where("parts > 1").groupBy("norm").agg(F.min_by("row", rank).alias("row"))
        runs = runs.where("parts = 1").select("row").unionByName(hot.select("row"))
    return runs.select("row.*")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS FIRST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS FIRST) = 1 AS kept
  FROM d
)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM r
"""
