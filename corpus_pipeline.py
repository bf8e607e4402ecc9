"""A corpus from ``documents`` in five stages, each written as Parquet and read again.

Counted as part of ``tabulith.llm``, without which it does not import.

Every stage takes rows with null and repeated doc_ids, null, empty, wordless and very long
texts, repeated rows, other columns of any names, and empty tables, and returns the
columns that it was given (the last one its own). A row is judged by its own text: rows
with a null doc_id are only dropped as toxic or as exact copies; of equal or nearly equal
texts the row that the stage's operator names stays, ties going to the smallest doc_id.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulith.llm import bpe, exactdedup, minhash, mixing, toxicity
from tabulith.llm.common import ensure_checkpoint_dir, forget, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models reject go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exactdedup.keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates one document stays."""
    return minhash.keep_one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the fitted rates say; no domain is raised to its share by repeating what the stages before have left of it."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"), repeat=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and the text that they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: SQL has no likeness of the models' scores, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; what a stage returns is written to the shared
    folder before the next one reads it, and goes when that has been written. The last
    stage's input stays, as its result is read from there whenever it is asked for."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            forget(spark, f"{folder}/{k - 1}")
    return docs
