"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabulith.llm import bitsearch, bpe, exactdedup, htmltext, linededup, minhash, mixing, pii, tokencount, toxicity
from tabulith.llm.common import table

_OWN_KEY = secrets.token_hex(32)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = bitsearch.sign_codes(table(spark, sf_dir, "embeddings"))
    return bitsearch.search(codes, codes.where("id % 100 = 0"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key comes from the session; where none is set there, it is a random one that no one knows, and lasts as long as this process."""
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("spark.tabulith.pii.key", None) or _OWN_KEY)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk_search, op2_line_dedup, op3_bpe, op4_minhash, op5_mixing, op6_token_counts, op7_exact_dedup, op8_pseudonyms, op9_toxicity, op10_html_text)
}
ORACLE_SQL = {
    "op1_topk_search": bitsearch.ORACLE_SQL,
    "op2_line_dedup": linededup.ORACLE_SQL,
    "op7_exact_dedup": exactdedup.ORACLE_SQL,
}
