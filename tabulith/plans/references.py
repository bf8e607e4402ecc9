"""Queries of bibliographies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions import text as t
from tabulith.operators import references as r
from tabulith.operators.tasks import spread
from tabulith.registry import register, table

#: Bytes of parts whose records one task reads.
RECORD_BYTES = 1 << 15
_PARTS = [(1, "Intro", "a"), (2, "xxanchor-bib X", "old"), (3, "Appendix", "b"), (4, "xxanchor-bib R", "xxanchor-bib1 A. Title one @. "), (5, "xxanchor-bib R", "xxanchor-bib xxanchor-bib2 B. Title @"), (6, "Notes", "n")]


def _bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(n).alias("order"), F.lit(header).alias("header"), F.lit(text).alias("part")) for n, header, text in _PARTS])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_custkey", F.inline(parts))
    return r.bibliography(rows.select("paper_id", "order", "header", F.replace("part", F.lit("@"), F.col("o_custkey").cast("string")).alias("text")))


@register("w8_bibliography", "SELECT o_orderkey AS paper_id, nth, replace(text, '@', o_custkey::VARCHAR) AS text FROM orders, (VALUES (0, 'xxanchor-bib xxanchor-bib2 B. Title @'), (1, 'xxanchor-bib1 A. Title one @. ')) AS g(nth, text)")
def w8_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bibliographies of orders as papers of six fragments."""
    return _bibliography(spark, sf_dir)


@register("f20_refs", "SELECT o_orderkey AS paper_id, nth, ref_id, replace(ref_str, '@', o_custkey::VARCHAR) AS ref_str FROM orders, (VALUES (0, 'bib2', 'B. Title @'), (1, 'bib1', 'A. Title one @.')) AS g(nth, ref_id, ref_str)")
def f20_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.reference_lines(_bibliography(spark, sf_dir))


@register("rf3_merge_refs", """WITH k AS (SELECT array_to_string(string_split_regex(lower(regexp_replace(p_type, '[^a-zA-Z0-9 ]', ' ', 'g')), ' +'), '-') AS uid, * FROM part)
SELECT uid, arg_max(p_type, p_partkey) AS title, arg_max(p_brand, p_partkey) AS authors, list_sort(list_distinct(list(p_brand))) AS orig_refs FROM k GROUP BY uid""")
def rf3_merge_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RF3: parts as references of the same title."""
    part = table(spark, sf_dir, "part")
    title = F.regexp_replace("p_type", "[^a-zA-Z0-9 ]", " ")
    rows = part.select(F.col("p_partkey").alias("seen"), title.alias("title"), F.col("p_brand").alias("authors"), F.lit(None).cast("string").alias("idno"), F.lit(None).cast("string").alias("arxiv_id"), F.col("p_brand").alias("orig_ref"))
    return r.merge_references(rows).select("uid", "title", "authors", "orig_refs")


@register("rf4_lookup", "SELECT 'J. Doe. ' || p_type || '. ' || p_partkey AS ref_str, lower(replace(p_type, ' ', '-')) AS uid FROM part WHERE p_size > 5")
def rf4_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RF4: types of parts as known titles, looked up in reference strings of parts; small parts quote none."""
    part = table(spark, sf_dir, "part")
    known = part.select(r.reference_id(F.col("p_type")).alias("uid")).distinct()
    title = F.when(F.col("p_size") > 5, F.col("p_type")).otherwise("nothing known")
    return r.lookup(part.select(F.concat(F.lit("J. Doe. "), title, F.lit(". "), F.col("p_partkey").cast("string")).alias("ref_str")), known)


@register("rf2_tei", """SELECT p_partkey AS ref_id, p_type AS title, [p_brand, 'Doe'] AS surnames, (1990 + p_size)::VARCHAR AS date, CASE WHEN p_size % 2 = 0 THEN '1602.' || p_partkey END AS arxiv_id FROM part""")
def rf2_tei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RF2: parts as citations in TEI, read by XPath; half of them have no identifier."""
    number = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<idno type="arXiv">1602.'), F.col("p_partkey").cast("string"), F.lit("</idno>"))).otherwise("")
    tei = F.concat(
        F.lit('<biblStruct><analytic><title level="a">'), "p_type", F.lit("</title><author><persName><surname>"), "p_brand",
        F.lit("</surname></persName></author><author><persName><forename>A</forename><surname>Doe</surname></persName></author>"), number,
        F.lit('</analytic><monogr><imprint><date when="'), (F.col("p_size") + 1990).cast("string"), F.lit('"/></imprint></monogr></biblStruct>'))
    # a file of parts is small, and a record takes long
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size"), "p_partkey", each=RECORD_BYTES)
    return r.parse_tei(part.select(F.col("p_partkey").alias("ref_id"), tei.alias("tei")))


@register("f16_shortened", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'J. ' || o_orderpriority || '.   , 2016' ELSE 'https://arxiv.org/abs:1701.' || (10000 + o_orderkey % 90000) END AS ref FROM orders""")
def f16_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: references without an identifier that words lead to; addresses stay whole."""
    number = (F.col("o_orderkey") % 90000 + 10000).cast("string")
    cited = F.concat(F.lit("J. "), "o_orderpriority", F.lit(". arXiv:1602."), number, F.lit("v1, 2016"))
    s = F.when(F.col("o_orderkey") % 2 == 0, cited).otherwise(F.concat(F.lit("https://arxiv.org/abs:1701."), number))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.regexp_replace(t.without_arxiv_id(s), "\\. +, ", ".   , ").alias("ref"))


@register("f18_artefacts", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN p || '  b' WHEN 1 THEN ' ' || p ELSE '[1] ' || p || ' paper' END AS value FROM (SELECT o_orderkey, lower(o_orderstatus) || 'x' AS p FROM orders)""")
def f18_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what typesetting and venues leave in references."""
    p = F.concat(F.lower("o_orderstatus"), F.lit("x"))
    kind = F.col("o_orderkey") % 3
    value = F.when(kind == 0, t.strip_latex_artefacts(F.concat(p, F.lit(" \\BBA b")))).when(kind == 1, F.concat(F.lit(" "), t.strip_conferences(F.concat(F.lit("NIPS 2014. "), p))))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), value.otherwise(t.strip_anchor(F.concat(F.lit("[AB12] "), p, F.lit(" paper")))).alias("value"))
