"""Queries of the document parser: sections, fragments, pages, tables in pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.operators import cells as cell_ops
from tabulith.operators import lookups
from tabulith.operators.tasks import spread
from tabulith.registry import order_papers, register, table
from tabulith.sources import html as h

#: Counted words up to which they are broadcast.
BROADCAST_WORDS = 100_000
FIXTURE = (
    '<figure class="ltx_table" id="S4.T1"><figcaption class="ltx_caption">Table 1: Results.</figcaption><table class="ltx_tabular"><tr class="ltx_tr">'
    '<td class="ltx_td ltx_align_left ltx_border_tt">Model</td><td class="ltx_td ltx_border_tt" colspan="2">SQuAD</td></tr><tr class="ltx_tr">'
    '<td class="ltx_td">Ours <a href="#bib.bib7">7</a></td><td class="ltx_td ltx_font_bold">93.1%</td><td class="ltx_td">1,234</td></tr></table></figure>'
)
SECTIONS = (
    '<article><h1>T</h1><section id="S1"><h2>Intro</h2><div class="ltx_para">A</div><div class="ltx_para">B <a href="#S4.T1">1</a></div></section>'
    '<section id="S2"><h2>Empty</h2></section></article>'
)


@register("w5_sections", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT *, sum(CASE WHEN length(line) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, count(*) AS lines, string_agg(line, ' ' ORDER BY pos) AS text FROM s GROUP BY doc_id, section""")
def w5_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, TX7: short lines are headers; a running sum of them numbers the sections."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    section = F.sum(F.when(F.length("line") < 60, 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("pos"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "line")))
    return lines.withColumn("section", section).groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(ordered, lambda x: x["line"]), " ").alias("text"))


@register("tx13_page_fragments")
def tx13_page_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX1 to TX7, TX13: title and fragments of every page."""
    return h.fragments(table(spark, sf_dir, "pages"), "page_id")


@register("tx13_titles", """SELECT page_id, count(*) AS n FROM pages GROUP BY page_id""")
def tx13_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with an article gives at least one fragment; pages without sections exactly one."""
    return h.fragments(table(spark, sf_dir, "pages"), "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@register("tx13_sections", "SELECT o_orderkey AS paper_id, \"order\", header, replace(text, '@', o_custkey::VARCHAR) AS text FROM orders, (VALUES (1000, 'xxanchor-S1 Intro', 'A @'), (1001, 'xxanchor-S1 Intro', 'B xxref-S4T1'), (2000, 'xxanchor-S2 Empty', '')) AS g(\"order\", header, text)")
def tx13_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of papers of two sections, one for each order."""
    return h.fragments(order_papers(spark, sf_dir, SECTIONS.replace(">A<", ">A @<"))).select("paper_id", "order", "header", "text")


@register("tx14_toc", "SELECT o_orderkey AS paper_id, \"order\", replace(header, '@', o_custkey::VARCHAR) AS header FROM orders, (VALUES (1000, 'xxanchor-S1 Intro @'), (2000, 'xxanchor-S2 Empty')) AS g(\"order\", header)")
def tx14_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX14: a header at each change."""
    return h.table_of_contents(h.fragments(order_papers(spark, sf_dir, SECTIONS.replace("Intro", "Intro @")))).select("paper_id", "order", "header")


@register("tx15_fragment_frame", "SELECT doc_id, string_split(text, chr(10))[1] AS header, length(text) AS n FROM documents")
def tx15_fragment_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX15: header (the first line), text and length of fragments."""
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n")[0].alias("header"), F.length("text").cast("long").alias("n"))


_CORPUS = """WITH f AS (SELECT source, doc_id, lang, coalesce(text, '') AS text, lag(lang) OVER (PARTITION BY source ORDER BY doc_id) AS last FROM documents),
t AS (SELECT source, 'Title' || chr(10) || source || chr(10) || chr(10) || 'Abstract' || chr(10) || 'of ' || max(lang) || chr(10) || chr(10) || 'Body' || chr(10)
  || string_agg(CASE WHEN last IS NULL OR last <> lang THEN lang || chr(10) || chr(10) || text ELSE text END, chr(10) ORDER BY doc_id) AS text FROM f GROUP BY source)"""


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = docs.select(F.col("source").alias("paper_id"), F.col("doc_id").alias("order"), F.col("lang").alias("header"), "text")
    papers = docs.groupBy(F.col("source").alias("paper_id")).agg(F.first("source").alias("title"), F.concat(F.lit("of "), F.max("lang")).alias("abstract"))
    return h.corpus_texts(papers, parts)


@register("tx19_corpus", f"{_CORPUS} SELECT source AS paper_id, sha256(regexp_replace(regexp_replace(text, 'xxanchor-[^ ]*', '', 'g'), 'xxref-[^ ]*', 'xxref', 'g')) AS text FROM t")
def tx19_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX19: every source as a paper: its text for a language model."""
    return _corpus(spark, sf_dir).select("paper_id", F.sha2("text", 256).alias("text"))


@register("tx19_sentences", f"{_CORPUS} SELECT source AS paper_id, count(*) AS n FROM (SELECT source, unnest(string_split(text, chr(10))) AS s FROM t) WHERE trim(s) <> '' GROUP BY 1")
def tx19_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX19: the sentences of such a corpus."""
    return h.corpus_sentences(_corpus(spark, sf_dir)).groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))


@register("tb1_html_tables", """SELECT o_orderkey AS paper_id, "row", col, replace(raw_value, '@', o_custkey::VARCHAR) AS raw_value, replace(value, '@', o_custkey::VARCHAR) AS value, refs, layout FROM orders,
(VALUES (0,0,'Model','Model','','border-tt align-left'),(0,1,'Set@','Set@','','border-tt span-cb'),(0,2,'Set@','Set@','','border-tt span-ce'),
(1,0,'Ours <ref id=''bib-bib7''>7</ref>','Ours 7','bibbib7',''),(1,1,'<bold>@%</bold>','@%','',''),(1,2,'1,234','1,234','','')) AS g("row", col, raw_value, value, refs, layout)""")
def tb1_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB1 to TB20: the cells of a table with a span, a reference and a style, one for each order."""
    built = cell_ops.build(h.cells(order_papers(spark, sf_dir, FIXTURE.replace("SQuAD", "Set@").replace("93.1%", "@%"))), ["paper_id"])
    return built.select("paper_id", "row", "col", "raw_value", "value", F.array_join("refs", ",").alias("refs"), "layout")


@register("tb1_pages", "SELECT page_id, 0::BIGINT AS cells FROM pages")
def tb1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table cells of every page of the corpus (they hold none)."""
    pages = table(spark, sf_dir, "pages")
    found = h.cells(pages, "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("cells"))
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("cells", F.lit(0)).alias("cells"))


@register("sc9_page_links", "SELECT page_id, len(regexp_extract_all(html, '<a '))::BIGINT AS links FROM pages")
def sc9_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.page_links(table(spark, sf_dir, "pages"))


@register("j9_mention_join", """WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\b(th[a-z]+)\\b', 1)) AS ref FROM documents)
SELECT l_orderkey AS table_id, count(*) AS mentions FROM (SELECT DISTINCT l_orderkey, CASE l_linenumber WHEN 1 THEN 'the' WHEN 2 THEN 'that' WHEN 3 THEN 'this' ELSE 'none' END AS ref FROM lineitem) JOIN m USING (ref) GROUP BY l_orderkey""")
def j9_mention_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that mention a table, by an equi-join on the mention."""
    mentions = lookups.mentions(table(spark, sf_dir, "documents"), "\\b(th[a-z]+)\\b", "doc_id")
    line = F.col("l_linenumber")
    ref = F.when(line == 1, "the").when(line == 2, "that").when(line == 3, "this").otherwise("none")
    tables = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", ref.alias("ref")), "l_orderkey").distinct()
    # as many rows as there are words of that kind; computed once, so that their number is known
    counted = mentions.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).localCheckpoint()
    return tables.join(F.broadcast(counted) if counted.count() <= BROADCAST_WORDS else counted, "ref").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.sum("n").alias("mentions"))


@register("j11_section_lookup", """SELECT b.item_id, count(*) AS sections FROM (SELECT item_id, string_split(text, ' ')[1] AS ref FROM benchmark) b JOIN documents d ON list_contains(string_split_regex(d.text, '\\s+'), b.ref) GROUP BY b.item_id""")
def j11_section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fragments hold a table's reference (the first word of an item) as a word."""
    refs = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ")[0].alias("ref"))
    found = h.sections_with(refs, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frag_id"), "text"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("sections"))
