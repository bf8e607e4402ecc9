"""The whole way from tagged table cells to leaderboard results, as one plan over all papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.operators import filters
from tabulith.operators import linking as k
from tabulith.operators.tasks import spread
from tabulith.registry import table

#: Linked queries up to which they are broadcast to the proposals.
BROADCAST_LINKS = 100_000


def extract_results(cells: DataFrame, contexts: DataFrame, taxonomy: DataFrame, metric_info: DataFrame, votes: DataFrame | None = None) -> DataFrame:
    """UD8: proposals of all papers with the reason for which each is no result (null: it is one).

    ``cells`` are (paper_id, table_name, row, col, value, tag); ``contexts`` (paper_id,
    table_name, context, text) with contexts 0 to 3 (paper, abstract, mentions, caption);
    the fifth context of a cell is what its row and column say of models and data sets.
    All that a cell is linked by is its texts, so cells of equal texts are one query, in
    whatever table, and only queries are scored. Proposals stay where their paper is.
    """
    keys = ["paper_id", "table_name"]
    proposals = k.cell_proposals(cells, keys).withColumn("cell_ext_id", F.concat_ws("/", "paper_id", "table_name", F.concat_ws(".", "row", "col")))
    words = F.array_join(F.concat(F.transform("dataset_values", lambda v: v["value"]), F.transform("model_values", lambda v: v["value"])), " ")
    said = contexts.where("text IS NOT NULL AND table_name IS NOT NULL").select(*keys, "context", F.sha1("text").alias("text_id"), "text")
    by_table = said.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("context", "text_id"))).alias("heard"))
    by_paper = by_table.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("table_name", "heard"))).alias("by_table"))
    none = F.array().cast(by_table.schema["heard"].dataType)
    told = proposals.withColumn("cell_text", words).join(by_paper.hint("merge"), "paper_id", "left").withColumn("heard", F.coalesce(F.try_element_at("by_table", F.col("table_name")), none)).drop("by_table")
    content = F.concat_ws("\n", F.size("heard").cast("string"), F.transform("heard", lambda h: F.concat(h["context"].cast("string"), F.lit(" "), h["text_id"])), "cell_text")
    told = told.withColumn("query", F.sha1(content))
    # computed once, as many plans read them
    queries = told.select("query", "heard", "cell_text").distinct().localCheckpoint()
    dictionaries = {a: k.evidence_names(taxonomy.select(F.col(a).alias("name")).distinct(), a) for a in k.AXES}
    of_cells = queries.select("query", F.lit(4).alias("context"), F.sha1("cell_text").alias("text_id"))
    # every different text is searched once, however many cells and tables it speaks of
    texts = said.select("text_id", "text").unionByName(queries.select(F.sha1("cell_text").alias("text_id"), F.col("cell_text").alias("text"))).distinct()
    found = k.context_counts(texts, dictionaries)
    heard = queries.select("query", F.inline("heard")).unionByName(of_cells)
    counts = heard.join(found, "text_id").select("query", "context", "axis", "evidence", "n")
    gains = {}
    for axis in k.AXES:
        noise = F.array(*map(F.lit, k.NOISE[axis]))[F.col("context")]
        gains[axis] = k.axis_gains(counts.where(F.col("axis") == axis), k.likelihoods(dictionaries[axis]), noise, k.BACKGROUND[axis], k.REPEATS[axis])
    links = k.link(queries, gains, taxonomy, 1).select("query", *k.AXES, F.col("metric").alias("true_metric"), "confidence").localCheckpoint()
    rows = k.proposal_rows(told, F.broadcast(links) if links.count() <= BROADCAST_LINKS else links, metric_info, "query", "paper_id")
    return filters.production_chain(votes)(rows).drop("paper_id")


def _lines(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    """Lines of orders with their paper: the order's key, after ``prefix`` if there is one."""
    key = F.concat(F.lit(prefix), F.col("l_orderkey").cast("string")) if prefix else F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(key.alias("paper_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def order_tables(spark: SparkSession, sf_dir: str, *names: str, prefix: str = "") -> DataFrame:
    """Every order as a table: data sets above, a model before each of its lines, a percentage and a number in it. All lines of one are in one task."""
    lines = _lines(spark, sf_dir, prefix)
    nth = F.row_number().over(W.partitionBy("paper_id").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = spread(lines, "paper_id").withColumn("nth", nth)
    cell = lambda row, col, value, tag: F.struct(row.alias("row"), F.lit(col).alias("col"), value.alias("value"), F.lit(tag).alias("tag"))
    at, percentage = F.col("nth"), F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("%"))
    body = F.array(cell(at, 0, F.concat(F.lit("Ours "), at.cast("string")), "model-best"), cell(at, 1, percentage, ""), cell(at, 2, F.col("l_partkey").cast("string"), ""))
    if len(names) == 1:
        heads = [F.concat(F.lit(f"{names[0]} {c}"), (F.col("l_orderkey") % 5).cast("string")) for c in (1, 2)]
    else:
        heads = list(map(F.lit, names))
    head = F.array(cell(F.lit(0), 0, F.lit("Model"), ""), *(cell(F.lit(0), c, h, "dataset") for c, h in zip((1, 2), heads)))
    return rows.select("paper_id", F.lit("t").alias("table_name"), F.inline(F.when(at == 1, F.concat(head, body)).otherwise(body)))


TAXONOMY = [("Answering", "Squad", "Fscore"), ("Answering", "Trivia", "Fscore"), ("Parsing", "Treebank", "Bleu")]


def order_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """extract_results() of all orders: their texts name one task and metric for each of the two data sets of their tables."""
    cells = order_tables(spark, sf_dir, "Squad", "Treebank", prefix="p")
    lines = _lines(spark, sf_dir, "p")
    papers = spread(lines.select("paper_id"), "paper_id", like=lines).distinct()
    contexts = papers.select("paper_id", F.lit("t").alias("table_name"), F.lit(3).alias("context"), F.lit("Fscore for answering, bleu for parsing").alias("text"))
    taxonomy = spark.createDataFrame(TAXONOMY, "task string, dataset string, metric string")
    info = spark.createDataFrame([("Fscore", "1-100"), ("Bleu", "")], "metric string, range string")
    return extract_results(cells, contexts, taxonomy, info)


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of all orders: paper, dataset, metric, task, model, score."""
    paper = F.split("cell_ext_id", "/")[0].alias("paper_id")
    return filters.kept(order_proposals(spark, sf_dir)).select(paper, "task", "dataset", "metric", "model", F.col("parsed").alias("score"))
