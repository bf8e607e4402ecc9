"""Queries of sources and sinks: what is written is read again and compared."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith import schemas
from tabulith.operators.tasks import TASK_BYTES, spread, tasks_for
from tabulith.registry import register, table
from tabulith.sources import archives, readers, sinks


def _folder(spark: SparkSession) -> str:
    """A new folder where all executors can write: beside the checkpoints; one of this machine only where all executors are on it."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base}/tabulith-{uuid.uuid4().hex}"


def _as_files(rows: DataFrame, path: str, parts: int) -> None:
    """Text files, each the ``line``s of one of ``parts`` parts as a JSON array; lines go to the file one by one."""
    at = W.partitionBy("part").orderBy("part")
    first, last = F.row_number().over(at) == 1, F.lead("line").over(at).isNull()
    parted = rows.select(F.pmod(F.xxhash64("line"), F.lit(parts)).alias("part"), "line").repartition(parts, "part")
    whole = parted.select("part", F.concat(F.when(first, "[").otherwise(""), "line", F.when(last, "]").otherwise(",")).alias("value"))
    whole.write.partitionBy("part").text(path)


def _local(files: dict[str, str | bytes]) -> str:
    """Small files for a reader, in a local folder (these queries are about formats, not about size)."""
    root = Path(tempfile.mkdtemp(prefix="tabulith-"))
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


@register("sc1_csv_cells", """WITH o AS (SELECT o_orderkey % 8 AS t, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey)::INTEGER - 1 AS row, o_orderkey, o_orderpriority, o_orderstatus FROM orders)
SELECT 't=' || t AS file, row, unnest([0, 1, 2]) AS col, unnest([o_orderkey::VARCHAR, o_orderpriority || ', "' || o_orderstatus || '"' || chr(10) || 'x', CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END]) AS value FROM o""")
def sc1_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1: orders as eight CSV files, with commas, quotes, line ends and nothing in fields, and their cells."""
    odd = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"\nx'))
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).alias("t"), "o_orderkey", odd.alias("odd"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("last"))
    path = _folder(spark)
    rows.repartition("t").sortWithinPartitions("t", "o_orderkey").write.partitionBy("t").option("escape", '"').option("emptyValue", "").csv(path)
    return readers.read_csv_cells(spark, path).select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("file"), "row", "col", "value")


@register("sc2_papers_csv", """SELECT o_orderkey::VARCHAR AS arxiv_id, o_custkey::BIGINT AS archive_size, md5(o_orderkey::VARCHAR) AS sha256, o_orderpriority || ', "x"' AS title, o_orderstatus AS status,
(o_orderkey % 5)::INTEGER AS sections, (o_custkey % 7)::INTEGER AS tables FROM orders""")
def sc2_papers_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2: orders as a list of papers."""
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("arxiv_id"), F.col("o_custkey").alias("archive_size"), F.md5(key).alias("sha256"), F.concat("o_orderpriority", F.lit(', "x"')).alias("title"),
        F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 5).alias("sections"), (F.col("o_custkey") % 7).alias("tables"))
    path = _folder(spark)
    rows.write.csv(path, header=True)
    return readers.read_papers_csv(spark, path)


@register("sc3_annotations", """SELECT l_orderkey::VARCHAR AS arxiv_id, (l_linenumber % 2)::INTEGER AS table_index, 't' || l_returnflag AS task, 'd' || l_linestatus AS dataset, 'm' AS metric, l_quantity::BIGINT::VARCHAR AS value,
l_partkey::VARCHAR AS model, l_linenumber::INTEGER AS row, (l_suppkey % 3)::INTEGER AS "column" FROM lineitem""")
def sc3_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3: lines of orders as records of annotated tables; an order without lines has no record."""
    text = lambda c: F.col(c).cast("string")
    record = F.struct(
        F.concat(F.lit("t"), "l_returnflag").alias("task"), F.concat(F.lit("d"), "l_linestatus").alias("dataset"), F.lit("m").alias("metric"), F.col("l_quantity").cast("long").cast("string").alias("value"),
        text("l_partkey").alias("model"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 3).alias("column"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    by_table = spread(lines, "l_orderkey").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("index")).agg(F.collect_list(record).alias("records"))
    papers = by_table.groupBy("l_orderkey").agg(F.collect_list(F.struct("index", F.lit(True).alias("leaderboard"), "records")).alias("tables"))
    lone = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_name").alias("arxiv_id"), F.array().cast(papers.schema["tables"].dataType).alias("tables"))
    path = _folder(spark)
    _as_files(papers.select(text("l_orderkey").alias("arxiv_id"), "tables").unionByName(lone).select(F.to_json(F.struct("arxiv_id", "tables")).alias("line")), path, max(8, tasks_for(lines, TASK_BYTES // 4)))
    return readers.annotation_records(readers.read_annotations(spark, path))


@register("sc4_graphql_dump", """WITH p AS (SELECT c_custkey // 2 AS k, c_custkey % 2 + 1 AS v, (c_custkey % 3)::BIGINT AS tables FROM customer), x AS (SELECT k::VARCHAR || 'v' || v AS arxiv_id, k, v, tables FROM p)
SELECT arxiv_id AS key, arxiv_id, tables FROM x UNION ALL SELECT k::VARCHAR, max_by(arxiv_id, v), max_by(tables, v) FROM x GROUP BY k""")
def sc4_graphql_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4, SC6: customers as papers of two versions in compressed dumps, under their exact and their version-less keys."""
    customer = table(spark, sf_dir, "customer")
    name = F.format_string("%dv%d", F.floor(F.col("c_custkey") / 2), F.col("c_custkey") % 2 + 1)
    one = F.struct(F.struct(F.col("c_name").alias("name")).alias("node"))
    edges = F.slice(F.array_repeat(one, 3), F.lit(1), (F.col("c_custkey") % 3).cast("int"))
    nodes = customer.select(F.struct(F.struct(name.alias("arxivId"), F.lit("g").alias("goldTags"), F.struct(edges.alias("edges")).alias("tableSet")).alias("node")).alias("e"), (F.col("c_custkey") % 4).alias("part"))
    dumps = nodes.groupBy("part").agg(F.to_json(F.struct(F.struct(F.struct(F.collect_list("e").alias("edges")).alias("allPapers")).alias("data"))).alias("value"))
    path = _folder(spark)
    dumps.repartition("part").write.partitionBy("part").option("compression", "gzip").text(path)
    return readers.annotations_by_key(readers.read_graphql_dump(spark, path)).select("key", "arxiv_id", F.size("tables").cast("long").alias("tables"))


@register("sc7_texts", """SELECT 'paper=' || source AS paper_id, max(lang) AS title, count(*) AS fragments, sha256(string_agg(coalesce(text, ''), '|' ORDER BY doc_id)) AS texts FROM documents GROUP BY source""")
def sc7_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7: the documents of every source as one paper's text.json."""
    fragment = F.struct(F.col("source").alias("paper_id"), F.col("doc_id").cast("int").alias("order"), F.lit("h").alias("header"), F.coalesce("text", F.lit("")).alias("text"))
    papers = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("lang").alias("title"), F.collect_list(fragment).alias("fragments"))
    path = _folder(spark)
    papers.select(F.col("source").alias("paper"), F.to_json(F.struct("title", "fragments")).alias("value")).repartition("paper").write.partitionBy("paper").text(path)
    ordered = F.transform(F.array_sort(F.transform("fragments", lambda f: F.struct(f["order"].alias("o"), f["text"].alias("t")))), lambda f: f["t"])
    read = readers.read_texts(spark, path, "*.txt")
    return read.select("paper_id", "title", F.size("fragments").cast("long").alias("fragments"), F.sha2(F.array_join(ordered, "|"), 256).alias("texts"))


@register("sc8_tables", "SELECT * FROM (VALUES ('1602.1', 'table_01', 'C', 0, 0, 'x', 'border-t'), ('1602.1', 'table_01', 'C', 0, 1, 'y', '')) AS g(paper_id, table_name, caption, row, col, raw_value, layout)")
def sc8_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = [{"filename": "table_01.csv", "layout": "layout_01.csv", "caption": "C", "figure_id": "S1.T1"}]
    path = _local({"1602.1/metadata.json": json.dumps(meta), "1602.1/table_01.csv": "x,y\n", "1602.1/layout_01.csv": "border-t,\n"})
    return readers.read_tables(spark, path).drop("figure_id")


@register("sc12_proposals", """SELECT l_orderkey::VARCHAR || '/t/' || l_linenumber AS cell_ext_id, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag || ', "m"' END AS model, l_discount AS confidence,
CASE WHEN l_linestatus = 'F' THEN l_quantity END AS parsed FROM lineitem""")
def sc12_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC12, SK6: lines of orders as proposals, written and read again: only numbers may be null."""
    model = F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat("l_returnflag", F.lit(', "m"')))
    made = {"cell_ext_id": F.concat_ws("/", F.col("l_orderkey").cast("string"), F.lit("t"), F.col("l_linenumber").cast("string")), "model": model, "confidence": F.col("l_discount"), "parsed": F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))}
    names = [c.split(" ")[0] for c in schemas.PROPOSALS.split(", ")]
    path = _folder(spark)
    sinks.save_csv(table(spark, sf_dir, "lineitem").select(*[made.get(n, F.lit("")).alias(n) for n in names]), path)
    return readers.read_proposals(spark, path).select("cell_ext_id", "model", "confidence", "parsed")


@register("sc16_archives", "SELECT * FROM (VALUES ('1602.00001', 'success', 'main.tex'), ('1602.00002v1', 'success', 'a.tex'), ('1602.00003', 'no-tex', NULL), ('1602.00004', 'withdrawn', NULL)) AS g(paper_id, status, name)")
def sc16_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16, TX18: archives of every kind, and the identifiers in their names."""
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as tar:
        content = b"\\documentclass{article}"
        info = tarfile.TarInfo("src/a.tex")
        info.size = len(content)
        tar.addfile(info, io.BytesIO(content))
    path = _local({"1602.00001.gz": gzip.compress(b"\\documentclass{x}"), "1602.00002v1.tar.gz": data.getvalue(), "1602.00003.pdf": b"%PDF-1.4" + b"x" * 200, "1602.00004.gz": gzip.compress(b"%auto-ignore")})
    return archives.read_archives(spark, path).select("paper_id", "status", "name")


@register("sc17_temp_paper", "SELECT 1::BIGINT AS n, 36::BIGINT AS width")
def sc17_temp_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.temp_paper(spark, "<p>x</p>").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("paper_id")).cast("long").alias("width"))


@register("sc18_glue", "SELECT o_orderkey::VARCHAR AS guid, o_orderpriority AS text_a, o_orderstatus || ' b' AS text_b, CASE WHEN o_custkey % 2 = 0 THEN 'entailment' ELSE 'neutral' END AS label FROM orders")
def sc18_glue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18: orders as pairs of sentences in tab-separated files with a header."""
    filler = [F.lit(str(i)) for i in range(1, 8)]
    label = F.when(F.col("o_custkey") % 2 == 0, "entailment").otherwise("neutral")
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), *filler, "o_orderpriority", F.concat("o_orderstatus", F.lit(" b")), F.lit("x"), label)
    lines = table(spark, sf_dir, "orders").select(line.alias("value")).union(spark.range(1).select(F.lit("index\tsentences")))
    path = _folder(spark)
    lines.write.text(path)
    return readers.read_glue(spark, path)


@register("sc20_surnames", "SELECT DISTINCT lower(p_brand) AS surname FROM part")
def sc20_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20: brands with their counts as a dictionary in JSON."""
    counts = table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    path = _folder(spark)
    counts.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("b", "n")))).alias("value")).write.text(path)
    return readers.read_surnames(spark, path)


@register("sc11_json_cache", "SELECT event_type AS paper, (event_id % 100)::INTEGER AS n FROM events")
def sc11_json_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11: events as caches of records in JSON."""
    rows = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_type").alias("paper"), (F.col("event_id") % 100).alias("n"))).alias("line"))
    path = _folder(spark)
    _as_files(rows, path, max(8, tasks_for(rows)))
    return readers.read_json_cache(spark, path, "paper string, n int").select("paper", "n")


@register("sk1_save_tables", "SELECT (o_orderkey % 4)::INTEGER AS paper_id, count(*) AS cells FROM orders GROUP BY 1")
def sk1_save_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK1: cells written by paper and read again."""
    cells = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("paper_id"), F.lit("table_01").alias("table_name"), F.col("o_orderkey").alias("row"), F.lit(0).alias("col"), F.col("o_orderstatus").alias("value"))
    path = _folder(spark)
    sinks.save_tables(cells, path)
    return sinks.stored(spark, path).groupBy("paper_id").agg(F.count(F.lit(1)).alias("cells"))


@register("sk2_save_text", "SELECT count(*) AS papers FROM pages")
def sk2_save_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK2: fragments of all pages as one document for each paper (partitioned coarsely)."""
    from tabulith.sources.html import fragments

    rows = fragments(table(spark, sf_dir, "pages"), "page_id")
    by_page = rows.groupBy("page_id").agg(F.first("title", True).alias("title"), F.sort_array(F.collect_list(F.struct("order", "header", "text"))).alias("fragments"))
    path = _folder(spark)
    sinks.save_json(by_page, path)
    return spark.read.schema("page_id long, title string").json(path).agg(F.count(F.lit(1)).alias("papers"))


@register("sk3_upsert_delete", "SELECT c_nationkey, CASE WHEN c_nationkey = 5 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey FROM customer WHERE c_nationkey NOT IN (3, 7) UNION ALL SELECT 99, 1")
def sk3_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK3: one paper replaced, one added, two deleted; the others stay."""
    rows, path = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), _folder(spark)
    sinks.upsert(rows, path, "c_nationkey")
    more = spark.createDataFrame([(1, 99)], rows.schema)
    sinks.upsert(rows.where("c_nationkey = 5").withColumn("c_custkey", F.col("c_custkey") + 1_000_000).unionByName(more), path, "c_nationkey")
    sinks.delete(spark, path, spark.createDataFrame([(3,), (7,), (1000,)], "c_nationkey int"), "c_nationkey")
    return sinks.stored(spark, path).select("c_nationkey", "c_custkey")


@register("sk5_sharded", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sk5_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK5: shards read together."""
    path = _folder(spark)
    sinks.save_sharded(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), path, 4, "o_custkey")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("sk7_experiments", "SELECT * FROM (VALUES ('nbsvm', 1, 0.8::DOUBLE), ('nbsvm', 2, 0.9)) AS g(name, n_grams, accuracy)")
def sk7_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK7, SC14: experiments saved and loaded with their results."""
    from tabulith.operators.experiments import Experiment, experiments_grid, load_experiments, save_experiments

    path = _folder(spark)
    runs = experiments_grid(Experiment(), n_grams=[1, 2])
    save_experiments(spark, list(zip(runs, [{"accuracy": 0.8}, {"accuracy": 0.9}])), path)
    return load_experiments(spark, path).select("name", "n_grams", F.col("results")["accuracy"].alias("accuracy"))


@register("sk11_legend", "SELECT l_returnflag AS tag, 'flag ' || l_returnflag AS description, count(*) AS n FROM lineitem GROUP BY ALL")
def sk11_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK11: return flags as tags of cells, with what a legend says of them and how often they come."""
    legend = spark.createDataFrame([(x, f"flag {x}") for x in "ANR"], "tag string, description string")
    return readers.tag_counts(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("tag")), legend)


@register("sk10_sections", "SELECT doc_id, 1 AS found FROM documents WHERE contains(lower(string_split(text, chr(10))[1]), 'the')")
def sk10_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK10: documents whose header, their first line, has a name in it."""
    return table(spark, sf_dir, "documents").where(F.lower(F.split("text", "\n")[0]).contains("the")).select("doc_id", F.lit(1).alias("found"))
