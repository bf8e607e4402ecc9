"""Queries of operators that the other modules use inside, each by itself."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions import text as t
from tabulith.functions import values as v
from tabulith.operators import cells as c
from tabulith.operators import evaluation as e
from tabulith.operators import filters, linking, models
from tabulith.plans.sources import _folder
from tabulith.registry import order_papers, register, table
from tabulith.sources import adapters, archives, html, sinks


@register("tb14_spans", """SELECT o_orderkey AS t, row, col, CASE WHEN row = 0 AND col = 0 THEN 'cb' WHEN row = 0 AND col = o_orderkey % 2 + 1 THEN 'ce' WHEN row = 0 AND col < o_orderkey % 2 + 1 THEN 'ci' WHEN row = 1 AND col = 0 THEN 'rb' WHEN row = 2 AND col = 0 THEN 're' ELSE '' END AS span
FROM orders, (SELECT unnest([0, 1, 2]) AS row), (SELECT unnest([0, 1, 2, 3]) AS col)""")
def tb14_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB14, W7: parts of wide and tall cells; every order is a table with a cell two or three columns wide."""
    wide = F.col("t") % 2 + 2
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row")).select("t", "row", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col"))
    spans = cells.withColumn("colspan", F.when((F.col("row") == 0) & (F.col("col") < wide), wide).otherwise(1).cast("int")).withColumn("rowspan", F.when((F.col("row") > 0) & (F.col("col") == 0), 2).otherwise(1))
    return c.label_spans(spans.withColumn("borders", F.array(F.lit("l"), F.lit("r"))), ["t"]).select("t", "row", "col", F.array_join("span", ",").alias("span"))


_PAGE = (
    '<figure class="ltx_table" id="S1.T1"><figcaption class="ltx_caption">C</figcaption><span class="ltx_tabular"><span class="ltx_tr"><span class="ltx_th ltx_td">h<span class="ltx_ERROR">!</span></span>'
    '<span class="ltx_td" style="color:#ff0000">1<span class="ltx_role_footnote">note</span></span></span></span></figure>'
)


@register("tb2_markup", "SELECT o_orderkey AS paper_id, row, col, replace(raw_value, '@', o_custkey::VARCHAR) AS raw_value, header, 'S1.T1' AS figure_id, 'C ' || o_custkey AS caption FROM orders, (VALUES (0, 0, 'h', true), (0, 1, '@', false)) AS g(row, col, raw_value, header)")
def tb2_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB2 to TB9: span tables, headers, errors, notes, captions and colours of pages, one for each order."""
    rows = html.cells(order_papers(spark, sf_dir, _PAGE.replace(">C<", ">C @<").replace(">1<", ">@<")))
    return rows.select("paper_id", "row", "col", t.remove_styles(F.col("raw_value")).alias("raw_value"), "header", "figure_id", "caption")


@register("tb11_grid", "SELECT o_orderkey AS paper_id, row, col, replace(raw_value, '@', o_custkey::VARCHAR) AS raw_value FROM orders, (VALUES (0,0,'a'),(0,1,'@'),(0,2,'@'),(1,0,'a'),(1,1,'c'),(1,2,'d'),(2,0,'f @'),(2,1,''),(2,2,'')) AS g(row, col, raw_value)")
def tb11_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB11: spans expanded, the foot after the body, short rows filled."""
    page = '<table class="ltx_tabular"><tfoot><tr><td>f @</td></tr></tfoot><tbody><tr><td rowspan=2>a<td colspan=2>@</tr><tr><td>c<td>d</tr></tbody></table>'
    return html.cells(order_papers(spark, sf_dir, page)).select("paper_id", "row", "col", "raw_value")


@register("tb33_consume", "SELECT o_orderkey AS p, o_orderpriority AS cell_content, CASE WHEN o_orderstatus = 'F' THEN 'bib' || o_custkey ELSE '' END AS cell_reference, o_orderstatus = 'O' AS cell_styles FROM orders")
def tb33_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB33: orders as cells with references and styles."""
    refs = F.when(F.col("o_orderstatus") == "F", F.array(F.concat(F.lit("bib"), F.col("o_custkey").cast("string")), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    raw = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("<bold>"), "o_orderpriority", F.lit("</bold>"))).otherwise(F.col("o_orderpriority"))
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("p"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.concat("o_orderpriority", F.lit(" ")).alias("value"), refs.alias("refs"), F.lit("").alias("layout"), raw.alias("raw_value"))
    return c.consume(cells, ["p"]).select("p", "cell_content", "cell_reference", "cell_styles")


@register("pf2_split_cells", "SELECT regexp_matches(p_name, '^\\s*[a-zA-Z]|[a-zA-Z]{2}') AS alpha, count(*) AS n FROM part GROUP BY 1")
def pf2_split_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF2: cells of text and the rest."""
    return table(spark, sf_dir, "part").groupBy(t.is_text_cell(F.col("p_name")).alias("alpha")).agg(F.count(F.lit(1)).alias("n"))


@register("f10_formats", """SELECT o_orderkey, format, (CASE format WHEN '{x}' THEN 1 WHEN '{100*x}' THEN 100 WHEN '{x/100}' THEN 0.01 END * ((o_custkey % 1000) || '.5')::DECIMAL(18,4))::DOUBLE AS value
FROM orders, (SELECT unnest(['{x}', '{100*x}', '{x/100}', '{x} ( {} )']) AS format)""")
def f10_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a raw value of every order in several formats."""
    raw = F.concat((F.col("o_custkey") % 1000).cast("string"), F.lit(".5"))
    each = [F.struct(F.lit(f).alias("format"), v.extract_value(raw, f).cast("double").alias("value")) for f in ("{x}", "{100*x}", "{x/100}", "{x} ( {} )")]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(*each)))


@register("f24_limit_context", "SELECT o_orderkey AS paper_id, 'b c <b>' || o_custkey || '</b> d e' AS value FROM orders")
def f24_limit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_papers(spark, sf_dir, "a b c <b>@</b> d e f", "s").select("paper_id", t.limit_context(F.col("s"), 2).alias("value"))


@register("f30_known_names", "SELECT o_orderpriority AS name, lower(replace(replace(o_orderpriority, '-', ' '), '  ', ' ')) AS normal FROM orders GROUP BY 1")
def f30_known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """known names with their normal form."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).distinct().select("name", F.lower(F.replace(F.replace("name", F.lit("-"), F.lit(" ")), F.lit("  "), F.lit(" "))).alias("normal"))


@register("j4_membership", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def j4_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of annotated papers."""
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(known, "l_orderkey", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@register("lk13_proposals", """SELECT o_orderkey::VARCHAR AS cell_ext_id, 'Accuracy' AS metric, '{x}%' AS format, (CASE WHEN o_orderkey % 2 = 1 THEN 100 - o_custkey % 100 ELSE o_custkey % 100 END / 100.0)::DOUBLE AS parsed,
CASE WHEN o_orderkey % 2 = 1 THEN 'model-competing' ELSE 'model-best' END AS model_type FROM orders""")
def lk13_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK13, LK14: values in the range of their metric, complements turned: odd orders are of the error."""
    odd = F.col("o_orderkey") % 2 == 1
    tagged = F.struct(F.when(odd, "model-competing").otherwise("model-best").alias("tag"), F.lit("Ours").alias("value"))
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("cell_ext_id"), odd.alias("odd"), F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")).alias("value"), F.array(tagged).alias("model_values"))
    rows = base.withColumn("dataset_values", F.slice("model_values", 1, 0))
    links = base.select("cell_ext_id", F.lit("t").alias("task"), F.lit("d").alias("dataset"), F.when(F.col("odd"), "Error").otherwise("Accuracy").alias("metric"), F.lit("Accuracy").alias("true_metric"), F.lit(0.9).alias("confidence"))
    info = spark.createDataFrame([("Accuracy", "0-1")], "metric string, range string")
    return linking.proposal_rows(rows.drop("odd"), links, info).select("cell_ext_id", "metric", "format", "parsed", "model_type")


@register("tx10_take_while", "SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stops FROM events) WHERE stops = 0 GROUP BY user_id")
def tx10_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX10: what stands before the first stop."""
    stops = F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("user_id", stops.alias("stops")).where("stops = 0").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@register("tx8_paragraphs", "SELECT conv_id, max(p)::BIGINT AS paragraphs FROM (SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS p FROM conversations) GROUP BY conv_id")
def tx8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX8, TX9: the older grouping: an element that begins a paragraph takes the following ones with it."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    number = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order)
    return table(spark, sf_dir, "conversations").withColumn("p", number).groupBy("conv_id").agg(F.max("p").alias("paragraphs"))


@register("tx17_converter", """SELECT o_orderkey AS paper_id, CASE o_orderstatus WHEN 'F' THEN 'processing-error' WHEN 'P' THEN 'empty' ELSE 'success' END AS status, CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN '<p>' || o_orderpriority END AS html FROM orders""")
def tx17_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX17: the seam of the converter, with a mock: a failure is a status, no crash."""

    def mock(source: str) -> str:
        if source == "bad":
            raise RuntimeError("timeout")
        return "<p>" + source

    source = F.when(F.col("o_orderstatus") == "F", "bad").when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return adapters.convert_papers(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), source.alias("source")), mock)


@register("tx18_paper_ids", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '1602.' || (10000 + o_custkey % 90000) || 'v2' ELSE 'notes' || o_custkey || '.tex' END AS paper_id FROM orders""")
def tx18_paper_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX18: the identifiers in the names of archives."""
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("1602."), (F.col("o_custkey") % 90000 + 10000).cast("string"), F.lit("v2.tar.gz"))).otherwise(F.concat(F.lit("notes"), F.col("o_custkey").cast("string"), F.lit(".tex")))
    return table(spark, sf_dir, "orders").select("o_orderkey", archives.paper_id(name).alias("paper_id"))


@register("rf1_citations", "SELECT o_orderkey AS ref_id, 'success' AS status, 'TEI ' || o_orderpriority AS tei FROM orders")
def rf1_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RF1, RF5: equal reference strings are parsed once."""
    return adapters.parse_citations(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderpriority").alias("ref_str")), lambda s: "TEI " + s)


@register("sc5_graphql", "SELECT o_orderkey::VARCHAR AS arxiv_id, 'success' AS status, '{\"id\": ' || o_orderkey || '}' AS json FROM orders")
def sc5_graphql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5: the seam of a live endpoint, with a mock."""
    return adapters.graphql(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("arxiv_id")), lambda i: '{"id": ' + i + "}")


@register("sc13_session", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def sc13_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13, SK8: a collection stored and loaded as Parquet, in place of pickles."""
    path = _folder(spark)
    table(spark, sf_dir, "events").write.parquet(path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@register("sc19_manifest", "SELECT c_custkey FROM customer WHERE c_name IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')")
def sc19_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19: the files of a manifest that are wanted."""
    names = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_name").distinct()
    return table(spark, sf_dir, "customer").join(names, "c_name", "left_semi").select("c_custkey")


@register("sk4_evidence_csv", "SELECT count(*) AS n, count(DISTINCT p_type) AS contents FROM part")
def sk4_evidence_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK4: evidence written as CSV and read again."""
    path = _folder(spark)
    sinks.save_csv(table(spark, sf_dir, "part").select("p_partkey", "p_type"), path)
    return spark.read.csv(path, header=True).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("contents"))


@register("ud1_own_filter", "SELECT count(*) FILTER (WHERE o_totalprice >= 100000 AND o_orderstatus = 'F') AS kept, count(*) FILTER (WHERE o_totalprice < 100000) AS cheap FROM orders")
def ud1_own_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD1: filters of one's own in a chain."""

    def cheap(rows: DataFrame) -> DataFrame:
        return rows.withColumn("reason", F.coalesce("reason", F.when(F.col("o_totalprice") < 100000, "cheap")))

    def is_open(rows: DataFrame) -> DataFrame:
        return rows.withColumn("reason", F.coalesce("reason", F.when(F.col("o_orderstatus") != "F", "open")))

    rows = filters.chain(cheap, is_open)(table(spark, sf_dir, "orders"))
    return rows.agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason") == "cheap").alias("cheap"))


@register("ud7_row_functions", "SELECT p_partkey, upper(p_brand) || '/' || p_size AS label FROM part")
def ud7_row_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD7: what would be a lambda for each row is an expression."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", F.upper("p_brand"), F.col("p_size").cast("string")).alias("label"))


@register("ml3_stored_model")
def ml3_stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML3, ML4, ML8, SC15, SK7: several classes, one against the rest (in place of neural nets), stored and loaded."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + F.col("toxic")).alias("label"))
    rows = models.group_split(table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id"), "text", 5)
    path = _folder(spark)
    models.multi_class(rows.where("NOT is_valid"), features=1 << 10).write().overwrite().save(path)
    scored = PipelineModel.load(path).transform(rows.where("is_valid")).withColumn("prediction", F.col("prediction").cast("int"))
    return e.class_metrics(scored, "prediction", "label")


@register("ml11_seeded", "SELECT count(*) AS same FROM documents")
def ml11_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML11: splits with one seed are the same."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    once = models.group_split(docs, "text", 10, 7).withColumnRenamed("is_valid", "before")
    twice = models.group_split(once, "text", 10, 7)
    return twice.where(F.col("before") == F.col("is_valid")).agg(F.count(F.lit(1)).alias("same"))


@register("tk1_ties", "SELECT o_custkey, min(o_orderkey) AS first FROM orders o WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders i WHERE i.o_custkey = o.o_custkey) GROUP BY o_custkey")
def tk1_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK1: the best row of every query, the first of equals."""
    order = F.struct("o_orderpriority", -F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", order).alias("first"))
