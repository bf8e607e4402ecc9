"""Queries of the table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.operators import cells as c
from tabulith.operators import lookups
from tabulith.operators.tasks import spread
from tabulith.registry import register, table


def _grid(spark: SparkSession, sf_dir: str, paper: bool = False) -> DataFrame:
    """Orders as tables: a line item a row, three of its attributes the columns. All lines of one (with ``paper``: of forty) are in one task."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    keys = ["l_orderkey"]
    if paper:
        lines, keys = lines.withColumn("paper_id", (F.col("l_orderkey") / 40).cast("long")), ["paper_id", "l_orderkey"]
    rows = spread(lines, keys[0]).withColumn("row", F.row_number().over(W.partitionBy(*keys).orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1)
    values = F.array("l_returnflag", "l_linestatus", F.concat(F.lit("m"), (F.col("l_partkey") % 7).cast("string")))
    return rows.select(*keys, "row", F.posexplode(values).alias("col", "value"))


_GRID = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r FROM lineitem),
g AS (SELECT l_orderkey, r::INTEGER AS row, 0 AS col, l_returnflag AS value FROM l UNION ALL SELECT l_orderkey, r, 1, l_linestatus FROM l UNION ALL SELECT l_orderkey, r, 2, 'm' || (l_partkey % 7) FROM l)"""


@register("w6_neighbourhood", f"""WITH {_GRID} SELECT l_orderkey, row, col, value,
 coalesce(lag(value) OVER a, '') || '|' || value || '|' || coalesce(lead(value) OVER a, '') AS across, coalesce(lag(value) OVER d, '') || '|' || value || '|' || coalesce(lead(value) OVER d, '') AS down
FROM g WINDOW a AS (PARTITION BY l_orderkey, row ORDER BY col), d AS (PARTITION BY l_orderkey, col ORDER BY row)""")
def w6_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, TB25: neighbours of every cell in its row and column."""
    rows = c.neighbourhoods(_grid(spark, sf_dir), ["l_orderkey"])
    return rows.select("l_orderkey", "row", "col", "value", F.array_join("row_context", "|").alias("across"), F.array_join("col_context", "|").alias("down"))


@register("tb25_boxes", f"""WITH {_GRID} SELECT a.l_orderkey, a.row, a.col, string_agg(coalesce(b.value, ''), '|' ORDER BY dr, dc) AS box
FROM g a CROSS JOIN (SELECT unnest([-1,0,1])::INTEGER AS dr) CROSS JOIN (SELECT unnest([-1,0,1])::INTEGER AS dc) LEFT JOIN g b ON b.l_orderkey = a.l_orderkey AND b.row = a.row + dr AND b.col = a.col + dc GROUP BY ALL""")
def tb25_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.neighbourhoods(_grid(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "row", "col", F.array_join("box", "|").alias("box"))


def _tagged(rows: DataFrame) -> DataFrame:
    tag = F.when(F.col("value") == "R", "model-best").when(F.col("value") == "m3", "model-competing").when(F.col("value") == "F", "dataset").otherwise("")
    return rows.withColumn("tag", tag)


_TAG = "CASE value WHEN 'R' THEN 'model-best' WHEN 'm3' THEN 'model-competing' WHEN 'F' THEN 'dataset' ELSE '' END"


@register("w9_preceding_annotations", f"""WITH {_GRID}, t AS (SELECT *, {_TAG} AS tag FROM g)
SELECT a.l_orderkey, a.row, a.col, coalesce(string_agg(b.tag || '=' || b.value, ';' ORDER BY CASE WHEN b.row = a.row THEN 0 ELSE 1 END, b.col, b.row) FILTER (WHERE b.l_orderkey IS NOT NULL), '') AS models
FROM t a LEFT JOIN t b ON b.l_orderkey = a.l_orderkey AND contains(b.tag, 'model') AND ((b.row = a.row AND b.col < a.col) OR (b.col = a.col AND b.row < a.row)) GROUP BY ALL""")
def w9_preceding_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged cells left of and above every cell."""
    rows = c.preceding_tags(_tagged(_grid(spark, sf_dir)), ["l_orderkey"], "model")
    text = F.array_join(F.transform("model_values", lambda v: F.concat_ws("=", v["tag"], v["value"])), ";")
    return rows.select("l_orderkey", "row", "col", text.alias("models"))


@register("w11_row_context", f"""WITH {_GRID} SELECT l_orderkey, row, string_agg(value, ' border ' ORDER BY col) AS row_context FROM g GROUP BY ALL""")
def w11_row_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.row_contexts(_grid(spark, sf_dir), ["l_orderkey"]).where("col = 0").select("l_orderkey", "row", "row_context")


@register("w12_unique_model", f"""WITH {_GRID}, t AS (SELECT *, {_TAG} AS tag FROM g)
SELECT a.l_orderkey, a.row, a.col, coalesce((SELECT arg_min(tag, row) FROM t b WHERE b.l_orderkey = a.l_orderkey AND b.col = a.col AND b.tag LIKE 'model%'), (SELECT arg_min(tag, col) FROM t b WHERE b.l_orderkey = a.l_orderkey AND b.row = a.row AND b.tag LIKE 'model%')) AS model FROM t a""")
def w12_unique_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.unique_model(_tagged(_grid(spark, sf_dir)), ["l_orderkey"]).select("l_orderkey", "row", "col", F.col("model.tag").alias("model"))


@register("tb17_drop_blank", """WITH g AS (SELECT o_orderkey AS t, r, c, 'v' || r || c AS raw_value FROM orders, (SELECT unnest([0, 1, 2]) AS r), (SELECT unnest([0, 1, 2]) AS c) WHERE o_orderstatus <> 'P' AND (o_orderkey + r) % 3 <> 0 AND (o_orderkey + c) % 3 <> 1)
SELECT t, (dense_rank() OVER (PARTITION BY t ORDER BY r) - 1)::INTEGER AS row, (dense_rank() OVER (PARTITION BY t ORDER BY c) - 1)::INTEGER AS col, raw_value FROM g""")
def tb17_drop_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB17, TB18: every order is a table with a blank row and a blank column, which vanish, or blank altogether."""
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("t"), "o_orderstatus", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col"))
    blank = (F.col("o_orderstatus") == "P") | ((F.col("t") + F.col("row")) % 3 == 0) | ((F.col("t") + F.col("col")) % 3 == 1)
    value = F.when(blank, F.when(F.col("col") == 0, " ").otherwise("")).otherwise(F.concat(F.lit("v"), F.col("row").cast("string"), F.col("col").cast("string")))
    return c.drop_blank(cells.select("t", "row", "col", value.alias("raw_value")), ["t"])


@register("tb23_matrix", f"""WITH {_GRID} SELECT l_orderkey, list(line ORDER BY row) AS matrix FROM (SELECT l_orderkey, row, list(value ORDER BY col) AS line FROM g GROUP BY ALL) GROUP BY l_orderkey""")
def tb23_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.matrix(_grid(spark, sf_dir), ["l_orderkey"])


@register("tb23_round_trip", f"WITH {_GRID} SELECT l_orderkey, row, col, value FROM g")
def tb23_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to matrices and back."""
    return c.from_matrix(c.matrix(_grid(spark, sf_dir), ["l_orderkey"]), ["l_orderkey"])


@register("tb27_transfer", f"""WITH {_GRID} SELECT l_orderkey, count(*) AS cells, count(*) AS matched FROM g GROUP BY l_orderkey""")
def tb27_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB26, TB27: tags that follow from a cell's own value move to the same table completely."""
    rows = _tagged(_grid(spark, sf_dir))
    found = c.transfer(rows, rows.drop("tag"), ["l_orderkey"])
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("cells"), F.count_if("matched").alias("matched"))


@register("tb28_match_tables")
def tb28_match_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB28: tables of one paper matched to an earlier version by content."""
    rows = _tagged(_grid(spark, sf_dir, paper=True)).withColumn("table_name", F.col("l_orderkey").cast("string"))
    return c.match_tables(rows, rows.withColumn("table_name", F.concat(F.lit("new"), "table_name")))


@register("tb29_match_captions", """WITH k AS (SELECT p_partkey % 50 AS paper_id, p_partkey, regexp_replace(lower(p_name), '[\\s!-/:-@\\[-`{-~]+', '', 'g') AS key FROM part)
SELECT paper_id, 'new' || min(p_partkey) AS table_name, min(p_partkey)::VARCHAR AS old_name FROM k WHERE length(key) >= 10 GROUP BY paper_id, key HAVING count(*) = 1""")
def tb29_match_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB29: tables matched by unique captions."""
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("paper_id"), F.col("p_partkey").cast("string").alias("table_name"), F.concat(F.lit("Table 1: "), "p_name").alias("caption"))
    return c.match_by_caption(rows, rows.withColumn("table_name", F.concat(F.lit("new"), "table_name")))


@register("tb31_annotated_tables", "SELECT doc_id FROM documents WHERE lang = 'en' AND source <> '' AND source NOT LIKE '%src1%'")
def tb31_annotated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB31: tables of one parser whose tags are neither empty nor trash."""
    return lookups.annotated(table(spark, sf_dir, "documents"), F.col("lang") == "en", "source", "src1").select("doc_id")


@register("tb32_table_by_name", "SELECT min(p_partkey) AS p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def tb32_table_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB32: the first table of a name."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    return part.agg(F.min(F.struct("p_brand", "p_partkey")).alias("m")).select(F.col("m.p_partkey").alias("p_partkey"))


@register("j6_label_cells", f"""WITH {_GRID} SELECT l_orderkey, row, col, CASE WHEN value = 'R' THEN 'model-best' WHEN value = 'F' THEN 'dataset' ELSE '' END AS tag FROM g""")
def j6_label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grid(spark, sf_dir)
    tags = rows.where("value IN ('R', 'F')").withColumn("predicted_tags", F.when(F.col("value") == "R", "model-paper").otherwise("dataset"))
    return c.label_cells(rows, tags, ["l_orderkey"]).select("l_orderkey", "row", "col", "tag")


@register("tb13_layout", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'border-t border-tt align-left header' ELSE '' END AS layout, CASE o_orderkey % 3 WHEN 0 THEN o_custkey % 4 + 1 ELSE 1 END::INTEGER AS colspan, 1 AS rowspan FROM orders""")
def tb13_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB13, TB16: encoded layouts parsed and written out."""
    kind = F.col("o_orderkey") % 3
    encoded = F.when(kind == 0, F.concat(F.lit("tt t,left,True,"), (F.col("o_custkey") % 4 + 1).cast("string"), F.lit(",1"))).when(kind == 1, ",,False,1,1").otherwise("")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), c.parse_layout(encoded).alias("l"))
    text = c.layout_text(F.col("l.borders"), F.col("l.align"), F.array().cast("array<string>"), F.col("l.header"))
    return rows.select("id", text.alias("layout"), "l.colspan", "l.rowspan")


@register("ml7_layout_features", f"""WITH {_GRID}, m AS (SELECT *, max(row) OVER (PARTITION BY l_orderkey) AS lr, max(col) OVER (PARTITION BY l_orderkey) AS lc FROM g)
SELECT l_orderkey, row, col, [CASE WHEN value = 'R' THEN 1.0 ELSE -1.0 END, -1.0, -1.0, -1.0, CASE WHEN value = 'F' THEN 1.0 ELSE -1.0 END, -1.0, -1.0, -1.0, -1.0, -1.0, -1.0, -1.0,
 CASE WHEN row = 0 THEN 1.0 ELSE -1.0 END, CASE WHEN row = lr THEN 1.0 ELSE -1.0 END, CASE WHEN col = 0 THEN 1.0 ELSE -1.0 END, CASE WHEN col = lc THEN 1.0 ELSE -1.0 END]::DOUBLE[] AS features FROM m""")
def ml7_layout_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _grid(spark, sf_dir).withColumn("cell_layout", F.when(F.col("value") == "R", "border-tt").otherwise("")).withColumn("cell_reference", F.when(F.col("value") == "F", "bib1").otherwise("")).withColumn("cell_styles", F.lit(False))
    return c.layout_features(rows, ["l_orderkey"]).select("l_orderkey", "row", "col", "features")


@register("sk9_table_html", f"""WITH {_GRID} SELECT l_orderkey, '<table>' || string_agg('<tr>' || h || '</tr>', '' ORDER BY row) || '</table>' AS html FROM
 (SELECT l_orderkey, row, string_agg('<td>' || value || '</td>', '' ORDER BY col) AS h FROM g GROUP BY ALL) GROUP BY l_orderkey""")
def sk9_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table_html(_grid(spark, sf_dir), ["l_orderkey"])


@register("tb24_annotations", """SELECT user_id, event_id, json_extract(props, '$.k')::BIGINT AS value FROM events WHERE json_extract(props, '$.k')::BIGINT > 50""")
def tb24_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB24: annotation records parsed from JSON, incomplete ones dropped."""
    rows = lookups.records(table(spark, sf_dir, "events").select("user_id", "event_id", "props"), "props", 50)
    return rows.where("key = 'k'").drop("key")
