"""Queries of projections, filters, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions import text as t
from tabulith.operators import filters as f
from tabulith.operators import lookups, sets
from tabulith.registry import register, table


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as proposals: the order is the paper, the part the table."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").agg(
        F.max("l_quantity").alias("q"), F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    key = F.concat_ws("/", (F.col("l_orderkey") % 500).cast("string"), F.col("l_partkey").cast("string"), F.concat_ws(".", "l_linenumber", "l_suppkey", "l_orderkey"))
    model = F.when(F.col("l_suppkey") % 11 == 0, "").when(F.col("l_suppkey") % 7 == 0, "model-competing").otherwise("model-best")
    return rows.select(
        key.alias("cell_ext_id"), F.col("flag").alias("task"), F.col("status").alias("dataset"),
        F.when(F.col("flag") == "R", "error rate").otherwise("accuracy").alias("metric"),
        model.alias("model_type"), model.alias("struct_model_type"),
        F.concat(F.col("status"), F.when(F.col("l_partkey") % 5 == 0, " dev").when(F.col("l_partkey") % 9 == 0, " train").otherwise("")).alias("struct_dataset"),
        F.round(1 - F.col("disc") * 3, 2).alias("confidence"), F.col("q").alias("parsed"))


_PROPOSALS = """x AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, max(l_quantity) AS q, max(l_discount) AS disc, max(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1,2,3,4),
p AS (SELECT (l_orderkey % 500) || '/' || l_partkey || '/' || l_linenumber || '.' || l_suppkey || '.' || l_orderkey AS cell_ext_id, (l_orderkey % 500)::VARCHAR AS paper, flag AS task, status AS dataset,
 CASE WHEN flag = 'R' THEN 'error rate' ELSE 'accuracy' END AS metric, CASE WHEN l_suppkey % 11 = 0 THEN '' WHEN l_suppkey % 7 = 0 THEN 'model-competing' ELSE 'model-best' END AS model_type,
 status || CASE WHEN l_partkey % 5 = 0 THEN ' dev' WHEN l_partkey % 9 = 0 THEN ' train' ELSE '' END AS struct_dataset, round(1 - disc * 3, 2) AS confidence, q AS parsed FROM x),
s AS (SELECT *, CASE WHEN contains(struct_dataset, 'train') THEN 'train-dataset' WHEN contains(struct_dataset, 'dev') THEN 'dev-dataset' WHEN model_type = '' THEN 'empty-model-type' END AS r1 FROM p)"""
_BEST = """b AS (SELECT *, CASE WHEN r1 IS NULL AND model_type = 'model-best' THEN first_value(cell_ext_id) OVER (PARTITION BY task, dataset, metric, paper, (r1 IS NULL AND model_type = 'model-best') ORDER BY CASE WHEN flagged < 0 THEN -parsed ELSE parsed END DESC, cell_ext_id) END AS best
 FROM (SELECT *, CASE WHEN contains(metric, 'error') THEN -1 ELSE 1 END AS flagged FROM s))"""


@register("pf4_structure_filter", f"WITH {_PROPOSALS} SELECT cell_ext_id, r1 AS reason FROM s")
def pf4_structure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.chain(f.by_structure)(_proposals(spark, sf_dir)).select("cell_ext_id", "reason")


@register("pf5_confidence", f"WITH {_PROPOSALS} SELECT cell_ext_id, confidence FROM p WHERE confidence >= 0.8")
def pf5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.kept(f.chain(f.by_confidence(0.8))(_proposals(spark, sf_dir))).select("cell_ext_id", "confidence")


@register("pf6_nothing", f"WITH {_PROPOSALS} SELECT cell_ext_id FROM p")
def pf6_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.kept(f.chain(f.nothing)(_proposals(spark, sf_dir))).select("cell_ext_id")


@register("pf7_compound_reason", f"WITH {_PROPOSALS} SELECT coalesce(CASE WHEN r1 IS NOT NULL THEN r1 WHEN confidence < 0.8 THEN 'confidence' END, '') AS reason, count(*) AS n FROM s GROUP BY 1")
def pf7_compound_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF7: rows by the first filter that rejects them."""
    rows = f.chain(f.by_structure, f.by_confidence(0.8))(_proposals(spark, sf_dir))
    kind = F.coalesce(F.when(F.col("reason").startswith("confidence"), "confidence").otherwise(F.col("reason")), F.lit(""))
    return rows.groupBy(kind.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register("w2_best_result", f"""WITH {_PROPOSALS}, {_BEST} SELECT cell_ext_id, CASE WHEN r1 IS NOT NULL THEN r1 WHEN best = cell_ext_id THEN NULL WHEN model_type = 'model-competing' THEN 'model-competing' WHEN best IS NOT NULL THEN 'replaced by ' || best ELSE '' END AS reason FROM b""")
def w2_best_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the structure filter the best result of every leaderboard and paper."""
    return f.chain(f.by_structure, f.by_best_result())(_proposals(spark, sf_dir)).select("cell_ext_id", "reason")


@register("w3_direction", """SELECT p_partkey, CASE WHEN coalesce(v.votes, CASE WHEN contains(lower(p_name), 'error') THEN -1 ELSE 0 END) >= 0 THEN 1 ELSE -1 END AS direction
FROM part LEFT JOIN (SELECT p_brand, sum(CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END) AS votes FROM part WHERE p_size < 20 GROUP BY p_brand) v USING (p_brand)""")
def w3_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction of a metric from its votes."""
    part = table(spark, sf_dir, "part")
    votes = part.where("p_size < 20").groupBy(F.col("p_brand").alias("metric")).agg(F.sum(F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1)).alias("votes"))
    info = votes.select(F.lit(None).cast("string").alias("task"), F.lit(None).cast("string").alias("dataset"), "metric", "votes")
    rows = part.select("p_partkey", F.lit("t").alias("task"), F.lit("d").alias("dataset"), F.col("p_brand").alias("metric"))
    return f.with_directions(rows, info).select("p_partkey", "direction")


@register("j7_threshold_intervals", f"""WITH {_PROPOSALS}, v AS (SELECT *, CASE WHEN contains(metric, 'error') THEN -parsed ELSE parsed END AS val, (model_type <> 'model-best' OR r1 IS NOT NULL) AS ign FROM s),
o AS (SELECT * FROM v WHERE NOT ign)
SELECT v.cell_ext_id, CASE WHEN v.ign THEN 1.0 ELSE coalesce((SELECT max(confidence) FROM o WHERE o.task = v.task AND o.dataset = v.dataset AND o.metric = v.metric AND o.paper = v.paper AND o.val > v.val),
 (SELECT CASE WHEN arg_min(o.cell_ext_id, o.cell_ext_id) <> v.cell_ext_id THEN arg_min(o.confidence, o.cell_ext_id) END FROM o WHERE o.task = v.task AND o.dataset = v.dataset AND o.metric = v.metric AND o.paper = v.paper AND o.val = v.val), 0.0) END::DOUBLE AS min_threshold,
 CASE WHEN v.ign THEN 0.0 ELSE v.confidence END::DOUBLE AS max_threshold FROM v""")
def j7_threshold_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.threshold_intervals(_proposals(spark, sf_dir)).select("cell_ext_id", "min_threshold", "max_threshold")


@register("w1_first_k", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 3")
def w1_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return f.first_k(rows, ["user_id", "event_type"], ["ts", "event_id"], 3).drop("ts")


@register("tk2_topk_per_group", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 5")
def tk2_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(order).alias("rank"), "value")
    return rows.where("rank <= 5").drop("value")


@register("tk3_ordered_names", "SELECT lower(c_name) AS stem, c_custkey FROM customer ORDER BY lower(c_name), c_custkey LIMIT 50")
def tk3_ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK3: the first fifty names in order (a top-k, not a full sort)."""
    return table(spark, sf_dir, "customer").select(F.lower("c_name").alias("stem"), "c_custkey").orderBy("stem", "c_custkey").limit(50)


@register("tk4_feature_order", "SELECT idx, round(weight, 6) AS weight FROM (SELECT i AS idx, sum(embedding[i + 1]) * (i + 1) AS weight FROM embeddings, (SELECT unnest(range(0, 64))::INTEGER AS i) GROUP BY i) ORDER BY round(weight, 6) DESC, idx LIMIT 10")
def tk4_feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK4: coefficients times a scale, largest first."""
    sums = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("idx", "x")).groupBy("idx").agg(F.sum(F.col("x").cast("double")).alias("s"))
    return sums.select("idx", F.round(F.col("s") * (F.col("idx") + 1), 6).alias("weight")).orderBy(F.desc("weight"), "idx").limit(10)


@register("tk5_sql_limit", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20")
def tk5_sql_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK5, SC10: a SQL text with a limit of its own."""
    from tabulith.sources.readers import sql_query

    return sql_query(spark, {"orders": table(spark, sf_dir, "orders")}, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey", 20)


@register("w4_change_points", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def w4_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, TX14: where the header changes."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return lookups.change_points(rows, ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@register("w10_softmax", """WITH x AS (SELECT o_custkey, o_orderkey, o_totalprice / 100000 AS lp FROM orders), m AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY o_custkey)) AS e FROM x)
SELECT o_custkey, o_orderkey, round(e / sum(e) OVER (PARTITION BY o_custkey), 8) AS p FROM m""")
def w10_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100000).alias("lp"))
    return sets.softmax(rows, ["o_custkey"], "lp", "p").select("o_custkey", "o_orderkey", F.round("p", 8).alias("p"))


@register("pf1_alpha_cells", "SELECT p_partkey, regexp_matches(p_name, '[a-zA-Z]{2,}') AS alpha, regexp_matches(p_type, '^\\s*[a-zA-Z]|[a-zA-Z]{2}') AS texty FROM part")
def pf1_alpha_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF1, PF2."""
    return table(spark, sf_dir, "part").select("p_partkey", t.is_alpha_cell(F.col("p_name")).alias("alpha"), t.is_text_cell(F.col("p_type")).alias("texty"))


@register("pf3_numeric_cells", "SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(text, '[ \\n]')) AS w FROM documents) WHERE regexp_matches(trim(w), '^[-+±0-9eE.,%^_/() ]{2,}$|^\\s*[0-9]\\s*$')")
def pf3_numeric_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \\n]")).alias("w"))
    return words.where(t.is_number_cell(F.col("w"))).distinct()


@register("pf8_paper_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE regexp_replace('p' || o_custkey || 'v2', 'v[0-9]+$', '') = 'p7'")
def pf8_paper_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF8: a paper by its identifier without version."""
    key = F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("v2"))
    return lookups.papers_by_id(table(spark, sf_dir, "orders").withColumn("paper_id", key), "p7v1").select("o_orderkey", "o_custkey")


@register("pf9_node_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%') AS n FROM orders GROUP BY o_custkey")
def pf9_node_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF9: nested nodes with all attributes equal."""
    nested = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderstatus", "o_orderpriority")).alias("nodes"))
    found = lookups.matching_nodes(F.col("nodes"), o_orderstatus="F", o_orderpriority=lambda c: c.startswith("1"))
    return nested.select("o_custkey", F.size(found).cast("long").alias("n"))


@register("pf12_type_gate", "SELECT vec_id, CASE label % 3 WHEN 0 THEN 'leaderboard' ELSE 'ablation' END AS type FROM embeddings WHERE label % 3 <> 2")
def pf12_type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF12: tables that are no results are left out."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("label"))
    return lookups.typed_tables(rows, {0: "leaderboard", 1: "ablation"}).select("vec_id", "type")


@register("pf13_errors", "SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT DISTINCT FROM toxic")
def pf13_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.disagreements(table(spark, sf_dir, "labels"), "quality", "toxic", equal=True).select("doc_id", "quality", "toxic")


@register("pf14_folds", "SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split FROM documents")
def pf14_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", lookups.fold_split(F.col("doc_id") % 11).alias("split"))


@register("pf15_align", "SELECT region_rows.c_nationkey, count(*) - count(*) % 8 AS kept FROM customer region_rows GROUP BY c_nationkey HAVING count(*) >= 8")
def pf15_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF15: groups cut to a multiple of the batch."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return sets.align(rows, ["c_nationkey"], "c_custkey", 8).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("kept"))


@register("pf16_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)")
def pf16_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF16, J4."""
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return lookups.known_only(table(spark, sf_dir, "orders"), rich, ["o_custkey"]).select("o_orderkey")


@register("pf17_type_labels", "SELECT doc_id, CASE WHEN quality = 1 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS label FROM labels")
def pf17_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF17: 0 results, 1 ablation, 2 neither; results win."""
    return table(spark, sf_dir, "labels").select("doc_id", lookups.type_label(F.col("quality") == 1, F.col("toxic") == 1).alias("label"))


@register("se1_concat", "SELECT o_orderkey AS id, o_orderstatus AS a, NULL AS b FROM orders UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def se1_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("b")), allowMissingColumns=True)


@register("se2_key_union", "SELECT doc_id FROM documents WHERE lang <> 'de' UNION SELECT doc_id FROM labels")
def se2_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


_BAGS = "w AS (SELECT lang, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents), b AS (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL)"


def _bag(spark: SparkSession, sf_dir: str, lang: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").where(F.col("lang") == lang).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@register("se3_bag_difference", f"WITH {_BAGS} SELECT a.word, a.n - coalesce(c.n, 0) AS n FROM b a LEFT JOIN (SELECT * FROM b WHERE lang = 'fr') c USING (word) WHERE a.lang = 'en' AND a.n > coalesce(c.n, 0)")
def se3_bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.bag_difference(_bag(spark, sf_dir, "en"), _bag(spark, sf_dir, "fr"), ["word"], "n")


@register("se4_bag_sum", f"WITH {_BAGS} SELECT word, sum(n)::BIGINT AS n FROM b WHERE lang IN ('en', 'fr') GROUP BY word")
def se4_bag_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.bag_sum([_bag(spark, sf_dir, "en"), _bag(spark, sf_dir, "fr")], ["word"], "n")


@register("se5_intersection", "SELECT user_id, len(list_intersect(list_distinct(list(event_type)), ['click', 'view']))::BIGINT AS common FROM events GROUP BY user_id")
def se5_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets_ = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return sets_.select("user_id", lookups.shared(F.col("s"), ["click", "view"]).alias("common"))


@register("se6_distinct_evidences", "SELECT DISTINCT p_brand, lower(split_part(p_name, ' ', 1)) AS evidence FROM part")
def se6_distinct_evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("evidence")).distinct()


@register("se7_ordered_dedupe", """SELECT user_id, string_agg(event_type, ',' ORDER BY first, event_type) AS types FROM (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL) GROUP BY user_id""")
def se7_ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE7: types in the order of their first appearance."""
    found = lookups.ordered_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])
    return found.select("user_id", F.array_join("event_type", ",").alias("types"))


@register("se8_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def se8_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return lookups.without(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@register("ml9_grid", "SELECT n, b, l FROM (SELECT unnest([1, 2, 3])::INTEGER AS n), (SELECT unnest([true, false]) AS b), (SELECT unnest(['tfidf', 'counts']) AS l)")
def ml9_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML9: the grid of settings."""
    from tabulith.operators.experiments import grid

    return grid(spark, n=[1, 2, 3], b=[True, False], l=["tfidf", "counts"])
