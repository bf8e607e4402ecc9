"""Queries of joins and aggregations: scoring, votes, probabilities, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.values import norm_score
from tabulith.operators import evaluation as e
from tabulith.operators import lookups, votes
from tabulith.registry import register, table


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as leaderboard results: what was predicted, and gold."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("v1")).alias("paper"),
        F.col("o_orderpriority").alias("task"),
        F.col("o_orderstatus").alias("dataset"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 2).cast("string")).alias("metric"),
        F.floor(F.col("o_totalprice") / 1000).cast("string").alias("score"),
    )
    return rows.where("price > 50000").drop("o_orderkey", "price"), rows.where("price < 250000").drop("o_orderkey", "price")


_RESULTS = """r AS (SELECT o_orderkey AS k, 'p' || o_custkey AS paper, o_orderpriority AS task, o_orderstatus AS dataset,
 'm' || (o_orderkey % 2) AS metric, floor(o_totalprice / 1000)::BIGINT::VARCHAR AS score, o_totalprice AS price FROM orders),
p AS (SELECT * FROM r WHERE price > 50000), g AS (SELECT * FROM r WHERE price < 250000)"""


def _axis_sql(axis: str, columns: list[str]) -> str:
    c = ", ".join(["paper", *columns])
    return f"""SELECT '{axis}' AS axis, round(sum(tp)/(sum(tp)+sum(fp)+1e-10), 8) AS micro_precision, round(sum(tp)/(sum(tp)+sum(fn)+1e-10), 8) AS micro_recall,
 round(2*(sum(tp)/(sum(tp)+sum(fp)+1e-10))*(sum(tp)/(sum(tp)+sum(fn)+1e-10))/((sum(tp)/(sum(tp)+sum(fp)+1e-10))+(sum(tp)/(sum(tp)+sum(fn)+1e-10))+1e-10), 8) AS micro_f1,
 round(avg(pr), 8) AS macro_precision, round(avg(re), 8) AS macro_recall, round(avg(2*pr*re/(pr+re+1e-10)), 8) AS macro_f1 FROM (
 SELECT *, tp/(tp+fp+1e-10) AS pr, tp/(tp+fn+1e-10) AS re FROM (
  SELECT paper, count(*) FILTER (WHERE inp AND ing)::DOUBLE AS tp, count(*) FILTER (WHERE inp AND NOT ing)::DOUBLE AS fp, count(*) FILTER (WHERE ing AND NOT inp)::DOUBLE AS fn FROM (
   SELECT {c}, bool_or(w = 0) AS inp, bool_or(w = 1) AS ing FROM (SELECT {c}, 0 AS w FROM p UNION ALL SELECT {c}, 1 FROM g) GROUP BY {c}) GROUP BY paper))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("j1_eval_indicator", f"""WITH {_RESULTS} SELECT paper, task, dataset, CASE WHEN bool_or(w = 0) AND bool_or(w = 1) THEN 'TP' WHEN bool_or(w = 0) THEN 'FP' ELSE 'FN' END AS kind
FROM (SELECT paper, task, dataset, 0 AS w FROM p UNION ALL SELECT paper, task, dataset, 1 FROM g) GROUP BY ALL""")
def j1_eval_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct result with its kind."""
    p, g = (x.withColumn("paper", F.regexp_replace("paper", "v1$", "")) for x in _results(spark, sf_dir))
    return e.indicator(p, g, ["paper", "task", "dataset"])


@register("ag1_eval_micro_macro", f"WITH {_RESULTS} SELECT * EXCLUDE (axis) FROM ({_axis_sql('TDM', ['task', 'dataset', 'metric'])})")
def ag1_eval_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1 over task, dataset and metric."""
    p, g = _results(spark, sf_dir)
    return _rounded(e.scores(p, g, ["task", "dataset", "metric"]))


@register("ag2_eval_axes", f"WITH {_RESULTS} " + " UNION ALL ".join(_axis_sql(a, c) for a, c in e.AXES.items()))
def ag2_eval_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2, the flagship: micro and macro scores on every axis."""
    return _rounded(e.evaluate(*_results(spark, sf_dir)))


@register("ag3_binary_cm", """WITH x AS (SELECT l.quality = 1 AS gold, d.n_chars > 500 AS pred, d.lang = 'en' AS eq FROM documents d JOIN labels l USING (doc_id))
SELECT count(*) FILTER (WHERE eq AND pred AND gold) AS tp, count(*) FILTER (WHERE eq AND NOT pred AND NOT gold) AS tn,
 count(*) FILTER (WHERE pred AND (NOT eq OR NOT gold)) AS fp, count(*) FILTER (WHERE gold AND (NOT eq OR NOT pred)) AS fn FROM x""")
def ag3_binary_cm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return e.binary_confusion(rows, F.col("lang") == "en", F.col("n_chars") > 500, F.col("quality") == 1)


@register("ag3_topk_first", """SELECT o_custkey, max(o_orderstatus = 'F') AS equal, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey""")
def ag3_topk_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("equal"), "o_orderpriority", "o_orderkey")
    return e.best_of_topk(rows, "o_custkey", "equal", "o_orderkey")


@register("ag4_metric_report", """WITH x AS (SELECT l_returnflag AS a, l_linestatus AS b, CASE WHEN l_quantity > 25 THEN 'A' ELSE 'N' END AS pa, CASE WHEN l_discount > 0.05 THEN 'O' ELSE 'F' END AS pb FROM lineitem WHERE l_tax > 0.02),
w AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = pa) AS task, count(*) FILTER (WHERE b = pb) AS dataset, count(*) FILTER (WHERE a = pa AND b = pb) AS "all" FROM x)
SELECT 'task' AS "column", task AS matching, round(task / n, 8) AS fraction FROM w UNION ALL SELECT 'dataset', dataset, round(dataset / n, 8) FROM w UNION ALL SELECT 'all', "all", round("all" / n, 8) FROM w""")
def ag4_metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("task_gold"), F.when(F.col("l_quantity") > 25, "A").otherwise("N").alias("task_pred"),
        F.col("l_linestatus").alias("dataset_gold"), F.when(F.col("l_discount") > 0.05, "O").otherwise("F").alias("dataset_pred"), "l_tax")
    return _rounded(e.metric_report(rows, ["task", "dataset"], F.col("l_tax") > 0.02))


@register("ag5_confusion_pivot", """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F", count(*) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY l_returnflag""")
def ag5_confusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5: a confusion matrix, classes given so that no pass looks for them."""
    return lookups.confusion_table(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@register("ag6_class_metrics", """SELECT round(avg((quality = toxic)::INT), 8) AS accuracy, round(count(*) FILTER (WHERE toxic <> 0 AND quality = toxic) / nullif(count(*) FILTER (WHERE toxic <> 0 AND quality = toxic) + count(*) FILTER (WHERE quality <> 0 AND quality <> toxic), 0), 8) AS precision,
 round(count(*) FILTER (WHERE toxic <> 0 AND quality = toxic) / nullif(count(*) FILTER (WHERE toxic <> 0 AND quality = toxic) + count(*) FILTER (WHERE toxic <> 0 AND quality = 0), 0), 8) AS recall FROM labels""")
def ag6_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(e.class_metrics(table(spark, sf_dir, "labels"), "quality", "toxic"))


@register("ag7_binary_metrics", """WITH x AS (SELECT CASE WHEN label < 5 THEN 0 ELSE 1 END AS y, CASE WHEN embedding[1] < 0 THEN 0 ELSE 1 END AS p FROM embeddings)
SELECT round(avg((y = p)::INT), 8) AS accuracy, round(count(*) FILTER (WHERE y = 1 AND p = 1) / count(*) FILTER (WHERE p = 1), 8) AS precision, round(count(*) FILTER (WHERE y = 1 AND p = 1) / count(*) FILTER (WHERE y = 1), 8) AS recall FROM x""")
def ag7_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7: classes merged to two before they are counted."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") >= 5).cast("int").alias("y"), (F.col("embedding")[0] >= 0).cast("int").alias("p"))
    return _rounded(e.class_metrics(rows, "p", "y"))


_PROBS = "SELECT vec_id % 50 AS cell, list_transform(embedding[1:5], lambda x: abs(x)::DOUBLE) AS p FROM embeddings"


def _votes_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(x).cast("double"))
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).alias("cell"), p.alias("p"))


@register("ag8_vote_majority", """SELECT label AS cell, arg_max(v, n * 100 - v)::BIGINT AS vote FROM (SELECT label, vec_id % 7 AS v, count(*) AS n FROM embeddings GROUP BY ALL) GROUP BY label""")
def ag8_vote_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8: the most frequent prediction of a group, the smallest of equals."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cell"), (F.col("vec_id") % 7).alias("v"))
    return votes.majority(rows, "cell", "v")


@register("ag9_vote_avg", f"""SELECT cell, arg_max(i, round(s, 6) * 1000 - i)::BIGINT AS vote FROM (SELECT cell, i, sum(p[i + 1]) AS s FROM ({_PROBS}), (SELECT unnest(range(0, 5)) AS i) GROUP BY ALL) GROUP BY cell""")
def ag9_vote_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.by_probabilities(_votes_input(spark, sf_dir), "cell", "p", F.sum)


@register("ag10_vote_max", f"""SELECT cell, arg_max(i, s * 100000000 - i)::BIGINT AS vote FROM (SELECT cell, i, max(p[i + 1]) AS s FROM ({_PROBS}), (SELECT unnest(range(0, 5)) AS i) GROUP BY ALL) GROUP BY cell""")
def ag10_vote_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.by_probabilities(_votes_input(spark, sf_dir), "cell", "p", F.max)


@register("ag12_merge_fragments", """SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS text, count(*) AS n FROM conversations GROUP BY conv_id""")
def ag12_merge_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12: the fragments of a cell joined in order."""
    return lookups.merged_text(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"])


@register("ag13_cond_probs", """WITH c AS (SELECT user_id % 10 AS x, event_type AS y, count(*) AS n FROM events GROUP BY ALL)
SELECT x, y, round(n / sum(n) OVER (PARTITION BY x), 9) AS p_y_x, round(n / sum(n) OVER (PARTITION BY y), 9) AS p_x_y FROM c""")
def ag13_cond_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("x"), F.col("event_type").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    found = e.conditional_probabilities(counts, "x", "y", "n")
    return found.select("x", "y", F.round("p_y_x", 9).alias("p_y_x"), F.round("p_x_y", 9).alias("p_x_y"))


@register("ag13_reverse_probs", """WITH c AS (SELECT user_id % 10 AS x, event_type AS y, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT x, y, n / sum(n) OVER (PARTITION BY x) AS p FROM c)
SELECT x, y, round(p / sum(p) OVER (PARTITION BY y), 8) AS p FROM p""")
def ag13_reverse_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("x"), F.col("event_type").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    found = e.conditional_probabilities(counts, "x", "y", "n").select("x", "y", F.col("p_y_x").alias("p"))
    return e.reverse_probabilities(found, "x", "y", "p").select("x", "y", F.round("p", 8).alias("p"))


@register("ag14_direction_votes", """WITH v AS (SELECT p_brand AS metric, CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS d, CASE p_size % 3 WHEN 0 THEN '0-1' WHEN 1 THEN '1-100' ELSE 'abs' END AS rng, p_partkey AS pos FROM part),
d AS (SELECT metric, sum(d)::BIGINT AS votes FROM v GROUP BY metric), r AS (SELECT metric, rng, count(*) AS n, max(pos) AS last FROM v GROUP BY ALL)
SELECT metric, votes, rng AS "range" FROM d JOIN (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY n DESC, last DESC) AS k FROM r) USING (metric) WHERE k = 1""")
def ag14_direction_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14: which way a metric goes, and its most frequent range (the one seen last of equals)."""
    part = table(spark, sf_dir, "part")
    rng = F.when(F.col("p_size") % 3 == 0, "0-1").when(F.col("p_size") % 3 == 1, "1-100").otherwise("abs")
    rows = part.select(F.col("p_brand").alias("metric"), F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("d"), rng.alias("range"), F.col("p_partkey").alias("pos"))
    return votes.directions(rows)


@register("ag15_dict_means", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def ag15_dict_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.means(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"))


_SWEEP = """x AS (SELECT round(l_discount, 2) AS lo, round(10 * l_tax, 2) AS hi, l_returnflag = 'N' AS eq, l_linestatus = 'O' AS pred, l_quantity > 20 AS gold FROM lineitem),
l AS (SELECT DISTINCT t FROM (SELECT lo AS t FROM x WHERE lo < hi UNION ALL SELECT hi FROM x WHERE lo < hi)),
c AS (SELECT lo, hi, count(*) FILTER (WHERE eq AND pred AND gold) AS tp, count(*) FILTER (WHERE pred AND (NOT eq OR NOT gold)) AS fp, count(*) FILTER (WHERE eq AND NOT pred AND NOT gold) AS tn FROM x WHERE lo < hi GROUP BY lo, hi),
s AS (SELECT a.t AS threshold1, b.t AS threshold2, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(tn), 0)::BIGINT AS tn,
 (SELECT count(*) FROM x WHERE gold) - coalesce(sum(tp), 0)::BIGINT AS fn FROM l a JOIN l b ON b.t >= a.t LEFT JOIN c ON c.lo < a.t AND c.hi >= b.t WHERE a.t < (SELECT max(t) FROM l) GROUP BY a.t, b.t),
q AS (SELECT *, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall FROM s),
f AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM q)"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.round("l_discount", 2).alias("lo"), F.round(10 * F.col("l_tax"), 2).alias("hi"), "l_returnflag", "l_linestatus", "l_quantity")
    return e.sweep(rows, "lo", "hi", F.col("l_returnflag") == "N", F.col("l_linestatus") == "O", F.col("l_quantity") > 20)


@register("ag16_threshold_sweep", f"WITH {_SWEEP} SELECT threshold1, threshold2, tp, fp, tn, fn, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM f")
def ag16_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_sweep(spark, sf_dir))


@register("ag17_best_f1", f"WITH {_SWEEP} SELECT threshold1, threshold2, tp, fp, tn, fn, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM f ORDER BY round(f1, 12) DESC, threshold1, threshold2 LIMIT 1")
def ag17_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(e.best_operating_point(_sweep(spark, sf_dir)))


@register("pf11_best_with_floor", f"WITH {_SWEEP} SELECT threshold1, threshold2, round(recall, 8) AS recall FROM f WHERE recall >= 0.01 AND f1 >= 0.005 ORDER BY round(precision, 12) DESC, threshold1, threshold2 LIMIT 1")
def pf11_best_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF11: the most precise thresholds that leave enough recall and F1."""
    return _rounded(e.best_operating_point(_sweep(spark, sf_dir), "precision", recall=0.01, f1=0.005).select("threshold1", "threshold2", "recall"))


@register("ag18_nested_counts", """SELECT o_custkey, count(*) AS papers, sum(n)::BIGINT AS tables, sum(a)::BIGINT AS leaderboards FROM
 (SELECT o_orderkey, o_custkey, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY o_custkey""")
def ag18_nested_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: counts in nested arrays of tables."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("tables"))
    nested = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return lookups.nested_counts(nested, "o_custkey", F.col("tables"), lambda x: x["l_returnflag"] == "A")


@register("ag19_noise", """WITH b AS (SELECT o_custkey, list_distinct(list(o_orderstatus)) AS a, list_distinct(list(o_orderstatus) FILTER (WHERE o_totalprice > 150000)) AS g FROM orders GROUP BY o_custkey)
SELECT round((sum(len(a)) - sum(len(list_intersect(a, coalesce(g, []))))) / sum(len(a)), 8) AS noise FROM b""")
def ag19_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.when(F.col("o_totalprice") > 150000, F.col("o_orderstatus"))).alias("g"))
    return _rounded(e.noise(sets, "a", "g"))


@register("ag20_surnames", "SELECT lower(split_part(c_name, '#', 1)) AS surname, count(*) AS n FROM customer GROUP BY 1")
def ag20_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.word_counts(table(spark, sf_dir, "customer").select(F.split_part("c_name", F.lit("#"), F.lit(1)).alias("surname")), "surname")


@register("ag21_best_experiment", """SELECT user_id AS experiment, round(value, 6) AS accuracy, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS setting FROM events ORDER BY round(value, 6) DESC, event_id LIMIT 1""")
def ag21_best_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21: the best of all runs, where the tables of some kinds of runs lack a column."""
    runs = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("experiment"), F.round("value", 6).alias("accuracy"), F.col("event_type").alias("setting"))
    some = F.col("setting").isin("click", "view")
    both = runs.where(some).unionByName(runs.where(~some).drop("setting"), allowMissingColumns=True)
    return both.agg(F.max_by(F.struct("experiment", "accuracy", "setting"), F.struct("accuracy", -F.col("event_id"))).alias("b")).select("b.*")


@register("ag22_drop_duplicates", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1")
def ag22_drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22: the first of equal rows, by an aggregation rather than a window."""
    return lookups.first_of_equals(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@register("ag23_distinct_papers", "SELECT DISTINCT o_custkey AS paper FROM orders WHERE o_orderstatus = 'F'")
def ag23_distinct_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("paper")).distinct()


@register("ag24_latest_event", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, count(*) AS n FROM events GROUP BY user_id")
def ag24_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24: what was logged last for every paper."""
    return lookups.latest(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@register("j2_three_way_sql", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, c.c_name,
 coalesce((SELECT min(o2.o_orderkey) FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_orderstatus = 'F'), -1) AS model
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE l.l_quantity > 45""")
def j2_three_way_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables, and for each row the first of related rows (an aggregate joined, no subquery per row)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    first = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("model"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    met = lines.join(orders.drop("o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return met.join(first, "o_custkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c_name", F.coalesce("model", F.lit(-1)).alias("model"))


@register("j3_annotation_lookup", """SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS owner FROM orders LEFT JOIN customer a ON a.c_custkey = o_orderkey LEFT JOIN customer b ON b.c_custkey = o_custkey""")
def j3_annotation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the exact key, else by the shorter one."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("owner"))
    return lookups.by_either_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), names, "o_orderkey", "o_custkey", "owner").select("o_orderkey", "owner")


@register("j5_texts_tables", """SELECT coalesce(d.doc_id, l.doc_id) AS paper_id, coalesce(d.lang, '') AS lang, coalesce(l.quality, -1) AS quality
FROM (SELECT * FROM documents WHERE n_chars > 300) d FULL JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id""")
def j5_texts_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with texts, tables or both."""
    texts = table(spark, sf_dir, "documents").where("n_chars > 300").select(F.col("doc_id").alias("paper_id"), "lang")
    tables = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("paper_id"), "quality")
    return lookups.texts_and_tables(texts, tables, "paper_id", {"lang": "", "quality": -1})


@register("j8_gold_by_cell", """WITH g AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag_gold FROM lineitem WHERE l_quantity > 10 GROUP BY ALL), p AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag_pred FROM lineitem WHERE l_discount < 0.08 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, flag_gold, flag_pred, flag_gold IS NOT DISTINCT FROM flag_pred AS equal FROM g FULL JOIN p USING (l_orderkey, l_linenumber)""")
def j8_gold_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted records of a cell side by side."""
    lines, cell = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    gold = lines.where("l_quantity > 10").groupBy(*cell).agg(F.min("l_returnflag").alias("flag"))
    found = lines.where("l_discount < 0.08D").groupBy(*cell).agg(F.max("l_returnflag").alias("flag"))
    return lookups.side_by_side(gold, found, cell, "flag")


@register("j12_gold_tag_zip", """WITH u AS (SELECT c_custkey, c_name FROM customer QUALIFY count(*) OVER (PARTITION BY c_name) = 1)
SELECT o.o_orderkey, u.c_name AS title, o.o_orderstatus AS gold, CASE WHEN o.o_totalprice > 100000 THEN 'F' ELSE 'O' END AS pred FROM orders o JOIN u ON o.o_custkey = u.c_custkey""")
def j12_gold_tag_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted tags of papers whose title is unique."""
    names = lookups.unique_titles(table(spark, sf_dir, "customer").select("c_name", F.col("c_custkey").alias("o_custkey")), "c_name", "o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return rows.join(names, "o_custkey").select("o_orderkey", F.col("c_name").alias("title"), F.col("o_orderstatus").alias("gold"), F.when(F.col("o_totalprice") > 100000, "F").otherwise("O").alias("pred"))


@register("ag11_vote_report", """WITH x AS (SELECT label, vec_id % 3 AS own, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS p, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM embeddings)
SELECT 'fragments' AS level, round(avg((p = y)::INT), 8) AS accuracy FROM x UNION ALL SELECT 'own', round(avg((p = y)::INT), 8) FROM x WHERE own = 0
UNION ALL SELECT 'cells', round(avg((v = y)::INT), 8) FROM (SELECT label, y, CASE WHEN 2 * sum(p) > count(*) THEN 1 ELSE 0 END AS v FROM x GROUP BY label, y)""")
def ag11_vote_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: accuracy over fragments, over those of the paper itself, and over cells by majority."""
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3 == 0).alias("own"), (F.col("embedding")[0] > 0).cast("int").alias("p"), (F.col("label") >= 5).cast("int").alias("y"))
    same = F.round(F.avg((F.col("p") == F.col("y")).cast("int")), 8).alias("accuracy")
    cells = votes.majority(rows, "label", "p", extra=["y"]).select(F.col("vote").alias("p"), "y")
    parts = [("fragments", rows), ("own", rows.where("own")), ("cells", cells)]
    out = [df.agg(same).select(F.lit(name).alias("level"), "accuracy") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("w3_score_strings", "SELECT o_orderkey, o_totalprice::DECIMAL(18,1)::VARCHAR LIKE '%.0' AS whole FROM orders")
def w3_score_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a price is whole once its score string is normalised."""
    text = F.col("o_totalprice").cast("decimal(18,1)").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", (~norm_score(text).contains(".")).alias("whole"))
