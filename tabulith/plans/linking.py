"""Queries of taxonomy linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.operators import dictionaries, lookups
from tabulith.operators import linking as k
from tabulith.plans import flagship
from tabulith.registry import register, table

_PAIRS = "SELECT DISTINCT w[1] || ' ' || w[2] AS name FROM (SELECT list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM benchmark)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of benchmark items as names to be found."""
    words = F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "")
    return table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", words[0], words[1]).alias("name")).distinct()


@register("lk1_evidence_names", """WITH n AS (SELECT DISTINCT p_type AS name FROM part), f AS (SELECT name, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS whole FROM n),
w AS (SELECT name, whole, list_filter(string_split(whole, ' '), lambda x: x NOT IN ('a','an','and','for','in','of','on','the','to','with','by','using') AND x <> '') AS words FROM f)
SELECT DISTINCT name, unnest([whole] || CASE WHEN len(words) > 1 THEN words ELSE [] END || ['test']) AS evidence FROM w""")
def lk1_evidence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK1: the evidences of names (part types as datasets)."""
    return k.evidence_names(table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct(), "dataset")


@register("lk2_abbreviations", """WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, lower(name) AS whole, string_split(lower(name), ' ') AS words FROM n),
a AS (SELECT * FROM (VALUES ('bolt', 'screw'), ('cold', 'low temperature'), ('nothing', 'void')) AS v(short, long))
SELECT DISTINCT name, unnest([whole] || words) AS evidence FROM w UNION SELECT name, long FROM w JOIN a ON list_contains(words, short)""")
def lk2_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK2: expansions of abbreviations in names (names of parts as metrics)."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    short = spark.createDataFrame([("bolt", "screw"), ("cold", "low temperature"), ("nothing", "void")], "short string, long string")
    return k.evidence_names(names, "metric", short)


@register("lk4_find_names", f"""WITH n AS ({_PAIRS}), c AS (SELECT replace(name, ' ', '') AS key, max(name) AS name FROM n GROUP BY 1),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS l FROM documents),
r AS (SELECT doc_id, array_to_string(l[i:i + m - 1], '') AS key FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(l))
SELECT doc_id AS text_id, name, count(*) AS n FROM r JOIN c USING (key) GROUP BY ALL""")
def lk4_find_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK4: names in every document, whatever their spaces."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return k.find_names(texts, _names(spark, sf_dir))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as mentions: (query, context, evidence, n)."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("query"), (F.col("event_id") % 5).cast("int").alias("context"), F.col("event_type").alias("evidence"))
    return rows.groupBy("query", "context", "evidence").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = "c AS (SELECT user_id % 40 AS query, (event_id % 5)::INTEGER AS context, event_type AS evidence, count(*) AS n FROM events GROUP BY ALL)"
_NAMES = [("buy", "click"), ("buy", "purchase"), ("join", "signup"), ("join", "click"), ("look", "view"), ("fail", "error")]
_NAMES_SQL = "e AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{x}')" for n, x in _NAMES) + ") AS v(name, evidence))"
_P = """o AS (SELECT name, evidence, 1.0 / count(*) OVER (PARTITION BY evidence) AS p FROM e), p AS (SELECT name, evidence, p / sum(p) OVER (PARTITION BY name) AS p FROM o)"""


def _evidences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_NAMES, "name string, evidence string")


@register("lk7_likelihoods", """WITH c AS (SELECT p_brand AS name, lower(string_split(p_type, ' ')[1]) AS evidence, count(*) AS n FROM part GROUP BY ALL),
o AS (SELECT name, evidence, n / sum(n) OVER (PARTITION BY evidence) AS p FROM c) SELECT name, evidence, round(p / sum(p) OVER (PARTITION BY name), 9) AS p FROM o""")
def lk7_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK7: the probability of an evidence (a type's first word) given a name (a brand)."""
    evidences = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.split("p_type", " ")[0].alias("evidence"))
    return k.likelihoods(evidences).select("name", "evidence", F.round("p", 9).alias("p"))


_NOISE = "CASE context WHEN 0 THEN 0.99 WHEN 3 THEN 0.25 WHEN 4 THEN 0.01 ELSE 1.0 END"
_AXIS = f"""{_COUNTS}, {_NAMES_SQL}, {_P}, m AS (SELECT DISTINCT name FROM e),
s AS (SELECT query, m.name, sum(least(n, 3) * ln({_NOISE}::DOUBLE * 0.01::DOUBLE + (1::DOUBLE - {_NOISE}::DOUBLE) * coalesce(p.p, 0)::DOUBLE)) AS logp FROM c CROSS JOIN m LEFT JOIN p ON p.name = m.name AND p.evidence = c.evidence GROUP BY ALL)"""


def _noise() -> Column:
    return F.array(*map(F.lit, k.NOISE["dataset"]))[F.col("context")]


def _axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidences = _evidences(spark)
    return k.axis_scores(_counts(spark, sf_dir), evidences, k.likelihoods(evidences), _noise(), 0.01, 3)


@register("lk8_axis_loglik", f"WITH {_AXIS} SELECT query, name, round(logp, 6) AS logp FROM s")
def lk8_axis_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK8: log-likelihoods of names, over five contexts with their noises."""
    return _axis(spark, sf_dir).select("query", "name", F.round("logp", 6).alias("logp"))


@register("lk10_softmax", f"WITH {_AXIS}, x AS (SELECT *, exp(logp - max(logp) OVER (PARTITION BY query)) AS e FROM s) SELECT query, name, round(e / sum(e) OVER (PARTITION BY query), 6) AS confidence FROM x")
def lk10_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK10: confidences on one axis."""
    return k.softmax_by_query(_axis(spark, sf_dir), ["name"]).select("query", "name", F.round("confidence", 6).alias("confidence"))


_TAXONOMY = [("buy", "join", "look"), ("buy", "look", "fail"), ("join", "buy", "look"), ("look", "fail", "buy")]
_TAX_SQL = "t AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in _TAXONOMY) + ") AS v(task, dataset, metric))"


@register("lk11_topk", f"""WITH {_AXIS}, {_TAX_SQL}, j AS (SELECT a.query, task, dataset, metric, a.logp + b.logp + c2.logp AS lp FROM t JOIN s a ON a.name = task JOIN s b ON b.name = dataset AND b.query = a.query JOIN s c2 ON c2.name = metric AND c2.query = a.query),
x AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY query)) AS e FROM j), y AS (SELECT query, task, dataset, metric, e / sum(e) OVER (PARTITION BY query) AS confidence, 0 AS lone FROM x),
b AS (SELECT query, arg_max(name, (round(logp, 9), name)) AS name FROM s GROUP BY query), z AS (SELECT * FROM y UNION ALL SELECT query, name, name, name, 0.79, 1 FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(confidence, 9) DESC, lone, task, dataset, metric)::INTEGER AS rank FROM z)
SELECT query, rank, task, dataset, metric, round(confidence, 6) AS confidence FROM r WHERE rank <= 3""")
def lk11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK9 to LK11, TK1: the three best taxonomy rows of every query, the independent one among them."""
    counts = _counts(spark, sf_dir)
    gains = k.axis_gains(counts, k.likelihoods(_evidences(spark)), _noise(), 0.01, 3)
    taxonomy = spark.createDataFrame(_TAXONOMY, "task string, dataset string, metric string")
    found = k.link(counts, {a: gains for a in k.AXES}, taxonomy, 3)
    return found.select("query", "rank", *k.AXES, F.round("confidence", 6).alias("confidence"))


_RUNS = """w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS l FROM documents),
r AS (SELECT doc_id, array_to_string(l[i:i + m - 1], '') AS key FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(l))"""


@register("lk5_contexts", f"""WITH n AS ({_PAIRS}), one AS (SELECT DISTINCT split_part(name, ' ', 1) AS name FROM n), {_RUNS},
a AS (SELECT 'task' AS axis, name FROM one UNION ALL SELECT 'metric', name FROM n UNION ALL SELECT DISTINCT 'dataset', name FROM (SELECT name FROM n UNION SELECT name FROM one)),
c AS (SELECT axis, replace(name, ' ', '') AS key, max(name) AS name FROM a GROUP BY 1, 2), f AS (SELECT doc_id, axis, name, count(*) AS n FROM r JOIN c USING (key) GROUP BY ALL),
o AS (SELECT *, CASE WHEN axis = 'dataset' THEN n - coalesce(sum(n) FILTER (WHERE axis <> 'dataset') OVER (PARTITION BY doc_id, name), 0) ELSE n END::BIGINT AS left_n FROM f)
SELECT doc_id AS text_id, axis, replace(name, ' ', '') AS evidence, left_n AS n FROM o WHERE left_n > 0""")
def lk5_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK5, LK6: mentions in every document by axis, datasets less the rest."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    names = _names(spark, sf_dir).select(F.col("name").alias("evidence"))
    single = names.select(F.split("evidence", " ")[0].alias("evidence"))
    return k.context_counts(texts, {"task": single, "dataset": names.union(single), "metric": names})


@register("lk12_cell_proposals", """WITH r AS (SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS row, * FROM lineitem)
SELECT paper_id, row, col, CASE col WHEN 1 THEN l_quantity::BIGINT::VARCHAR || '%' ELSE l_partkey::VARCHAR END AS value, ['Ours ' || row] AS models, ['Set ' || col || (paper_id % 5)] AS datasets
FROM r, (SELECT unnest([1, 2]) AS col)""")
def lk12_cell_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK12: every order as a table of models and two data sets: its numeric cells with what stands before them."""
    rows = k.cell_proposals(flagship.order_tables(spark, sf_dir, "Set"), ["paper_id", "table_name"])
    return rows.select("paper_id", "row", "col", "value", F.transform("model_values", lambda v: v["value"]).alias("models"), F.transform("dataset_values", lambda v: v["value"]).alias("datasets"))


@register("f28_complements", """WITH t AS (SELECT DISTINCT p_brand AS task, p_type AS dataset, ['Accuracy', 'Error', 'F1', 'Top-5 Error'][p_size % 4 + 1] AS metric FROM part),
c AS (SELECT * FROM (VALUES ('accuracy', 'Error'), ('error', 'Accuracy'), ('top-5 error', 'Top-5 Accuracy')) AS v(m, complement)),
x AS (SELECT task, dataset, complement AS metric, metric AS true_metric FROM t JOIN c ON lower(metric) = m)
SELECT *, metric AS true_metric FROM t UNION SELECT * FROM x ANTI JOIN t USING (task, dataset, metric)""")
def f28_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a taxonomy of parts with the complements of its metrics."""
    metric = F.element_at(F.array(*map(F.lit, ("Accuracy", "Error", "F1", "Top-5 Error"))), (F.col("p_size") % 4 + 1).cast("int"))
    taxonomy = table(spark, sf_dir, "part").select(F.col("p_brand").alias("task"), F.col("p_type").alias("dataset"), metric.alias("metric")).distinct()
    return k.complement_metrics(taxonomy, dictionaries.complements(spark))


@register("lk15_acronyms", """SELECT p_partkey AS text_id, upper(w[1][1] || w[2][1]) AS short, array_to_string(w, ' ') AS long FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part) WHERE p_partkey % 2 = 0""")
def lk15_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK15: names of parts with their initials, or with letters that aren't."""
    words = F.split(F.lower("p_name"), " ")
    initials = F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))
    short = F.when(F.col("p_partkey") % 2 == 0, initials).otherwise("QZX")
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("text_id"), F.concat(F.lit("We use "), F.array_join(words, " "), F.lit(" ("), short, F.lit(") here (XY).")).alias("text"))
    return k.acronyms(texts)


@register("f29_dictionary", "SELECT DISTINCT p_brand AS name, lower(split_part(p_type, ' ', 1)) AS evidence FROM part WHERE lower(split_part(p_type, ' ', 1)) NOT IN ('a', 'the')")
def f29_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a manual dictionary as a table, stop words left out."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("evidence"))
    return rows.where(~F.col("evidence").isin("a", "the")).distinct()


@register("lk3_index_keys", f"SELECT replace(name, ' ', '') AS key, max(name) AS name FROM ({_PAIRS}) GROUP BY 1")
def lk3_index_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LK3: names by their form without spaces; one name a key."""
    return lookups.index_keys(_names(spark, sf_dir))


_BEST = """WITH r AS (SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS row, * FROM lineitem),
c AS (SELECT paper_id, row, col, CASE col WHEN 1 THEN l_quantity::BIGINT::DOUBLE ELSE l_partkey::DOUBLE END AS score, 'Ours ' || row AS model, 'p' || paper_id || '/t/' || row || '.' || col AS id FROM r, (SELECT unnest([1, 2]) AS col)),
b AS (SELECT *, first_value(id) OVER (PARTITION BY paper_id, col ORDER BY score DESC, id) AS best FROM c)"""


@register("ud8_flagship", f"""{_BEST} SELECT 'p' || paper_id AS paper_id, CASE col WHEN 1 THEN 'Squad' ELSE 'Treebank' END AS dataset, CASE col WHEN 1 THEN 'Fscore' ELSE 'Bleu' END AS metric,
CASE col WHEN 1 THEN 'Answering' ELSE 'Parsing' END AS task, model, score FROM b WHERE id = best""")
def ud8_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD8: every order as a paper with one table: from its cells, its text and a taxonomy to the results that leaderboards keep."""
    return flagship.order_results(spark, sf_dir)


@register("ud6_explanations", f"{_BEST} SELECT id AS cell_ext_id, CASE WHEN id <> best THEN 'replaced by ' || best END AS reason FROM b")
def ud6_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD6: why a cell is no result."""
    return flagship.order_proposals(spark, sf_dir).select("cell_ext_id", "reason")


@register("ud2_linker", "SELECT o_orderkey AS cell_ext_id, upper(o_orderpriority) AS dataset, 'by name' AS linker FROM orders WHERE o_orderstatus <> 'P'")
def ud2_linker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD2, LK14: a linker put together of an extractor (priorities of orders as data sets) and a linking function."""

    def extract(papers: DataFrame) -> DataFrame:
        return papers.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("cell_ext_id"), F.upper("o_orderpriority").alias("dataset"))

    linker = k.Linker("by name", lambda proposals, found: proposals.join(found, "cell_ext_id"), extract)
    orders = table(spark, sf_dir, "orders")
    return linker(orders.select(F.col("o_orderkey").alias("cell_ext_id")), orders).withColumn("linker", F.lit(linker.name))
