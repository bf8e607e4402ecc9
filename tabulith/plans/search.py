"""Queries of evidence search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions import text as t
from tabulith.operators import lookups
from tabulith.operators import search as s
from tabulith.registry import register, table

_WORDS = "list_filter(string_split_regex(lower(regexp_replace(text, '</?[a-zA-Z][^>]*>', ' ', 'g')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frag_id"), "source", "text")


def _phrases(spark: SparkSession, sf_dir: str, first: int, n: int) -> DataFrame:
    """Words of benchmark items as phrases."""
    words = F.slice(s.analyse(F.col("text")), first, n)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"))


@register("ev3_analyse", f"SELECT doc_id, len(list_filter({_WORDS}, lambda w: w NOT IN {s.STOP_WORDS}))::BIGINT AS n FROM documents")
def ev3_analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV3: how many words the analyser leaves."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s.analyse(F.col("text"), True)).cast("long").alias("n"))


@register("ev3_postings", f"SELECT item_id, token, pos - 1 AS pos FROM (SELECT item_id, unnest({_WORDS}) AS token, generate_subscripts({_WORDS}, 1)::INTEGER AS pos FROM benchmark)")
def ev3_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.postings(table(spark, sf_dir, "benchmark"), ["item_id"])


_EXACT = f"""w AS (SELECT doc_id, ' ' || array_to_string({_WORDS}, '  ') || ' ' AS t FROM documents),
q AS (SELECT item_id AS query_id, ' ' || array_to_string({_WORDS}[{{a}}:{{b}}], '  ') || ' ' AS p FROM benchmark)
SELECT query_id, doc_id AS frag_id, ((length(t) - length(replace(t, p, ''))) / length(p))::BIGINT AS score FROM q JOIN w ON contains(t, p)"""


@register("ev1_phrase_evidence", "WITH " + _EXACT.replace("{a}", "3").replace("{b}", "10"))
def ev1_phrase_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV1, EV2: eight words of every benchmark item in all documents, exactly (slop 0)."""
    return s.phrase_matches(_phrases(spark, sf_dir, 3, 8), _fragments(spark, sf_dir).drop("source"), 0)


_AT = "coalesce(CASE WHEN s + i {} d >= 0 THEN tokens[(s + i {} d + 1)::BIGINT] = words[(i + 1)::BIGINT] END, false)"
_SLOP = f"""WITH g AS (SELECT item_id AS query_id, {_WORDS} AS l FROM benchmark), q AS (SELECT query_id, l[3:4] || l[6:8] AS words FROM g), d AS (SELECT doc_id, {_WORDS} AS tokens FROM documents),
t AS (SELECT query_id, words, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS o FROM q), p AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM d),
f AS (SELECT token, count(*) AS df FROM p GROUP BY token), l AS (SELECT query_id, any_value(words) AS words, arg_min(token, (coalesce(df, 0), o)) AS token, arg_min(o, (coalesce(df, 0), o)) AS o FROM t LEFT JOIN f USING (token) GROUP BY query_id),
b AS (SELECT query_id, doc_id, list(pos - o) AS starts FROM l JOIN p USING (token) GROUP BY ALL),
m AS (SELECT query_id, doc_id, starts, words, tokens FROM b JOIN l USING (query_id) JOIN d USING (doc_id))
SELECT query_id, doc_id AS frag_id, len(list_filter(starts, lambda s: list_sum(list_transform(range(0, len(words)), lambda i: coalesce(list_min(list_filter([0, 1, 2], lambda d: {_AT.format('+', '+')} OR {_AT.format('-', '-')})), 3))) <= 2))::BIGINT AS score
FROM m WHERE score > 0"""


@register("ev2_slop", _SLOP)
def ev2_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV2 with slop 2: five words with the third left out of the middle of six."""
    words = s.analyse(F.col("text"))
    gapped = F.array_join(F.concat(F.slice(words, 3, 2), F.slice(words, 6, 3)), " ")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), gapped.alias("text"))
    return s.phrase_matches(asked, _fragments(spark, sf_dir).drop("source"), 2)


_BM25 = f"""w AS (SELECT doc_id, {_WORDS} AS l FROM documents), t AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(l) AS token FROM w) GROUP BY ALL),
d AS (SELECT token, count(*) AS df FROM t GROUP BY token), n AS (SELECT count(*) AS n, avg(len(l)) AS a FROM w),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}[1:6]) AS token FROM benchmark),
s AS (SELECT query_id, t.doc_id AS doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w.l) / a))) AS score FROM q JOIN t USING (token) JOIN d USING (token) JOIN w ON w.doc_id = t.doc_id CROSS JOIN n GROUP BY ALL)"""


@register("ev6_bm25", f"WITH {_BM25} SELECT query_id, doc_id AS frag_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 5")
def ev6_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV6, TK2: the five best documents for six words of every benchmark item."""
    scored = s.bm25(_phrases(spark, sf_dir, 1, 6), table(spark, sf_dir, "documents"))
    hits = scored.select("query_id", F.col("doc_id").alias("frag_id"), F.round("score", 6).alias("score"))
    return s.top_hits(hits, 5).drop("rank")


@register("ev7_paper_query", f"""WITH {_BM25} SELECT s.query_id, s.doc_id AS frag_id, round(score, 6) AS score FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE d.source = 'src0' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, s.doc_id) <= 3""")
def ev7_paper_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV7: the same search within one paper (scores stay those of the whole corpus)."""
    scored = s.bm25(_phrases(spark, sf_dir, 1, 6), table(spark, sf_dir, "documents"), within=F.col("source") == "src0")
    hits = scored.select("query_id", F.col("doc_id").alias("frag_id"), F.round("score", 6).alias("score"))
    return s.top_hits(hits, 3).drop("rank")


@register("ev8_highlight", "SELECT doc_id, regexp_replace(text, '(?i)\\b(that)\\b', '<b>\\1</b>', 'g') AS text FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text FROM documents)")
def ev8_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_text = F.regexp_replace("text", "[^\\x00-\\x7F]", "")
    return table(spark, sf_dir, "documents").select("doc_id", t.highlight(ascii_text, "that").alias("text"))


@register("ev9_evidences")
def ev9_evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV1, EV9: evidence for cells that quote benchmark items, with the limits of the online extractor."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frag_id"), F.col("source").alias("paper_id"), F.lit("").alias("header"), "text")
    words = F.array_join(F.slice(s.analyse(F.col("text")), 3, 4), " ")
    cells = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src0/t/0/"), F.col("item_id").cast("string")).alias("ext_id"), F.lit("src0").alias("paper_id"), words.alias("cell_content"), F.lit("").alias("cell_reference"))
    return s.evidences(cells, docs).drop("text")


@register("ev10_query_cache", "SELECT p_type, count(*) AS asked FROM part GROUP BY p_type")
def ev10_query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV10: equal queries are asked once and their answers joined back."""
    answered = lookups.answered_once(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", lambda keys: keys.withColumn("answer", F.sha1("p_type")))
    return answered.groupBy("p_type").agg(F.count("answer").alias("asked"))


_GRAMS = f"flatten(list_transform({_WORDS}, lambda w: flatten(list_transform([2, 3, 4], lambda n: CASE WHEN length(w) >= n THEN list_transform(range(1, length(w) - n + 2), lambda i: substr(w, i, n)) ELSE [] END))))"


def _scores_sql(name: str, queries: str, docs: str) -> str:
    """CTEs of which the last, ``name``, has field_scores() of ``queries`` (query_id, text) over the taxonomy ``docs``."""
    parts, each = [], []
    for kind, terms in (("w", _WORDS), ("g", _GRAMS)):
        parts.append(f"{name}_q{kind} AS (SELECT DISTINCT query_id, unnest({terms}) AS token FROM {queries})")
        for field, boost in s.FIELDS.items():
            x = f"{name}_{field}_{kind}"
            parts.append(f"{x} AS (SELECT id, {terms} AS l FROM (SELECT id, {field} AS text FROM {docs}))")
            parts.append(f"{x}_t AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(l) AS token FROM {x}) GROUP BY ALL)")
            each.append(f"""SELECT query_id, t.id, {boost if kind == 'w' else 1.0}::DOUBLE * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.l) / a))) AS score
            FROM {name}_q{kind} JOIN {x}_t t USING (token) JOIN (SELECT token, count(*) AS df FROM {x}_t GROUP BY token) USING (token) JOIN {x} d ON d.id = t.id CROSS JOIN (SELECT count(*) AS n, avg(len(l)) AS a FROM {x}) GROUP BY ALL""")
    parts.append(f"{name} AS (SELECT query_id, id, max(score) AS score FROM ({' UNION ALL '.join(each)}) GROUP BY ALL)")
    return ", ".join(parts)


@register("ev6_taxonomy_search", f"""WITH x AS (SELECT DISTINCT p_type AS task, p_name AS dataset, p_brand AS metric FROM part), tax AS (SELECT *, sha1(task || chr(10) || dataset || chr(10) || metric) AS id FROM x),
q AS (SELECT DISTINCT 'the ' || p_name AS query_id, 'the ' || p_name || ' ' || p_brand AS text FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1), {_scores_sql("hit", "q", "tax")},
h AS (SELECT query_id, score, task, dataset, metric, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, task, dataset, metric)::INTEGER AS rank FROM hit JOIN tax USING (id) QUALIFY rank <= 3),
o AS (SELECT DISTINCT dataset AS query_id, dataset AS text FROM h), {_scores_sql("own", "o", "tax")},
a AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, task, dataset, metric) AS nth FROM own JOIN tax USING (id)),
b AS (SELECT query_id AS dataset, max(score) AS ok, max(score) FILTER (WHERE nth = 2) AS bad FROM a WHERE nth <= 2 GROUP BY 1)
SELECT h.query_id, rank, task, h.dataset, metric, round(score / (2 * len(regexp_extract_all(q.text, '[^a-zA-Z0-9]')) + 1) * coalesce((ok - bad) / bad / (ok / (2 * len(regexp_extract_all(h.dataset, '[^a-zA-Z0-9]')) + 1)), 1), 6) AS confidence
FROM h JOIN b ON b.dataset = h.dataset JOIN q ON q.query_id = h.query_id""")
def ev6_taxonomy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV6: parts as a taxonomy; names with a brand of theirs as mentions, by boosted words and n-grams of three fields."""
    part = table(spark, sf_dir, "part")
    taxonomy = part.select(F.col("p_type").alias("task"), F.col("p_name").alias("dataset"), F.col("p_brand").alias("metric"))
    # one brand for each name: the mentions are names, not parts
    named = part.groupBy("p_name").agg(F.min_by("p_brand", "p_partkey").alias("p_brand"))
    mentions = named.select(F.concat(F.lit("the "), "p_name").alias("query_id"), F.concat(F.lit("- the "), "p_name", F.lit(" Dataset"), "p_brand", F.lit(", ")).alias("text"), F.lit("").alias("caption"))
    mentions = mentions.withColumn("text", F.regexp_replace("text", " Dataset", " dataset"))
    found = s.taxonomy_search(mentions, taxonomy)
    return found.select("query_id", "rank", "task", "dataset", "metric", F.round("confidence", 6).alias("confidence"))
