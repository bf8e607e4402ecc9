"""Queries of the scalar functions: strings, numbers, arrays, maps, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions import text as t
from tabulith.functions import values as v
from tabulith.operators import lookups
from tabulith.registry import register, table


def _rows(spark: SparkSession, sf_dir: str, items: list[str]) -> DataFrame:
    """id and s for every order: one of ``items`` in turn, with numbers of the order in place of {} and its priority's name in place of @."""
    chosen = F.element_at(F.array(*map(F.lit, items)), (F.col("o_orderkey") % len(items) + 1).cast("int"))
    number = F.format_string("%d.%d", F.col("o_orderkey") % 97, F.col("o_custkey") % 10)
    named = F.replace(F.replace(chosen, F.lit("{}"), number), F.lit("@"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), named.alias("s"))


def _sql_rows(items: list[str]) -> str:
    listed = ", ".join("'{}'".format(x.replace("'", "''")) for x in items)
    return (
        f"(SELECT o_orderkey AS id, replace(replace([{listed}][(o_orderkey % {len(items)}) + 1], '{{}}', (o_orderkey % 97)::VARCHAR || '.' || (o_custkey % 10)::VARCHAR), "
        "'@', lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g'))) AS s FROM orders) AS s"
    )


def _ascii(column: str) -> Column:
    """What both engines transliterate alike: nothing but ASCII."""
    return F.regexp_replace(column, "[^\\x00-\\x7F]", "")


_SQL_ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', '', 'g')"
_DOC = "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS s FROM documents"
_DROP = "regexp_replace(s, 'xxref-[^ ]*|(?:xxtable-)?xxanchor-[^ ]*', '', 'g')"


def _per_document(name: str, sql_expr: str, make) -> None:
    """A query of one function of every document's ASCII text, and its SQL (an expression of s)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", _ascii("text").alias("s"))
        return docs.select("doc_id", make(F.col("s")).alias("value"))

    query.__doc__ = f"{name} over every document."
    register(name, f"SELECT doc_id, {sql_expr} AS value FROM ({_DOC})")(query)


_per_document("f1_norm_ws", f"lower(trim(regexp_replace(regexp_replace(regexp_replace({_DROP}, '[-_''`]', ' ', 'g'), '20([0-9][0-9])', '\\1', 'g'), '\\s+', ' ', 'g')))", t.norm_dataset_ws)
_per_document("f2_norm", f"lower(trim(regexp_replace(regexp_replace(regexp_replace({_DROP}, '20([0-9][0-9])', '\\1', 'g'), '[-_''`]', '', 'g'), '\\s+', ' ', 'g')))", t.norm_dataset)
_per_document("f3_norm_cell", "regexp_replace(s, '[^a-zA-Z0-9]', '', 'g')", t.norm_cell)
_per_document("f4_clean_name", "trim(regexp_replace(trim(s), '\\([^)]*?\\)|\\[[^\\]]*?\\]', '', 'g'))", t.clean_name)
_per_document("f5_drop_mentions", _DROP, t.drop_mentions)
_per_document("f6_query_cell", "trim(regexp_replace(regexp_replace(s, '\\[[^\\]]*\\]', '', 'g'), '\\([^)]*\\)', '', 'g'))", t.query_cell)
_per_document("f18_just_letters", "trim(regexp_replace(s, '[^a-zA-Z]+', ' ', 'g'))", t.just_letters)
_per_document("f18_until_sign", "regexp_extract(s, '^[a-zA-Z0-9 ]*', 0)", t.until_first_sign)
_per_document("f23_tokenize", "list_filter(string_split_regex(trim(regexp_replace(regexp_replace(s, '([!-/:-@\\[-`{-~])', ' \\1 ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')", t.tokenize)
_per_document("f26_sha1", "sha1(s)", F.sha1)
_per_document("tb12_clear_spaces", "trim(regexp_replace(s, '[\\r\\n]+|\\s{2,}', ' ', 'g'))", t.clear_spaces)
_per_document("tx3_simple_anchor", "replace(s, '.', '')", t.simple_anchor)
_per_document("tx5_clean_abstract", "regexp_replace('Abstract ' || s, '^\\s*[aA]bstract ?', '')", lambda c: t.clean_abstract(F.concat(F.lit("Abstract "), c)))
_per_document("f24_split_sentences", "len(string_split(s, chr(10)))::BIGINT", lambda c: F.size(F.split(c, "\n")).cast("long"))
_per_document(
    "f25_fold_tokens",
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(xxref|xxanchor)-[a-zA-Z0-9_-]*', '\\1 ', 'g'), '(^|[ ])[0-9]+\\.[0-9]+(\\b|%)', ' xxnum ', 'g'), '(^|[ ])[0-9]+(\\b|%)', ' xxnum ', 'g'), '\\bdata set\\b', ' dataset ', 'g')",
    t.fold_tokens,
)


_REFS = ["see (?) for {}", "as in ? ? done @", "what? no", "end {} ?", "(?)(?)@", "plain {}"]


@register("f7_fix_refs", "SELECT id, {0} AS value FROM {1}".format(
    "regexp_replace(regexp_replace(s, '\\(\\?\\)|\\s[?]+(\\s|$)', ' xref-unkown ', 'g'), '\\(\\?\\)|\\s[?]+(\\s|$)', ' xref-unkown ', 'g')", _sql_rows(_REFS)))
def f7_fix_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _REFS).select("id", t.fix_refs(F.col("s")).alias("value"))


_LIGHTS = ["a <b>xxref</b>-bib1 {} b", "<b>xxref</b>-<b>bib@</b>", "<b>model</b> @ here", "none {}"]


@register("f8_fix_highlight", "SELECT id, replace(replace(replace(replace(s, '<b>xxref</b>-<b>', chr(1)), '<b>xxref</b>-', 'xxref-'), chr(1), '<b>xxref</b>-<b>'), chr(1), '') AS value,"
          " regexp_replace(s, '</?b>', '', 'g') AS plain FROM " + _sql_rows(_LIGHTS))
def f8_fix_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _LIGHTS).select("id", t.fix_highlight(F.col("s")).alias("value"), t.strip_highlight(F.col("s")).alias("plain"))


_NUMBER_SQL = "[+-]?(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


@register("f9_numbers", f"SELECT doc_id, regexp_extract_all(text, '{_NUMBER_SQL}') AS numbers FROM documents")
def f9_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of every document by the grammar."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(v.NUMBER), F.lit(0)).alias("numbers"))


@register("f11_extract_value", f"""
SELECT doc_id, word, TRY_CAST(nullif(regexp_extract(trim(translate(replace(word, ',', ''), '()', '  ')), '^({_NUMBER_SQL})', 1), '') AS DECIMAL(30,10))::DOUBLE AS value
FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS word FROM documents)
WHERE regexp_matches(word, '[0-9]') AND length(word) < 18""")
def f11_extract_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of every word with a digit."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[ \\n]")).alias("word"))
    words = words.where(F.col("word").rlike("[0-9]") & (F.length("word") < 18))
    return words.select("doc_id", "word", v.extract_value(F.col("word")).cast("double").alias("value"))


_RAW = ["{}%", "{}", "0{}", "{} %", "{} ± 0.4", "({})", "-{}", "1,{}", "@ {}", "21%", "0.21", "21", "0.21%", "12.3 ± 0.4", "± 0.4", "1,234.5", "(93.1)", "21 %", "1e-3", "-5%", "1", ".5", "0", "100", "150", "-", ""]
_VALUE_SQL = f"""WITH s AS (SELECT * FROM {_sql_rows(_RAW)}), r AS (SELECT * FROM (VALUES ('0-1'), ('1-100'), ('abs'), ('')) AS r(rng)),
c AS (SELECT * FROM (VALUES (true), (false)) AS c(flip)),
k AS (SELECT id, s, contains(s, '%') AS pct, trim(translate(replace(regexp_replace(s, '\\s+%', '%', 'g'), ',', ''), '()', '  ')) AS clean FROM s),
p AS (SELECT id, s, pct, TRY_CAST(nullif(regexp_extract(clean, '^({_NUMBER_SQL})' || CASE WHEN pct THEN '%' ELSE '' END, 1), '') AS DOUBLE) AS x FROM k),
f AS (SELECT p.*, rng, flip, CASE WHEN NOT flip THEN x WHEN pct OR (x > 1 AND x < 100) THEN 100 - x ELSE 1 - x END AS y FROM p, r, c),
g AS (SELECT *, CASE WHEN NOT pct AND y > 0 AND y < 1 THEN y * 100 ELSE y END AS q FROM f)
SELECT id, rng, flip, round(CASE rng WHEN '0-1' THEN q / 100 WHEN '1-100' THEN q WHEN 'abs' THEN (CASE WHEN pct THEN y / 100 ELSE y END) ELSE y END, 8) AS value FROM g"""


@register("f12_metric_convert", _VALUE_SQL)
def f12_metric_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw value in every range, plain and complemented."""
    cases = _rows(spark, sf_dir, _RAW).withColumn("rng", F.explode(F.array(*map(F.lit, ("abs", "1-100", "0-1", "")))))
    cases = cases.withColumn("flip", F.explode(F.array(F.lit(True), F.lit(False))))
    return cases.select("id", "rng", "flip", F.round(v.convert_metric(F.col("s"), F.col("rng"), F.col("flip")).cast("double"), 8).alias("value"))


_PM = ["{} ± 0.3", "{}%", "3.5 ±{} %", "a 4 b {}%", "@ .5e1 {}"]
_PM_SQL = "(±?)([+-]?\\s*(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\\s*(%?)"


@register("f13_plus_minus", f"""SELECT id, list_transform(list_filter(regexp_extract_all(s, '{_PM_SQL}'), lambda m: NOT starts_with(m, '±')),
lambda m: regexp_replace(m, '[\\s%]', '', 'g')::DOUBLE / CASE WHEN contains(m, '%') THEN 100 ELSE 1 END) AS value FROM {_sql_rows(_PM)}""")
def f13_plus_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _PM).select("id", v.plus_minus_values(F.col("s")).alias("value"))


_SCORES = ["93.9999999", "0.8499999", "90.0", "-0.0", "12", "0.5", "99.99999", "-1.999999", "100", "0.100", "{}0", "{}", "{}399999"]


@register("f14_score_norm", f"""WITH r AS (SELECT * FROM {_sql_rows(_SCORES)}), w AS (SELECT id, CASE WHEN regexp_matches(s, '^[+-]?[0-9]+\\.9{{5,}}$') THEN
  regexp_extract(s, '^([+-]?)', 1) || (regexp_extract(s, '^[+-]?([0-9]+)', 1)::BIGINT + 1)::VARCHAR
  WHEN regexp_matches(s, '\\.[0-9]*[0-8]9{{5,}}$') THEN regexp_replace(s, '[0-8]9+$', '') || (regexp_extract(s, '([0-8])9+$', 1)::INTEGER + 1)::VARCHAR ELSE s END AS s FROM r),
z AS (SELECT id, regexp_replace(CASE WHEN contains(s, '.') THEN regexp_replace(s, '0+$', '') ELSE s END, '\\.$', '') AS s FROM w) SELECT id, CASE WHEN s = '-0' THEN '0' ELSE s END AS value FROM z""")
def f14_score_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score strings with what floating point leaves at their ends."""
    return _rows(spark, sf_dir, _SCORES).select("id", v.norm_score(F.col("s")).alias("value"))


@register("f14_prices", "SELECT o_orderkey, regexp_replace(regexp_replace(x, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS value FROM (SELECT o_orderkey, round(o_totalprice, 2)::DECIMAL(18,2)::VARCHAR AS x FROM orders)")
def f14_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", v.norm_score(price).alias("value"))


_IDS = ["1602.01234v2", "16{}", "cs/0112017v11", "v1", "", "16{}v3", "@v12"]


@register("f15_version_strip", f"SELECT id, regexp_replace(s, 'v[0-9]+$', '') AS value FROM {_sql_rows(_IDS)}")
def f15_version_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _IDS).select("id", t.strip_version(F.col("s")).alias("value"))


_CITES = ["J. Doe. A title. arXiv preprint arXiv:1602.01234v1, 2016.", "https://arxiv.org/abs:1701.00001", "CoRR abs/1503.02531", "no id here {}", "@: arXiv:1602.0{}", "abs/19{}12345v2 @"]


@register("f16_arxiv_id", f"""SELECT id, nullif(regexp_extract(s, '[:/]([12][0-9]{{3}}\\.[0-9]{{4,5}})', 1), '') AS arxiv_id FROM {_sql_rows(_CITES)}""")
def f16_arxiv_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _CITES).select("id", t.arxiv_id(F.col("s")).alias("arxiv_id"))


@register("f17_title_key", "SELECT item_id, array_to_string(string_split_regex(lower(s), '[ !\"$%&''*+,\\n\\t;<=>@^_`{|}~-]+'), '-') AS value FROM"
          " (SELECT item_id, regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g') AS s FROM benchmark)")
def f17_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("text", "[^a-zA-Z0-9 ]", " ")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(t.title_tokens(plain), "-").alias("value"))


_TITLES = ["Deep @ nets for all. In Proceedings of X, 2015", "A study. NIPS 2014. Long title of the @ paper here", "Single @ part only."]


@register("f19_title_score", f"SELECT id, s AS value FROM {_sql_rows(['Deep @ nets for all', 'Long title of the @ paper here', 'Single @ part only'])}")
def f19_title_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _TITLES).select("id", t.best_title_part(F.col("s")).alias("value"))


@register("f21_short_names", "SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda n: upper(n[1]) || '.'), ' ') AS value FROM part")
def f21_short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initials of the words of part names."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), t.short_names(F.split("p_name", " ")).alias("value"))


@register("f22_nested_pop", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, [json_extract_string(props, '$.k')] AS listed FROM events")
def f22_nested_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value below a path, and scalars as lists of one."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array(F.get_json_object("props", "$.k")).alias("listed"))


_SAID = ["we use our model on @", "dataset of xxref-" + "a" * 40, "the data set @ of {}", "@ model xxref-" + "0b" * 20, "plain {}"]


@register("f27_type_flags", f"""SELECT id, array_to_string(list_filter([CASE WHEN contains(s, 'high') THEN 'exact' END, CASE WHEN contains(s, 'model') THEN 'model' END, CASE WHEN contains(s, 'our') THEN 'model-best' END,
CASE WHEN contains(s, 'dataset') OR contains(s, 'data set') THEN 'dataset' END, CASE WHEN regexp_matches(s, 'xxref-[a-zA-Z0-9_]{{40}}') THEN 'external' END, CASE WHEN regexp_matches(s, 'xxref-[a-zA-Z0-9_]{{40}}') THEN 'external?' END], lambda f: f IS NOT NULL), ' ') AS value FROM {_sql_rows(_SAID)}""")
def f27_type_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return _rows(spark, sf_dir, _SAID).select("id", t.type_flags(s, s, F.lit("high")).alias("value"))


@register("f31_argmax", """
SELECT vec_id, CASE WHEN m <= 0.5 THEN 2 ELSE list_position(p, m) - 1 END::BIGINT AS type FROM (
  SELECT vec_id, p, list_max(p) AS m FROM (SELECT vec_id, list_transform(embedding[1:2], lambda x: abs(x)) AS p FROM embeddings))""")
def f31_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the largest class probability, the last index if none reaches the threshold."""
    p = F.transform(F.slice("embedding", 1, 2), F.abs)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    return rows.select("vec_id", threshold_argmax(F.col("p"), 0.5).alias("type"))


def threshold_argmax(p: Column, threshold: float) -> Column:
    """argmax of the probabilities with a class of constant probability after them (the first of equals)."""
    top = F.array_max(p)
    return F.when(top >= F.lit(threshold), F.array_position(p, top) - 1).otherwise(F.size(p)).cast("long")


@register("f32_proposal_names", """
SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'A' THEN 'model-competing' ELSE 'model-best' END, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS tags,
       CASE WHEN bool_or(l_returnflag = 'A') THEN 'model-competing' ELSE 'model-best' END AS model_type
FROM lineitem GROUP BY l_orderkey""")
def f32_proposal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of model of a proposal: competing if any value says so, else the first one."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "A", "model-competing").otherwise("model-best").alias("tag")).alias("v"))
    tags = F.transform(F.sort_array(F.collect_list("v")), lambda x: x["tag"])
    listed = rows.groupBy("l_orderkey").agg(tags.alias("t"))
    return listed.select("l_orderkey", F.array_join("t", " ").alias("tags"), lookups.model_type(F.col("t")).alias("model_type"))


@register("f33_query_key", """
SELECT user_id, string_agg(event_type || ':' || n, ';' ORDER BY event_type) AS key FROM
 (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def f33_query_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag as one string, whatever the order of its items."""
    return lookups.bag_key(table(spark, sf_dir, "events"), "user_id", "event_type")


_CAMEL = ["cellsSotaRecords", "goldTags", "arxivId", "tableSet", "plain", "@Set", "my@Records"]


@register("pf10_case_names", f"""SELECT id, lower(regexp_replace(regexp_replace(s, '(.)([A-Z](?:[a-z]+))', '\\1_\\2', 'g'), '([0-9a-z])([A-Z])', '\\1_\\2', 'g')) AS snake, s AS camel FROM {_sql_rows(_CAMEL)}""")
def pf10_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, _CAMEL).select("id", t.snake_case(F.col("s")).alias("snake"))
    return rows.select("id", "snake", t.camel_case(F.col("snake")).alias("camel"))


_CELLS = ["Ours <ref id='bib-bib7'>7</ref>", "<bold>93.1%</bold>", "<bold> </bold>x</bold><bold>y", "A <ref id='b-1'> Li et al </ref> (<ref id='b'>2</ref>)", "<red>1</red> ( )", "<bold>{}</bold> @", "@ <ref id='bib-@'> {} </ref>", "<bold>{}</bold> <bold>@</bold>"]


@register("tb15_clear_styles", f"""SELECT id, trim(regexp_replace(regexp_replace(s, '<bold>(\\s*)</bold>', '\\1', 'g'), '</bold>(\\s*)<bold>', '\\1', 'g')) AS value FROM {_sql_rows(_CELLS)}""")
def tb15_clear_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _CELLS).select("id", t.clear_styles(F.col("s")).alias("value"))


@register("tb19_cell_build", f"""
SELECT id, list_transform(regexp_extract_all(s, '<ref id=''([^'']*)''>(.*?)</ref>', 1), lambda r: replace(r, '-', '')) AS refs,
  regexp_replace(regexp_replace(regexp_replace(s, '<ref id=''[^'']*''>\\s*([0-9]+)\\s*</ref>', '\\1', 'g'), '<ref id=''[^'']*''>\\s*(.*?)\\s*</ref>', '[\\1]', 'g'), '</?(red|green|blue|bold|italic)>', '', 'g') AS value,
  regexp_replace(regexp_replace(s, '<ref id=''([^'']*)''>(.*?)</ref>', '', 'g'), '\\(\\s*\\)|\\[\\s*\\]', '', 'g') AS bare
FROM {_sql_rows(_CELLS)}""")
def tb19_cell_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TB19 to TB22: references, value and text without references of raw cells."""
    s = F.col("s")
    return _rows(spark, sf_dir, _CELLS).select("id", t.references_in(s).alias("refs"), t.cell_value(s).alias("value"), t.remove_references(s).alias("bare"))


_KEYS = ["Table 3: Results on SQuAD @", "figure 12 . Loss-curves {}", "No prefix, here! @", " TABLE {}.1 @ table 2"]


@register("tb30_match_key", f"SELECT id, regexp_replace(regexp_replace(lower(s), '^\\s*(table|figure)\\s+[0-9]+(\\.[0-9]+)*\\s*[.:]?\\s*', ''), '[^a-z0-9]+', '', 'g') AS value FROM {_sql_rows(_KEYS)}")
def tb30_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _KEYS).select("id", t.match_key(F.col("s")).alias("value"))


_FLAT = ["see ( xxref-S1T1 )  now {}", "xxanchor-@  text", " many \n spaces @ ", "[xxanchor-@] and (xxref-a-b) {}", "plain  {}"]


@register("tx4_flat_text", f"SELECT id, trim(regexp_replace(regexp_replace(s, '[ \\n]+', ' ', 'g'), '[(\\[]\\s*((?:xxref|xxanchor)-[a-zA-Z0-9_-]+)\\s*[)\\]]', '\\1', 'g')) AS value FROM {_sql_rows(_FLAT)}")
def tx4_flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of elements made flat (repeated anchors are in the tests: SQL has no back-references)."""
    return _rows(spark, sf_dir, _FLAT).select("id", t.flat_text(F.col("s")).alias("value"))


@register("sc3_nested_json", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def sc3_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("ev5_char_ngrams", """
WITH w AS (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS s FROM part)
SELECT p_partkey, n, i, substr(s, i, n) AS gram FROM w, (SELECT unnest([2,3,4])::INTEGER AS n), (SELECT unnest(range(1, 30))::INTEGER AS i) WHERE i <= length(s) - n + 1""")
def ev5_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV5: character n-grams of the first word of part names, with length and place."""
    word = F.lower(F.split("p_name", " ")[0])
    rows = table(spark, sf_dir, "part").select("p_partkey", word.alias("s"))
    sized = rows.withColumn("n", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))))
    return sized.where(F.length("s") >= F.col("n")).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("s") - F.col("n") + 1))).select("p_partkey", "n", "i", F.substr("s", F.col("i"), F.col("n")).alias("gram"))


_SPLIT_WORDS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, chr(39) || 's\\b', '', 'g'), '(\\p{Ll})([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
_TAXONOMY_WORDS = f"list_filter(string_split_regex(lower({_SPLIT_WORDS}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@register("ev4_taxonomy_words", f"""WITH w AS (SELECT item_id, {_TAXONOMY_WORDS} AS l FROM benchmark)
SELECT item_id, {" || ".join(f"[array_to_string(l[i:i + {n - 1}], ' ') FOR i IN range(1, len(l) - {n - 2})]" for n in range(1, 6))} AS terms FROM w""")
def ev4_taxonomy_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EV4: words and shingles of benchmark items as a taxonomy analyser makes them."""
    words = t.taxonomy_words(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", t.shingles(words, 1, 5).alias("terms"))


_PATHS = [("a", "ms.tex", "x"), ("a", "paper.tex", "\\documentclass{article}\n\\title{Deep things}"), ("b", "one.tex", "\\documentclass{x}\n\\title{Supplementary Material}"), ("b", "two.tex", "\\documentclass{x}\n\\title{Main}"), ("c", "B.tex", "none"), ("c", "a.tex", "none")]


@register("tx16_main_tex", "SELECT * FROM (VALUES ('a','ms.tex',30::BIGINT),('b','two.tex',15),('c','a.tex',0)) AS g(dir, name, priority)")
def tx16_main_tex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of every folder that most likely is the paper."""
    from tabulith.sources.archives import guess_main

    return guess_main(spark.createDataFrame(_PATHS, "dir string, name string, content string"))
