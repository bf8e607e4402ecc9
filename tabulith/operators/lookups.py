"""Joins, selections and counts of papers, tables and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.text import strip_version

SPLITS = ("test", "valid")


def papers_by_id(papers: DataFrame, wanted: str, key: str = "paper_id") -> DataFrame:
    """PF8: papers of an identifier, whatever their version."""
    return papers.where(strip_version(F.col(key)) == strip_version(F.lit(wanted)))


def matching_nodes(nodes: Column, **wanted) -> Column:
    """PF9: those of an array of structs whose fields are all as wanted (a value, or a test of a Column)."""

    def fits(node: Column) -> Column:
        out = F.lit(True)
        for name, value in wanted.items():
            out = out & (value(node[name]) if callable(value) else node[name] == value)
        return out

    return F.filter(nodes, fits)


def typed_tables(tables: DataFrame, types: dict[int, str], column: str = "label") -> DataFrame:
    """PF12: tables whose class has a name, with it as type; the others are no results."""
    names = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return tables.where(F.col(column).isin(*types)).withColumn("type", names[F.col(column)])


def disagreements(rows: DataFrame, predicted: str, label: str, equal: bool = False) -> DataFrame:
    """PF13: rows whose prediction isn't their label, or is it; nulls are equal."""
    same = F.col(predicted).eqNullSafe(F.col(label))
    return rows.where(same if equal else ~same)


def fold_split(fold: Column) -> Column:
    """PF14: the first fold is for tests, the second for validation, all others are for training."""
    out = F
    for number, name in enumerate(SPLITS):
        out = out.when(fold == number, name)
    return out.otherwise("train")


def known_only(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """PF16, J4: rows whose keys are known, such as gold records within a taxonomy."""
    return rows.join(known.select(*keys).distinct(), keys, "left_semi")


def without(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """SE8: rows that haven't been found."""
    return rows.join(found.select(*keys).distinct(), keys, "left_anti")


def type_label(is_result: Column, is_ablation: Column) -> Column:
    """PF17: 0 results, 1 ablation, 2 neither; results win."""
    return F.when(is_result, 0).when(is_ablation, 1).otherwise(2)


def change_points(rows: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """W4, TX14: the rows where a column changes within its group, the first row among them."""
    before = F.lag(F.struct(column)).over(W.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before")[column].eqNullSafe(F.col(column))).drop("_before")


def ordered_distinct(rows: DataFrame, group: list[str], value: str, order: list[str]) -> DataFrame:
    """SE7: the different values of every group in the order of their first appearance, as an array."""
    first = rows.groupBy(*group, value).agg(F.min(F.struct(*order)).alias("_first"))
    listed = F.sort_array(F.collect_list(F.struct("_first", value)))
    return first.groupBy(*group).agg(F.transform(listed, lambda x: x[value]).alias(value))


def shared(values: Column, others: list[str]) -> Column:
    """SE5: how many of an array's different values are among others."""
    return F.size(F.array_intersect(values, F.array(*map(F.lit, others)))).cast("long")


def first_of_equals(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """AG22: the least ``order`` of rows with equal keys, by an aggregation rather than a window."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def latest(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """AG24: what was logged last for every key, and how much was."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("latest"), F.count(F.lit(1)).alias("n"))


def merged_text(parts: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """AG12: the parts of every key joined in order by line ends, and their number; a null part is empty."""
    rows = parts.withColumn(text, F.coalesce(text, F.lit("")))
    listed = F.sort_array(F.collect_list(F.struct(*order, *([text] if text not in order else []))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[text]), "\n").alias(text), F.count(F.lit(1)).alias("n"))


def confusion_table(rows: DataFrame, label: str, predicted: str, classes: list[str]) -> DataFrame:
    """AG5: a confusion matrix; classes are given, so that no pass looks for them."""
    return rows.groupBy(label).pivot(predicted, classes).count().na.fill(0)


def means(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AG15: the mean of every key over all dictionaries, which are rows here."""
    return rows.groupBy(key).agg(F.avg(value).alias("mean"))


def nested_counts(papers: DataFrame, key: str, tables: Column, is_leaderboard) -> DataFrame:
    """AG18: papers, tables and leaderboards of every key; ``tables`` is an array, null without any."""
    size = F.coalesce(F.size(F.filter(tables, lambda x: F.lit(True))), F.lit(0))
    boards = F.coalesce(F.size(F.filter(tables, is_leaderboard)), F.lit(0))
    no = tables.isNull()
    count = lambda n: F.sum(F.when(no, 0).otherwise(n))
    return papers.groupBy(key).agg(F.count(F.lit(1)).alias("papers"), count(size).alias("tables"), count(boards).alias("leaderboards"))


def word_counts(words: DataFrame, column: str) -> DataFrame:
    """AG20: how often each word (a surname) comes, in lower case."""
    return words.groupBy(F.lower(column).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def by_either_key(rows: DataFrame, names: DataFrame, exact: str, short: str, value: str) -> DataFrame:
    """``rows`` with ``value`` of ``names`` (key, value) by their exact key, else by the shorter one."""
    a = names.select(F.col("key").alias(exact), F.col(value).alias("_exact"))
    b = names.select(F.col("key").alias(short), F.col(value).alias("_short"))
    return rows.join(a, exact, "left").join(b, short, "left").withColumn(value, F.coalesce("_exact", "_short")).drop("_exact", "_short")


def texts_and_tables(texts: DataFrame, tables: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Papers with texts, tables or both; what one lacks has its default."""
    return texts.join(tables, key, "full").fillna(defaults)


def side_by_side(gold: DataFrame, found: DataFrame, cell: list[str], column: str) -> DataFrame:
    """Gold and predicted values of every cell that either has, and whether they are equal (nulls are)."""
    both = gold.select(*cell, F.col(column).alias(f"{column}_gold")).join(found.select(*cell, F.col(column).alias(f"{column}_pred")), cell, "full")
    return both.withColumn("equal", F.col(f"{column}_gold").eqNullSafe(F.col(f"{column}_pred")))


def unique_titles(papers: DataFrame, title: str, key: str) -> DataFrame:
    """Titles that one paper alone has, with its key."""
    return papers.groupBy(title).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(key)).where("_n = 1").drop("_n")


def mentions(fragments: DataFrame, pattern: str, key: str, text: str = "text") -> DataFrame:
    """(key, ref): the different references that a fragment's text has, for an equi-join with tables."""
    return fragments.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))).alias("ref"))


def annotated(tables: DataFrame, parser: Column, tags: str, trash: str) -> DataFrame:
    """TB31: the tables of one parser whose tags are neither empty nor trash."""
    return tables.where(parser & (F.col(tags) != "") & ~F.col(tags).contains(trash))


def records(rows: DataFrame, json: str, least: int | None = None) -> DataFrame:
    """TB24: annotation records (key, value) parsed from a JSON object of numbers; records without a number are left out."""
    parsed = rows.select(*[c for c in rows.columns if c != json], F.explode(F.from_json(json, "map<string,bigint>")).alias("key", "value"))
    return parsed.where(F.col("value").isNotNull() if least is None else F.col("value") > least)


def bag_key(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, key): a bag of items as one string, whatever their order."""
    counts = rows.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.struct(item, "n")))
    return counts.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x[item], x["n"].cast("string"))), ";").alias("key"))


def model_type(tags: Column) -> Column:
    """F32: the kind of model of a proposal from the tags before it: competing if any says so, else the first one, else none."""
    return F.when(F.array_contains(tags, "model-competing"), "model-competing").otherwise(F.coalesce(F.get(tags, F.lit(0)), F.lit("")))


def index_keys(names: DataFrame) -> DataFrame:
    """LK3: (key, name): names by their form without spaces, the last of those that share it."""
    return names.groupBy(F.replace("name", F.lit(" "), F.lit("")).alias("key")).agg(F.max("name").alias("name"))


def answered_once(asked: DataFrame, key: str, answer) -> DataFrame:
    """EV10: ``asked`` with the answer to each key; ``answer`` (of a table of different keys) sees every key once."""
    return asked.join(answer(asked.select(key).distinct()), key)
