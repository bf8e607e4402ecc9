"""Scoring of extracted results against gold, and threshold search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.functions.text import strip_version
from tabulith.functions.values import norm_score
from tabulith.operators.tasks import spread

#: What keeps denominators from being 0 in evaluate(); the sweep has its own.
EPSILON, SWEEP_EPSILON = 1e-10, 1e-8
AXES = {
    "TDMS": ["task", "dataset", "metric", "score"],
    "TDM": ["task", "dataset", "metric"],
    "task": ["task"],
    "dataset": ["dataset"],
    "metric": ["metric"],
}


def _ratio(a: Column, b: Column, epsilon: float) -> Column:
    return a / (b + F.lit(epsilon))


def _f1(p: Column, r: Column, epsilon: float) -> Column:
    return 2 * p * r / (p + r + F.lit(epsilon))


def indicator(predicted: DataFrame, gold: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct rows of both with what they are: TP, FP or FN."""
    left = predicted.select(*columns).distinct().withColumn("_p", F.lit(True))
    right = gold.select(*columns).distinct().withColumn("_g", F.lit(True))
    # one aggregation in place of a full outer join: nulls compare as equals, and both sides combine before the shuffle
    both = left.withColumn("_g", F.lit(False)).unionByName(right.withColumn("_p", F.lit(False)))
    merged = both.groupBy(*columns).agg(F.bool_or("_p").alias("_p"), F.bool_or("_g").alias("_g"))
    kind = F.when(F.col("_p") & F.col("_g"), "TP").when(F.col("_p"), "FP").otherwise("FN")
    return merged.select(*columns, kind.alias("kind"))


def _averaged(counts: DataFrame, group: list[str]) -> DataFrame:
    """Micro and macro precision, recall and F1 from the TP, FP and FN of every paper, for each group."""
    p, r = _ratio(F.col("TP"), F.col("TP") + F.col("FP"), EPSILON), _ratio(F.col("TP"), F.col("TP") + F.col("FN"), EPSILON)
    each = counts.withColumn("p", p).withColumn("r", r).withColumn("f", _f1(F.col("p"), F.col("r"), EPSILON))
    total = each.groupBy(*group).agg(*[F.sum(k).alias(k) for k in ("TP", "FP", "FN")], *[F.avg(k).alias("macro_" + n) for k, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))])
    total = total.withColumn("micro_precision", p).withColumn("micro_recall", r)
    return total.withColumn("micro_f1", _f1(F.col("micro_precision"), F.col("micro_recall"), EPSILON)).drop("TP", "FP", "FN")


def scores(predicted: DataFrame, gold: DataFrame, columns: list[str], paper: str = "paper") -> DataFrame:
    """AG1: micro and macro precision, recall and F1 of the distinct (paper, columns)."""
    marked = indicator(predicted, gold, [paper, *columns])
    counts = marked.groupBy(paper).agg(*[F.count_if(F.col("kind") == k).cast("double").alias(k) for k in ("TP", "FP", "FN")])
    return _averaged(counts, [])


def evaluate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """AG2: scores() on every axis; score strings normalised, versions of papers dropped.

    Both sides are read once: each row goes to every axis with the columns of the axis alone. All
    that is counted is of one paper, so papers come together once, in as many tasks as they need.
    Without any row on either side there is no axis.
    """
    all_columns = AXES["TDMS"]

    def plain(df: DataFrame, is_gold: bool) -> DataFrame:
        score = norm_score(F.col("score").cast("string"))
        rows = df.select(strip_version(F.col("paper")).alias("paper"), *[c for c in all_columns if c != "score"], score.alias("score"))
        return rows.withColumn("_g", F.lit(is_gold))

    both = spread(plain(predicted, False).unionByName(plain(gold, True)), "paper").distinct()
    kinds = {c: both.schema[c].dataType for c in all_columns}
    keys = [F.struct(F.lit(a).alias("axis"), *[(F.col(x) if x in c else F.lit(None).cast(kinds[x])).alias(x) for x in all_columns]) for a, c in AXES.items()]
    each = both.select("paper", "_g", F.inline(F.array(*keys)))
    merged = each.groupBy("axis", "paper", *all_columns).agg(F.bool_or(~F.col("_g")).alias("_p"), F.bool_or("_g").alias("_g"))
    count = lambda test: F.count_if(test).cast("double")
    counts = merged.groupBy("axis", "paper").agg(
        count(F.col("_p") & F.col("_g")).alias("TP"), count(F.col("_p") & ~F.col("_g")).alias("FP"), count(~F.col("_p") & F.col("_g")).alias("FN"))
    return _averaged(counts, ["axis"])


def binary_confusion(rows: DataFrame, equal: Column, predicted: Column, gold: Column) -> DataFrame:
    """AG3: counts over (equal, predicted, gold); a mismatch of two positives is a false one of both kinds."""
    return rows.agg(
        F.count_if(equal & predicted & gold).alias("tp"),
        F.count_if(equal & ~predicted & ~gold).alias("tn"),
        F.count_if(predicted & (~equal | ~gold)).alias("fp"),
        F.count_if(gold & (~equal | ~predicted)).alias("fn"),
    )


def best_of_topk(rows: DataFrame, cell: str, equal: str, rank: str) -> DataFrame:
    """AG3: one row per cell: whether any of its candidates is equal, other columns of the first one."""
    rest = [c for c in rows.columns if c not in (cell, equal)]
    first = F.min_by(F.struct(*rest), F.col(rank)).alias("_first")
    return rows.groupBy(cell).agg(F.max(equal).alias(equal), first).select(cell, equal, "_first.*")


def class_metrics(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """AG6: accuracy, and precision and recall of the classes other than 0."""
    y, p = F.col(label), F.col(predicted)
    tp, fp, fn = F.count_if((y != 0) & (p == y)), F.count_if((p != 0) & (p != y)), F.count_if((y != 0) & (p == 0))
    return rows.agg(F.avg((p == y).cast("double")).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))


def metric_report(rows: DataFrame, columns: list[str], relevant: Column) -> DataFrame:
    """AG4: for every column x of (x_gold, x_pred), and all of them, the share of equals among relevant rows."""
    same = {c: F.col(f"{c}_gold").eqNullSafe(F.col(f"{c}_pred")) for c in columns}
    same["all"] = reduce(lambda a, b: a & b, same.values())
    wide = rows.where(relevant).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(c) for c, x in same.items()])
    long = wide.unpivot("n", list(same), "column", "matching")
    return long.select("column", "matching", F.try_divide("matching", "n").alias("fraction"))


def conditional_probabilities(counts: DataFrame, x: str, y: str, n: str) -> DataFrame:
    """AG13: P(y given x) and P(x given y) of long (x, y, n)."""
    per_x = counts.groupBy(x).agg(F.sum(n).alias("_nx"))
    per_y = counts.groupBy(y).agg(F.sum(n).alias("_ny"))
    joined = counts.join(per_x, x).join(per_y, y)
    return joined.select(x, y, (F.col(n) / F.col("_nx")).alias("p_y_x"), (F.col(n) / F.col("_ny")).alias("p_x_y"))


def reverse_probabilities(probabilities: DataFrame, x: str, y: str, p: str) -> DataFrame:
    """AG13: P renormalised over x for every y."""
    total = probabilities.groupBy(y).agg(F.sum(p).alias("_total"))
    return probabilities.join(total, y).select(x, y, (F.col(p) / F.col("_total")).alias(p))


def sweep(rows: DataFrame, low: str, high: str, equal: Column, predicted: Column, gold: Column) -> DataFrame:
    """AG16: counts, precision, recall and F1 at every pair of thresholds t1 <= t2.

    A row is active where low < t1 and high >= t2; rows with low >= high never are, but
    count as gold. Rows are first counted by their (low, high), so the range join is over
    distinct pairs and the distinct levels, which a score rounded to few steps bounds.
    """
    marked = rows.select(F.col(low).alias("lo"), F.col(high).alias("hi"), (equal & predicted & gold).alias("tp"), (predicted & (~equal | ~gold)).alias("fp"), (equal & ~predicted & ~gold).alias("tn"), gold.alias("gold"))
    total = marked.agg(F.count_if("gold").alias("n_gold"))
    cells = marked.where("lo < hi").groupBy("lo", "hi").agg(*[F.count_if(c).alias(c) for c in ("tp", "fp", "tn")])
    levels = cells.select(F.explode(F.array("lo", "hi")).alias("t")).distinct()
    top = levels.agg(F.max("t").alias("top"))
    t1 = levels.crossJoin(F.broadcast(top)).where("t < top").select(F.col("t").alias("threshold1"))
    pairs = t1.join(levels.withColumnRenamed("t", "threshold2"), F.col("threshold2") >= F.col("threshold1"))
    met = pairs.join(cells, (F.col("lo") < F.col("threshold1")) & (F.col("hi") >= F.col("threshold2")), "left")
    sums = met.groupBy("threshold1", "threshold2").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "tn")])
    found = sums.crossJoin(F.broadcast(total)).withColumn("fn", F.col("n_gold") - F.col("tp")).drop("n_gold")
    found = found.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"), SWEEP_EPSILON)).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn"), SWEEP_EPSILON))
    return found.withColumn("f1", _f1(F.col("precision"), F.col("recall"), SWEEP_EPSILON))


def best_operating_point(swept: DataFrame, by: str = "f1", **least: float) -> DataFrame:
    """AG17, PF11: the pair of thresholds with the best ``by`` among those with e.g. precision=0.8 or more."""
    for column, value in least.items():
        swept = swept.where(F.col(column) >= value)
    order = F.struct(F.round(by, 12), -F.col("threshold1"), -F.col("threshold2"))
    return swept.agg(F.max_by(F.struct(*swept.columns), order).alias("best")).where("best IS NOT NULL").select("best.*")


def noise(pairs: DataFrame, extracted: str, gold: str) -> DataFrame:
    """AG19: the share of what was extracted that gold doesn't have, over all rows."""
    common = F.sum(F.size(F.array_intersect(extracted, gold)))
    return pairs.agg(F.try_divide(F.sum(F.size(F.array_distinct(extracted))) - common, F.sum(F.size(F.array_distinct(extracted)))).alias("noise"))
