"""Linking cells to a taxonomy: evidence dictionaries, mentions in text, naive-Bayes scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.text import norm_cell, norm_dataset, norm_dataset_ws
from tabulith.operators.evaluation import conditional_probabilities, reverse_probabilities
from tabulith.schemas import PROPOSALS

STOP_WORDS = ("a", "an", "and", "for", "in", "of", "on", "the", "to", "with", "by", "using")
AXES = ("task", "dataset", "metric")
#: What an unexplained mention is worth on each axis, and how often one counts.
BACKGROUND = {"task": 0.01, "dataset": 0.001, "metric": 0.01}
REPEATS = {"task": 3, "dataset": 1, "metric": 1}
#: The noise of each context: for data sets and metrics, and for tasks.
CONTEXTS = {"paper": (0.99, 0.1), "abstract": (1.0, 1.0), "mentions": (1.0, 1.0), "caption": (0.25, 0.1), "cell": (0.01, 0.1)}
NOISE = {axis: tuple(pair[axis == "task"] for pair in CONTEXTS.values()) for axis in AXES}
INDEPENDENT = 0.79
#: Characters of a dictionary's beginnings up to which it is broadcast.
BROADCAST_CHARACTERS = 16_000_000
#: Metrics with a range up to which they are broadcast.
BROADCAST_METRICS = 100_000


def evidence_names(names: DataFrame, axis: str, abbreviations: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """LK1, LK2, SE6: (name, evidence) of a taxonomy axis.

    A name's evidences are its normal form and, for datasets and metrics of several words,
    the words but stop words; datasets get 'test', or words for validation sets if their
    name says 'val'; expansions of ``abbreviations`` (short, long) that occur in the name;
    and ``manual`` (name, evidence).
    """
    full = norm_dataset_ws(F.col("name"))
    words = F.filter(F.split(full, " "), lambda w: ~w.isin(*STOP_WORDS) & (w != ""))
    several = F.when(F.size(words) > 1, words).otherwise(F.array().cast("array<string>"))
    extra = F.array().cast("array<string>")
    if axis == "task":
        several = extra
    elif axis == "dataset":
        extra = F.when(F.col("name").contains("val"), F.array(*map(F.lit, ("validation", "dev", "development")))).otherwise(F.array(F.lit("test")))
    out = names.select("name", F.explode(F.concat(F.array(full), several, extra)).alias("evidence"))
    if abbreviations is not None and axis != "task":
        texts = names.select(F.col("name").alias("text_id"), norm_dataset_ws(F.col("name")).alias("text"))
        found = find_names(texts, abbreviations.select(F.col("short").alias("name")))
        out = out.union(found.join(abbreviations, found["name"] == abbreviations["short"]).select(F.col("text_id").alias("name"), F.col("long").alias("evidence")))
    if manual is not None:
        out = out.union(manual.select("name", "evidence"))
    return out.distinct()


def find_names(texts: DataFrame, names: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """LK4: (text_id, by, name, n): how often each name stands in a text from a word's start to a word's end.

    Spaces don't matter ('image net' is 'imagenet'). Runs of words that aren't longer than
    the longest name are joined without spaces and looked up by equality, so names may
    overlap each other. ``by`` are columns of ``names``, each value with names of its own:
    all are found in one pass. A dictionary of up to BROADCAST_CHARACTERS goes to the texts,
    where only words that begin a name begin a run; for a larger one runs are shuffled.
    """
    words = F.array_remove(F.split(F.lower("text"), "[^\\p{L}\\p{N}_]+"), "")
    keyed = names.select(*by, "name", F.replace(F.lower("name"), F.lit(" "), F.lit("")).alias("key")).where("key <> ''").groupBy("key", *by).agg(F.max("name").alias("name"))
    longest, size = keyed.agg(F.coalesce(F.max(F.length("key")), F.lit(0)), F.coalesce(F.sum(F.length("key") + 16), F.lit(0))).first()
    small = size * max(longest, 1) <= BROADCAST_CHARACTERS
    # a run of n words has n characters at least
    starts = texts.select("text_id", words.alias("w")).where(F.size("w") > 0).select("text_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    if small:
        begins = keyed.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substr("key", F.lit(1), n))).alias("first")).distinct()
        starts = starts.withColumn("first", F.get("w", F.col("i") - 1)).join(F.broadcast(begins), "first", "left_semi")
    near = starts.select("text_id", F.slice("w", F.col("i"), F.lit(longest)).alias("w"))
    sized = near.select("text_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n"))
    runs = sized.select("text_id", F.array_join(F.slice("w", F.lit(1), F.col("n")), "").alias("key")).where(F.length("key") <= longest)
    if small:
        return runs.join(F.broadcast(keyed), "key").groupBy("text_id", *by, "name").agg(F.count(F.lit(1)).alias("n"))
    # counted before the join, so that a frequent run goes over the network once a text
    return runs.groupBy("text_id", "key").agg(F.count(F.lit(1)).alias("n")).join(keyed, "key").select("text_id", *by, "name", "n")


def context_counts(texts: DataFrame, dictionaries: dict[str, DataFrame], subtract: bool = True) -> DataFrame:
    """LK5, LK6: (text_id, axis, evidence, n); datasets less what tasks and metrics explain (never below 0)."""
    names = reduce(DataFrame.unionByName, [d.select(F.col("evidence").alias("name"), F.lit(axis).alias("axis")) for axis, d in dictionaries.items()])
    found = find_names(texts, names.distinct(), ("axis",))
    if subtract and "dataset" in dictionaries:
        # one aggregation: what the other axes have of a name stands beside the data sets' own
        is_data = F.col("axis") == "dataset"
        other = F.sum(F.when(~is_data, F.col("n"))).over(W.partitionBy("text_id", "name"))
        found = found.withColumn("n", F.when(is_data, F.col("n") - F.coalesce(other, F.lit(0))).otherwise(F.col("n"))).where("n > 0")
    return found.select("text_id", "axis", norm_cell(F.col("name")).alias("evidence"), "n")


def likelihoods(evidences: DataFrame) -> DataFrame:
    """LK7: (name, evidence, p): P(evidence given name), from how names share evidences."""
    counts = evidences.select("name", norm_cell(norm_dataset(F.col("evidence"))).alias("evidence")).groupBy("name", "evidence").agg(F.count(F.lit(1)).alias("n"))
    given_evidence = conditional_probabilities(counts, "name", "evidence", "n").select("name", "evidence", F.col("p_x_y").alias("p"))
    return reverse_probabilities(given_evidence, "evidence", "name", "p").select("name", "evidence", "p")


def axis_gains(counts: DataFrame, likelihood: DataFrame, noise: Column, background: float, repeats: int) -> DataFrame:
    """LK8: (query, name, gain): by how much a name's log-likelihood is above that of a name without evidence.

    A mention gives a name ln(noise background + (1 - noise) P(mention given name)), and one
    that it is no evidence for ln(noise background), min(n, repeats) times each. So names
    without evidence all have a query's base, and only the others have rows here: queries
    and names are never crossed. ``counts`` are (query, context, evidence, n) with the
    columns that ``noise`` needs.
    """
    times = F.least("n", F.lit(repeats))
    gain = times * (F.log(noise * background + (1 - noise) * F.col("p")) - F.log(noise * background))
    return counts.join(likelihood, "evidence").groupBy("query", "name").agg(F.sum(gain).alias("gain"))


def axis_scores(counts: DataFrame, names: DataFrame, likelihood: DataFrame, noise: Column, background: float, repeats: int) -> DataFrame:
    """LK8: (query, name, logp) of every name for every query, for reports on an axis: as many rows as both have together."""
    gains = axis_gains(counts, likelihood, noise, background, repeats)
    base = counts.groupBy("query").agg(F.sum(F.least("n", F.lit(repeats)) * F.log(noise * background)).alias("base"))
    own = gains.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("name", "gain"))).alias("gains"))
    # the names of one axis of a taxonomy, as one list in every row
    listed = names.agg(F.sort_array(F.collect_set("name")).alias("names"))
    rows = base.join(own, "query", "left").join(F.broadcast(listed)).select("query", "base", "gains", F.explode("names").alias("name"))
    return rows.select("query", "name", (F.col("base") + F.coalesce(F.try_element_at("gains", F.col("name")), F.lit(0.0))).alias("logp"))


def softmax_by_query(scores: DataFrame, keys: list[str]) -> DataFrame:
    group = W.partitionBy("query")
    shifted = scores.withColumn("_e", F.exp(F.col("logp") - F.max("logp").over(group)))
    return shifted.select("query", *keys, (F.col("_e") / F.sum("_e").over(group)).alias("confidence"))


def link(queries: DataFrame, gains: dict[str, DataFrame], taxonomy: DataFrame, top: int = 1, independent: bool = True) -> DataFrame:
    """LK9 to LK11, TK1: (query, rank, task, dataset, metric, confidence) of every query of ``queries``.

    A triple's log-probability is the sum of its axes'; confidences are a softmax over the
    triples of a query. The best of each axis by itself competes as a row of confidence
    0.79; of equals the joint one goes first, then the smaller names. Triples without a
    gain on any axis are all equal, so of these only the first ``top`` are looked at, and
    the softmax needs only their number.
    """
    triples = taxonomy.select(*AXES).distinct()
    n_triples = triples.count()
    asked = queries.select("query").distinct()
    met = [triples.join(gains[a].select("query", F.col("name").alias(a)), a).select("query", *AXES) for a in AXES]
    first = F.broadcast(triples.orderBy(*AXES).limit(top))
    rows = reduce(DataFrame.unionByName, [*met, asked.join(first).select("query", *AXES)]).distinct()
    for axis in AXES:
        rows = rows.join(gains[axis].select("query", F.col("name").alias(axis), F.col("gain").alias(f"_{axis}")), ["query", axis], "left")
    group = W.partitionBy("query")
    rows = rows.select("query", *AXES, sum((F.coalesce(f"_{a}", F.lit(0.0)) for a in AXES), F.lit(0.0)).alias("g"))
    rows = rows.withColumn("top", F.max("g").over(group)).withColumn("e", F.exp(F.col("g") - F.col("top")))
    whole = F.sum("e").over(group) + (n_triples - F.count(F.lit(1)).over(group)) * F.exp(-F.col("top"))
    rows = rows.select("query", *AXES, (F.col("e") / whole).alias("confidence"), F.lit(0).alias("lone"))
    if independent:
        best = asked
        for axis in AXES:
            # of names without a gain the last by name is as good as any
            last = F.broadcast(triples.agg(F.max(axis).alias("name")).where("name IS NOT NULL"))
            each = gains[axis].select("query", "name", "gain").unionByName(asked.join(last).withColumn("gain", F.lit(0.0)))
            best = best.join(each.groupBy("query").agg(F.max_by("name", F.struct(F.round("gain", 9), "name")).alias(axis)), "query")
        rows = rows.unionByName(best.select("query", *AXES, F.lit(INDEPENDENT).alias("confidence"), F.lit(1).alias("lone")))
    order = W.partitionBy("query").orderBy(F.round("confidence", 9).desc(), "lone", *AXES)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "rank", *AXES, "confidence")


@dataclass(frozen=True)
class Linker:
    """UD2: a way to link proposals to a taxonomy, under a name; how it links and, if given, how it finds data sets in papers are functions."""

    name: str
    taxonomy_linking: Callable[[DataFrame, DataFrame | None], DataFrame]
    dataset_extractor: Callable[[DataFrame], DataFrame] | None = None

    def __call__(self, proposals: DataFrame, papers: DataFrame | None = None) -> DataFrame:
        """LK14: the links of the proposals of all papers in one plan; ``papers`` are what the extractor reads."""
        found = self.dataset_extractor(papers) if self.dataset_extractor and papers is not None else None
        return self.taxonomy_linking(proposals, found)


def no_proposals(spark: SparkSession, reason: str) -> DataFrame:
    """LK16: one row in place of a table's proposals, which says why there are none."""
    columns = ", ".join(c for c in PROPOSALS.split(", "))
    return spark.createDataFrame([], columns).withColumn("reason", F.lit("")).unionByName(spark.range(1).select(F.lit(reason).alias("reason")), allowMissingColumns=True)


def complement_metrics(taxonomy: DataFrame, pairs: DataFrame) -> DataFrame:
    """the taxonomy with the complements (metric, complement) of its metrics, and which metric is the true one."""
    own = taxonomy.select(*AXES, F.col("metric").alias("true_metric"))
    lower = pairs.select(F.lower("metric").alias("_m"), "complement")
    extra = taxonomy.withColumn("_m", F.lower("metric")).join(lower, "_m").select("task", "dataset", F.col("complement").alias("metric"), F.col("metric").alias("true_metric"))
    return own.unionByName(extra.join(own.select(*AXES), list(AXES), "left_anti")).distinct()


def cell_proposals(cells: DataFrame, keys: list[str]) -> DataFrame:
    """LK12: untagged numeric cells with the model and dataset cells before them."""
    from tabulith.functions.text import is_number_cell
    from tabulith.operators.cells import preceding_tags

    tagged = preceding_tags(cells, keys, "model", "dataset")
    return tagged.where((F.col("tag") == "") & is_number_cell(F.col("value")))


def proposal_rows(proposals: DataFrame, links: DataFrame, metric_info: DataFrame, by: str = "cell_ext_id", *also: str) -> DataFrame:
    """LK13: linked proposals with their value in the metric's range.

    ``links`` have (cell_ext_id, task, dataset, metric, true_metric, confidence), or ``by``, a
    column of the proposals, in place of cell_ext_id; ``metric_info`` (metric, range). A metric
    that is not the true one is its complement. ``also`` are columns of the proposals to keep.
    """
    from tabulith.functions.values import convert_metric

    model = F.array_join(F.transform("model_values", lambda v: v["value"]), " ")
    kinds = F.transform("model_values", lambda v: v["tag"])
    kind = F.when(F.array_contains(kinds, "model-competing"), "model-competing").otherwise(F.coalesce(F.get(kinds, F.lit(0)), F.lit("")))
    data = F.array_join(F.transform("dataset_values", lambda v: v["value"]), " ")
    rows = proposals.select(*dict.fromkeys(("cell_ext_id", by, *also)), F.col("value").alias("raw_value"), model.alias("model"), kind.alias("struct_model_type"), data.alias("struct_dataset"))
    info = metric_info.select(F.col("metric").alias("true_metric"), "range")
    # two metrics would be two tasks in a shuffle
    small = metric_info.limit(BROADCAST_METRICS + 1).count() <= BROADCAST_METRICS
    met = rows.join(links, by).join(F.broadcast(info) if small else info, "true_metric", "left")
    met = met.withColumn("_range", F.coalesce("range", F.lit(""))).withColumn("_flip", F.col("metric") != F.col("true_metric"))
    parsed = convert_metric(F.col("raw_value"), F.col("_range"), F.col("_flip")).cast("double")
    form = F.when(F.col("raw_value").contains("%"), "{x}%").otherwise("{x}")
    return met.select("cell_ext_id", *also, "task", "dataset", F.col("true_metric").alias("metric"), form.alias("format"), "raw_value", "model", F.col("struct_model_type").alias("model_type"), "confidence", parsed.alias("parsed"), "struct_model_type", "struct_dataset")


def acronyms(texts: DataFrame) -> DataFrame:
    """LK15: (text_id, short, long): 'long form (LF)' where the letters begin the words before it."""
    found = F.regexp_extract_all("text", F.lit("((?:[A-Za-z]+[ -]){1,6})\\(([A-Z]{2,6})\\)"), F.lit(0))
    each = texts.select("text_id", F.explode(found).alias("m"))
    short = F.regexp_extract("m", "\\(([A-Z]{2,6})\\)$", 1)
    words = F.array_remove(F.split(F.regexp_extract("m", "^(.*)\\(", 1), "[ -]"), "")
    last = F.when(F.size(words) >= F.length("short"), F.slice(words, -F.length("short"), F.length("short")))
    initials = F.upper(F.array_join(F.transform(last, lambda w: F.substring(w, 1, 1)), ""))
    sized = each.withColumn("short", short)
    return sized.where(initials == F.col("short")).select("text_id", "short", F.array_join(last, " ").alias("long")).distinct()
