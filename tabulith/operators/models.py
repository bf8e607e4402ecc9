"""Cell and table classifiers with pyspark.ml, and what goes in and comes out of them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import HashingTF, IDF, ElementwiseProduct, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.operators.evaluation import class_metrics
from tabulith.operators.experiments import Experiment

#: Classes of the cell classifier, in the order of their numbers.
CELL_TAGS = ("table-meta", "dataset", "model-paper", "model-competing", "dataset-metric", "")
TABLE_TYPES = ("leaderboard", "ablation", "irrelevant")
#: Features that words are hashed to: the size of a model, whatever the corpus.
FEATURES = 1 << 16
#: Different terms up to which their places are broadcast.
BROADCAST_TERMS = 500_000


def group_split(rows: DataFrame, content: str, share: int = 10, seed: int = 42) -> DataFrame:
    """ML2: is_valid for one in ``share`` of the different contents, the same for all rows of one content."""
    return rows.withColumn("is_valid", F.pmod(F.xxhash64(content, F.lit(seed)), F.lit(share)) == 0)


def log_count_ratio(rows: DataFrame, features: str, label: str) -> list[float]:
    """ML1: r of naive Bayes for every feature: ln of (p + 1 over its sum) to (n + 1 over its sum), p and n binary counts.

    Summed by feature on the executors; at most FEATURES numbers come back.
    """
    each = rows.select(label, F.posexplode(vector_to_array(F.col(features))).alias("i", "v")).where("v <> 0")
    counts = each.groupBy("i").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).toPandas()
    size = rows.schema[features].metadata.get("ml_attr", {}).get("num_attrs", FEATURES)
    import numpy as np

    p, n = np.ones(size), np.ones(size)
    p[counts["i"]] += counts["p"]
    n[counts["i"]] += counts["n"]
    classes = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return (np.log(p / (classes["p"] + 1)) - np.log(n / (classes["n"] + 1))).tolist()


def nbsvm(rows: DataFrame, text: str = "text", label: str = "label", n_grams: int = 1, features: int = 1 << 12) -> PipelineModel:
    """ML1: logistic regression on words and n-grams weighted by naive Bayes' log-count ratio."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern="[^\\p{L}\\p{N}]+", gaps=True)
    grams = [NGram(n=k, inputCol="_words", outputCol=f"_g{k}") for k in range(2, n_grams + 1)]
    joined = SQLTransformer(statement="SELECT *, concat(" + ", ".join(["_words", *(g.getOutputCol() for g in grams)]) + ") AS _terms FROM __THIS__")
    hashed = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features, binary=True)
    front = Pipeline(stages=[words, *grams, joined, hashed]).fit(rows)
    ready = front.transform(rows)
    ratio = log_count_ratio(ready, "_tf", label)
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(ratio), inputCol="_tf", outputCol="features")
    weighed = weigh.transform(ready)
    model = LogisticRegression(featuresCol="features", labelCol=label, maxIter=20, regParam=0.01).fit(weighed)
    return PipelineModel(stages=[*front.stages, weigh, model])


def multi_class(rows: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 12) -> PipelineModel:
    """ML6: a classifier of several classes over tf-idf, one against the rest."""
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern="[^\\p{L}\\p{N}]+", gaps=True)
    stages = [words, HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="features")]
    one = LogisticRegression(maxIter=10, regParam=0.01)
    return Pipeline(stages=[*stages, OneVsRest(classifier=one, labelCol=label, featuresCol="features")]).fit(rows)


def feature_importance(model: PipelineModel) -> list[tuple[int, float]]:
    """TK4: features by their coefficient times their log-count ratio, largest first (at most the model's size)."""
    weights, ratio = model.stages[-1].coefficients.toArray(), model.stages[-2].getScalingVec().toArray()
    order = sorted(range(len(weights)), key=lambda i: (-weights[i] * ratio[i], i))
    return [(i, float(weights[i] * ratio[i])) for i in order]


def contributions(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """ML10: (key, term, contribution) of an NB-SVM: what each term of a text adds to the odds that it is of class 1.

    The contributions of a text and the model's intercept are its log-odds. Terms that share
    a feature share what it adds. (Saliency of a neural net has no meaning here.) A term is
    hashed once, however many texts have it.
    """
    front, weigh, last = PipelineModel(model.stages[:-2]), model.stages[-2], model.stages[-1]
    # as many numbers as the model has features
    worth = (last.coefficients.toArray() * weigh.getScalingVec().toArray()).tolist()
    terms = front.transform(rows).select(key, F.explode(F.array_distinct("_terms")).alias("term"))
    hashing = next(x for x in model.stages if isinstance(x, HashingTF))
    placed = hashing.transform(terms.select("term").distinct().withColumn(hashing.getInputCol(), F.array("term")))
    index = F.array_position(vector_to_array(F.col(hashing.getOutputCol())), F.lit(1.0)) - 1
    # computed once, so that their number is known
    places = placed.select("term", index.cast("int").alias("feature")).localCheckpoint()
    each = terms.join(F.broadcast(places) if places.count() <= BROADCAST_TERMS else places, "term").select(key, "term", "feature")
    sharing = F.count(F.lit(1)).over(W.partitionBy(key, "feature"))
    table = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(worth) if v], "feature int, worth double")
    return each.withColumn("n", sharing).join(F.broadcast(table), "feature").select(key, "term", (F.col("worth") / F.col("n")).alias("contribution"))


def run_experiment(rows: DataFrame, experiment: Experiment, text: str = "text", label: str = "label") -> tuple[PipelineModel, dict[str, float]]:
    """ML8: a classifier by the experiment's settings, trained where is_valid is false and scored where it is true."""
    model = nbsvm(rows.where("NOT is_valid"), text, label, experiment.n_grams)
    scored = model.transform(rows.where("is_valid")).withColumn("prediction", F.col("prediction").cast("int"))
    return model, {k: float(v or 0.0) for k, v in class_metrics(scored, "prediction", label).first().asDict().items()}


def run_schedule(rows: DataFrame, experiments: list[Experiment], text: str = "text", label: str = "label") -> list[tuple[Experiment, dict[str, float]]]:
    """ML8: every experiment of a schedule in turn, best accuracy first; what save_experiments() takes."""
    done = [(e, run_experiment(rows, e, text, label)[1]) for e in experiments]
    return sorted(done, key=lambda x: -x[1]["accuracy"])


def predicted_tags(predictions: DataFrame) -> DataFrame:
    """ML6: class numbers as tags; cells of no class and empty cells are left out."""
    names = F.create_map(*[x for i, tag in enumerate(CELL_TAGS) for x in (F.lit(i), F.lit(tag))])
    tagged = predictions.withColumn("predicted_tags", names[F.col("prediction").cast("int")])
    return tagged.where("predicted_tags <> ''").select("paper_id", "table_name", "row", "col", "predicted_tags")


def table_types(probabilities: DataFrame, threshold: float = 0.5) -> DataFrame:
    """ML5, F31: the type of every table from its class probabilities."""
    p = F.col("probabilities")
    top = F.array_max(p)
    index = F.when(top >= threshold, F.array_position(p, top)).otherwise(len(TABLE_TYPES))
    return probabilities.select("paper_id", "table_name", F.element_at(F.array(*map(F.lit, TABLE_TYPES)), index.cast("int")).alias("type"))


def caption_or_name(caption: Column) -> Column:
    """ML5: what a table's type is read from."""
    return F.when(F.coalesce(F.trim(caption), F.lit("")) == "", "Table").otherwise(caption)
