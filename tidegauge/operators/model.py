"""Classifiers and regressors on Spark ML, and their quality measures as aggregates."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import (
    PCA, CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.hashing import unit_hash
from tidegauge.functions.labels import CLASS_LABELS
from tidegauge.functions.text import TOKEN_PATTERN
from tidegauge.operators.quantiles import totals_below
from tidegauge.operators.text import MAX_TERMS, most_frequent, term_totals

#: Training rows that one task of an optimiser pass reads; far fewer cost more to start than to read.
ROWS_PER_PASS = 5000

# Promotion thresholds on r2.
MIN_R2, MIN_ABSOLUTE_GAIN, MIN_RELATIVE_GAIN = 0.5, 0.05, 0.05


def split_by_hash(df: DataFrame, ids: list[str], test_share: float = 0.25,
                  seed: int = 42) -> DataFrame:
    """Tag rows ``train``/``test`` by a seeded hash of their id.

    Unlike ``randomSplit`` the result does not depend on partitioning or on a recomputed plan.
    """
    return df.withColumn("part", F.when(unit_hash(*ids, seed=seed) < test_share, "test").otherwise("train"))


# ---- text classifier -----------------------------------------------------------------------

def fit_vectoriser(docs: DataFrame, text: str, max_terms: int = MAX_TERMS) -> PipelineModel:
    """Tokens, counts, smooth idf and unit length as one storable pipeline.

    The vocabulary is that of the SQL form, ties by term, so that no partitioning changes it; texts
    are tokenised once for it and its weights, and only terms with their totals move. It is the model
    itself: ``max_terms`` strings.
    """
    tokenizer = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=TOKEN_PATTERN,
                               gaps=False, toLowercase=True)
    terms, n = most_frequent(term_totals(docs, text), max_terms).collect(), docs.count()
    counter = CountVectorizerModel.from_vocabulary([r.term for r in terms], inputCol="_tokens",
                                                   outputCol="_counts")
    idf = [math.log((1 + n) / (1 + r.df)) + 1 for r in terms]
    weight = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_weighted")
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="features")
    return PipelineModel(stages=[tokenizer, counter, weight, unit])


def fit_text_classifier(docs: DataFrame, text: str, target: str, c: float = 1.0,
                        max_iter: int = 500, max_terms: int = MAX_TERMS,
                        parts: int | None = None) -> PipelineModel:
    """Multinomial logistic regression on tf-idf with L2 strength 1 / (C n).

    Texts are dealt to ``parts`` partitions (default: one per core), however the files lie.
    """
    spark = docs.sparkSession
    # texts are dealt out once; the vocabulary and the training rows are both made from them
    dealt = docs.select(text, target).repartition(parts or spark.sparkContext.defaultParallelism).persist()
    try:
        vectoriser = fit_vectoriser(dealt, text, max_terms)
        n = dealt.count()
        lr = LogisticRegression(featuresCol="features", labelCol=target, family="multinomial",
                                maxIter=max_iter, regParam=1.0 / (c * n), elasticNetParam=0.0,
                                standardization=False)
        # the optimiser passes over the training rows once per iteration
        train = vectoriser.transform(dealt).select("features", F.col(target).cast("double"))
        train = train.coalesce(-(-n // ROWS_PER_PASS)).persist() if n else train.persist()
        try:
            model = lr.fit(train)
        finally:
            train.unpersist()
    finally:
        dealt.unpersist()
    return PipelineModel(stages=[*vectoriser.stages, model])


def predict(model: PipelineModel, texts: DataFrame, labels: list[str] = CLASS_LABELS) -> DataFrame:
    """Label of every text, on a batch or a stream."""
    names = F.array(*[F.lit(x) for x in labels])
    scored = model.transform(texts)
    return scored.select(*texts.columns, F.get(names, F.col("prediction").cast("int"))
                         .alias("label"), vector_to_array("probability").alias("scores"))


def strongest_words(model: PipelineModel, q: float = 0.99) -> DataFrame:
    """Words whose coefficient exceeds the class's ``q`` quantile.

    Model-sized data: classes x vocabulary numbers, which the fitted model holds anyway.
    """
    counter, lr = model.stages[1], model.stages[-1]
    words = counter.vocabulary
    matrix = lr.coefficientMatrix.toArray()
    rows = [(c, words[j], float(matrix[c, j])) for c in range(matrix.shape[0])
            for j in range(matrix.shape[1])]
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    long = spark.createDataFrame(rows, "class int, word string, weight double")
    limits = long.groupBy("class").agg(F.percentile("weight", F.lit(q)).alias("limit"))
    return long.join(limits, "class").where("weight > limit").select("class", "word", "weight")


# ---- other models --------------------------------------------------------------------------

def feature_vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def fit_dense_classifier(df: DataFrame, target: str, layers: list[int], max_iter: int = 60,
                         seed: int = 101):
    """Feed-forward classifier with sigmoid hidden layers and a softmax output."""
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=target, layers=layers,
                                          maxIter=max_iter, seed=seed).fit(df)


def fit_linear(df: DataFrame, target: str):
    return LinearRegression(featuresCol="features", labelCol=target, solver="normal").fit(df)


def fit_boosted(df: DataFrame, target: str, validation: str | None = None, rounds: int = 20,
                tolerance: float = 0.01, seed: int = 101):
    """Boosted trees; rows flagged by ``validation`` stop the rounds when their loss stalls."""
    extra = {"validationIndicatorCol": validation} if validation else {}
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, seed=seed,
                        validationTol=tolerance, **extra).fit(df)


def encode_2d(df: DataFrame, array_col: str) -> DataFrame:
    """Two principal components of each (centred) vector, as ``x`` and ``y``."""
    vectors = df.withColumn("_v", array_to_vector(F.col(array_col).cast("array<double>")))
    coded = PCA(k=2, inputCol="_v", outputCol="_c").fit(vectors).transform(vectors)
    c = vector_to_array("_c")
    return coded.select(*df.columns, F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))


# ---- quality -------------------------------------------------------------------------------

def accuracy(df: DataFrame, label: str, prediction: str, keys: list[str] = ()) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def roc_auc_ovo(df: DataFrame, label: str, scores: str, classes: list[int]) -> DataFrame:
    """One-vs-one AUC (Hand and Till 2001): per class pair the mean of both one-way AUCs, averaged.

    Rows are counted per pair and score before ranking; ties count one half.
    """
    pairs = list(permutations(classes, 2))
    # a row of class c ranks in (c, other) by score c as positive, in (other, c) as negative
    roles = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    rows = (df.select(F.col(label).alias("_y"), F.col(scores).alias("_s"))
            .withColumn("_r", F.explode(F.filter(
                roles, lambda r: (r["a"] == F.col("_y")) | (r["b"] == F.col("_y")))))
            .select("_r.a", "_r.b", F.get("_s", F.col("_r.a")).cast("double").alias("score"),
                    (F.col("_y") == F.col("_r.a")).cast("long").alias("_pos")))
    counted = rows.groupBy("a", "b", "score").agg(
        F.sum("_pos").alias("pos"), F.sum(1 - F.col("_pos")).alias("neg"))
    ranked = totals_below(counted, "score", ["pos", "neg"], ["a", "b"])
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    one_way = ranked.groupBy("a", "b").agg(
        F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))
    return one_way.agg(F.avg("auc").alias("roc_auc_ovo"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: list,
                     normalise: bool = True) -> DataFrame:
    """One row per true class, one column ``p_<class>`` per predicted class."""
    cells = [F.count_if(F.col(prediction) == c) for c in classes]
    total = F.count(F.lit(1))
    named = [(x / total if normalise else x).alias(f"p_{c}") for x, c in zip(cells, classes)]
    return df.groupBy(label).agg(*named)


def classification_report(df: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """precision, recall, f1 and support per class, plus macro and weighted averages."""
    y, p = F.col(label), F.col(prediction)
    sums = df.agg(*[x for i, c in enumerate(classes) for x in (
        F.count_if((y == c) & (p == c)).alias(f"tp{i}"),
        F.count_if(p == c).alias(f"pp{i}"), F.count_if(y == c).alias(f"n{i}"))])
    rows = sums.select(F.inline(F.array(*[F.struct(
        F.lit(str(c)).alias("class"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp"),
        F.col(f"n{i}").alias("support")) for i, c in enumerate(classes)])))
    per = rows.select(
        "class", F.coalesce(F.try_divide("tp", "pp"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"), "support")
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.coalesce(F.try_divide(
        2 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))

    def averaged(name: str, mean) -> DataFrame:
        return per.agg(F.lit(name).alias("class"), mean("precision").alias("precision"),
                       mean("recall").alias("recall"), F.sum("support").alias("support"),
                       mean("f1").alias("f1"))

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    return per.unionByName(averaged("macro avg", F.avg)).unionByName(
        averaged("weighted avg", weighted))


def promotion_gate(metrics: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Accept the candidate if its r2 is high enough and better by enough, in both senses.

    ``metrics`` has ``run_id, name, value``; the row named ``r2`` of each run is compared.
    """
    r2 = metrics.where(F.col("name") == "r2")
    both = r2.agg(F.max(F.when(F.col("run_id") == baseline, F.col("value"))).alias("baseline"),
                  F.max(F.when(F.col("run_id") == candidate, F.col("value"))).alias("candidate"))
    gain = F.col("candidate") - F.col("baseline")
    ok = ((F.col("candidate") >= MIN_R2) & (gain >= MIN_ABSOLUTE_GAIN)
          & (gain >= MIN_RELATIVE_GAIN * F.abs("baseline")))
    return both.withColumn("accepted", F.coalesce(ok, F.lit(False)))
