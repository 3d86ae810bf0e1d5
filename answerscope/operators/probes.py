"""Probes: linear models fitted by MLlib with the settings of the usual single-node library.

The inverse strength C of a logistic model becomes ``regParam = 1 / (C n)``.  Features are
standardised with population deviations there and sample deviations in MLlib; scaling them by
a constant is the same as scaling the penalty, hence the factor (n - 1) / n.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, NGram, Normalizer, OneHotEncoder, RegexTokenizer, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.operators import metrics, selection
from answerscope.session import cut_lineage

FEATURES = "__features"


def with_vector(df: DataFrame, *columns: str, name: str = FEATURES) -> DataFrame:
    """One MLlib vector from an array column, or from several numeric columns."""
    if len(columns) == 1 and df.schema[columns[0]].dataType.typeName() == "array":
        values = F.col(columns[0]).cast("array<double>")
    else:
        values = F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn(name, array_to_vector(values))


class Probe:
    """A fitted linear model that adds its score to any table with the same feature column."""

    def __init__(self, stages, score: Callable[[], Column], classes: Sequence[str] = ()):
        self._stages, self._score, self.classes = stages, score, list(classes)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        out = df
        for stage in self._stages:
            out = stage.transform(out)
        added = [c for c in out.columns if c not in df.columns]
        return out.withColumn(name, self._score()).drop(*[c for c in added if c != name])


def _class_counts(train: DataFrame, label: str) -> dict:
    """Rows per class: the number of classes is fixed, so this is a handful of numbers."""
    return {r[label]: r["count"] for r in train.groupBy(label).count().collect()}


def fit_logistic(train: DataFrame, label: Column, c: float, features: str = FEATURES, balanced: bool = False, centre: bool = True,
                 standardise: bool = True, max_iter: int = 500, tolerance: float = 1e-8) -> Probe:
    """L2 logistic probe, score = margin of the positive class."""
    data = train.select(F.col(features), label.cast("double").alias("__label")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = _class_counts(data, "__label")
    n = sum(counts.values())
    weighted = data
    if balanced:
        pieces = F.lit(1.0)
        for value, count in counts.items():
            pieces = F.when(F.col("__label") == value, F.lit(n / (len(counts) * count))).otherwise(pieces)
        weighted = data.withColumn("__weight", pieces)
    scaled = "__scaled" if standardise else features
    model = LogisticRegression(featuresCol=scaled, labelCol="__label", predictionCol="__prediction", rawPredictionCol="__raw", probabilityCol="__probability",
                               regParam=1.0 / (c * n) * ((n - 1) / n if standardise else 1.0), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tolerance)
    if balanced:
        model = model.setWeightCol("__weight")
    stages = [StandardScaler(inputCol=features, outputCol="__scaled", withMean=centre, withStd=True)] if standardise else []
    fitted = Pipeline(stages=[*stages, model]).fit(weighted)
    data.unpersist()
    return Probe(fitted.stages, lambda: vector_to_array("__raw")[1])


def fit_multinomial(train: DataFrame, label: str, c: float = 0.01, features: str = FEATURES, max_iter: int = 300, standardise: bool = True) -> Probe:
    """Class-balanced multinomial model; the score is the predicted class name."""
    data = train.select(F.col(features), F.col(label).alias("__class")).persist(StorageLevel.MEMORY_AND_DISK)
    counts = _class_counts(data, "__class")
    classes = sorted(counts)
    n = sum(counts.values())
    index, weight = F.lit(None).cast("double"), F.lit(1.0)
    for i, name in enumerate(classes):
        index = F.when(F.col("__class") == name, F.lit(float(i))).otherwise(index)
        weight = F.when(F.col("__class") == name, F.lit(n / (len(classes) * counts[name]))).otherwise(weight)
    ready = data.withColumn("__label", index).withColumn("__weight", weight)
    scaled = "__scaled" if standardise else features
    model = LogisticRegression(featuresCol=scaled, labelCol="__label", weightCol="__weight", predictionCol="__prediction", rawPredictionCol="__raw",
                               probabilityCol="__probability", family="multinomial", regParam=1.0 / (c * n) * ((n - 1) / n if standardise else 1.0),
                               standardization=False, maxIter=max_iter, tol=1e-8)
    stages = [StandardScaler(inputCol=features, outputCol="__scaled", withMean=True, withStd=True)] if standardise else []
    fitted = Pipeline(stages=[*stages, model]).fit(ready)
    data.unpersist()
    names = F.array(*[F.lit(x) for x in classes])
    return Probe(fitted.stages, lambda: F.get(names, F.col("__prediction").cast("int")), classes)


def fit_ridge(train: DataFrame, target: Column, alpha: float, features: str = FEATURES) -> Probe:
    """Ridge on standardised features; the normal equations need one pass over the rows."""
    data = train.select(F.col(features), target.cast("double").alias("__label")).persist(StorageLevel.MEMORY_AND_DISK)
    stats = data.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("__label").alias("sd")).first()
    n = stats["n"]
    penalty = alpha / n * stats["sd"] * (n - 1) / n
    model = LinearRegression(featuresCol="__scaled", labelCol="__label", predictionCol="__prediction", regParam=penalty, solver="normal", standardization=False)
    fitted = Pipeline(stages=[StandardScaler(inputCol=features, outputCol="__scaled", withMean=True, withStd=True), model]).fit(data)
    data.unpersist()
    return Probe(fitted.stages, lambda: F.col("__prediction"))


def choose_ridge(dev: DataFrame, target: Column, inner: Column, alphas: Sequence[float], features: str = FEATURES) -> tuple[float, list[tuple[float, float]]]:
    """The penalty with the best rank correlation on a held-out part of dev; the first wins a tie."""
    marked = dev.withColumn("__inner", inner).withColumn("__target", target.cast("double"))
    scores = []
    for alpha in alphas:
        probe = fit_ridge(marked.where(~F.col("__inner")), F.col("__target"), alpha, features)
        held = probe.score(marked.where("__inner"), "__p")
        scores.append((alpha, metrics.spearman(held, "__p", "__target").first()["rho"]))
    return max(scores, key=lambda s: s[1])[0], scores


def fit_text_features(train: DataFrame, text: str, name: str = FEATURES, min_docs: int = 2, max_terms: int = 5000) -> Callable[[DataFrame], DataFrame]:
    """Tf-idf of words and word pairs, idf = ln((1 + n) / (1 + df)) + 1, unit length.

    The most frequent ``max_terms`` terms are kept; the vocabulary is bounded by that number.
    """
    tokens = RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True)
    pairs = NGram(n=2, inputCol="__tokens", outputCol="__pairs")

    def terms(df: DataFrame) -> DataFrame:
        filled = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
        return pairs.transform(tokens.transform(filled)).withColumn("__terms", F.concat("__tokens", "__pairs")).drop("__tokens", "__pairs")

    counted = CountVectorizer(inputCol="__terms", outputCol="__tf", vocabSize=max_terms, minDF=min_docs).fit(terms(train))
    frequency = IDF(inputCol="__tf", outputCol="__unused").fit(counted.transform(terms(train)).select("__tf"))
    idf = np.log((1.0 + frequency.numDocs) / (1.0 + np.asarray(frequency.docFreq, dtype=float))) + 1.0
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__tfidf")
    unit = Normalizer(p=2.0, inputCol="__tfidf", outputCol=name)

    def transform(df: DataFrame) -> DataFrame:
        return unit.transform(weigh.transform(counted.transform(terms(df)))).drop("__terms", "__tf", "__tfidf")

    transform.vocabulary = counted.vocabulary
    return transform


def fit_category_features(train: DataFrame, category: str, name: str = FEATURES) -> Callable[[DataFrame], DataFrame]:
    """One-hot category; a category not seen in training is all zeros."""
    indexer = StringIndexer(inputCol=category, outputCol="__index", handleInvalid="keep").fit(train)
    encoder = OneHotEncoder(inputCol="__index", outputCol=name, handleInvalid="keep", dropLast=True).fit(indexer.transform(train))
    return lambda df: encoder.transform(indexer.transform(df)).drop("__index")


def sparse_features(acts: DataFrame, rows: DataFrame, picked: DataFrame, log: bool = True, centre_by: str | None = None, name: str = FEATURES) -> DataFrame:
    """Picked features as one vector per row, log1p and centred inside the fact if wished.

    ``picked`` is (latent, place) with places 0 .. K-1.  A fact's mean is a sum over its active
    entries divided by its row count.
    """
    picked = cut_lineage(picked)
    k = picked.count()
    value = F.log1p(F.col("a").cast("double")) if log else F.col("a").cast("double")
    active = acts.where(F.col("a") > 0).join(picked, "latent").select("row_id", "place", value.alias("v"))
    entries = active.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("__m"))
    out = rows.join(entries, "row_id", "left")
    zero = F.lit(0.0)
    places = F.sequence(F.lit(0), F.lit(k - 1))
    if centre_by:
        sizes = rows.groupBy(centre_by).agg(F.count(F.lit(1)).alias("__n"))
        sums = active.join(rows.select("row_id", centre_by), "row_id").groupBy(centre_by, "place").agg(F.sum("v").alias("s"))
        means = sums.join(sizes, centre_by).groupBy(centre_by).agg(
            F.map_from_entries(F.collect_list(F.struct("place", (F.col("s") / F.col("__n")).alias("m")))).alias("__c"))
        out = out.join(means, centre_by, "left")
        dense = F.transform(places, lambda i: F.coalesce(F.try_element_at("__m", i), zero) - F.coalesce(F.try_element_at("__c", i), zero))
        return out.withColumn(name, array_to_vector(dense)).drop("__m", "__c")
    dense = F.transform(places, lambda i: F.coalesce(F.try_element_at("__m", i), zero))
    return out.withColumn(name, array_to_vector(dense)).drop("__m")


def cross_fit(df: DataFrame, fit: Callable[[DataFrame], Probe], folds: int = 5, fold: str = "fold", train_rows: Column | None = None,
              score_rows: Column | None = None, cap: int | None = 20_000, row_id: str = "row_id", name: str = "score") -> DataFrame:
    """P10: fit on all other folds, score the held-out one; rows outside ``score_rows`` get NULL.

    ``cap`` bounds the rows of a fit by hash (F12); None trains on everything.
    """
    out = None
    for g in range(folds):
        train = df.where(F.col(fold) != g)
        if train_rows is not None:
            train = train.where(train_rows)
        if cap is not None:
            train = selection.cap_rows(train, cap, row_id)
        scored = fit(train).score(df.where(F.col(fold) == g), name)
        if score_rows is not None:
            scored = scored.withColumn(name, F.when(score_rows, F.col(name)))
        out = scored if out is None else out.unionByName(scored)
    return out


def sweep(dev: DataFrame, configurations: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], folds: int = 5, inner: str = "inner_fold",
          label: str = "correct", fact: str = "fact") -> list[tuple[str, float]]:
    """Mean within-fact AUROC over dev folds for named (train, evaluate) -> scored functions.

    The driver loops over configurations and folds; every fit and score is a Spark job.
    """
    results = []
    for name, run in configurations.items():
        per_fold = []
        for g in range(folds):
            scored = run(dev.where(F.col(inner) != g), dev.where(F.col(inner) == g))
            mean = metrics.mean_over_groups(metrics.auroc(scored, "score", F.col(label), [fact])).first()["mean_auc"]
            if mean is not None:
                per_fold.append(mean)
        results.append((name, sum(per_fold) / len(per_fold) if per_fold else float("nan")))
    return results


def layer_step_sweep(states: DataFrame, layers: Sequence[int], steps: Sequence[int], score: Callable[[DataFrame], float]) -> list[tuple[int, int, float]]:
    """One number per (layer, step); both are partition columns, so each fit reads one slice."""
    return [(layer, step, score(states.where((F.col("layer") == layer) & (F.col("step") == step)))) for layer in layers for step in steps]
