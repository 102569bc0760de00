"""Spark ML learners standing in for the scripts' classifiers (T1-T11, C1); boosting is
:mod:`ledgerline.operators.boosting`, with Spark ML's rule and settings.

Training runs on the executors (tree learners aggregate split statistics
per level; linear models aggregate gradients / Gram matrices); the driver
only holds the model. Learners are not bit-equal to the scripts' libraries:
checks compare rows and invariants, never values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.boosting import BoostedTrees


def gradient_boosting(n_trees: int = 100, subsample: float = 1.0, seed: int = 0, **kw) -> BoostedTrees:
    """Boosted depth-3 trees, learning rate 0.1 (the scripts' defaults)."""
    return BoostedTrees(maxIter=n_trees, maxDepth=3, stepSize=0.1, subsamplingRate=subsample, seed=seed, **kw)


def extreme_boosting(n_trees: int = 100, seed: int = 0, **kw) -> BoostedTrees:
    """Deeper boosted trees (depth 6, rate 0.3) in place of XGBoost."""
    return BoostedTrees(maxIter=n_trees, maxDepth=6, stepSize=0.3, seed=seed, **kw)


def leaf_limited_boosting(rounds: int = 20, rate: float = 0.05, feature_fraction: float = 0.5,
                          bagging_fraction: float = 0.5, seed: int = 0, **kw) -> BoostedTrees:
    """Two-leaf stumps, 20 rounds at rate 0.05, half the rows and
    features per round (the LightGBM settings). Its early stop (100) never
    fires before round 20, so no validation set is used."""
    return BoostedTrees(maxIter=rounds, maxDepth=1, stepSize=rate, subsamplingRate=bagging_fraction,
                         featureSubsetStrategy=str(feature_fraction), seed=seed, **kw)


def with_class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """Balanced class weights n / (k · n_class) (the "unbalanced" option of
    the leaf-limited booster): one grouped count, joined as literals."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total, k = sum(counts.values()), len(counts)
    w = F.lit(None).cast("double")
    for value, n in counts.items():
        w = F.when(F.col(label) == F.lit(value), F.lit(total / (k * n))).otherwise(w)
    return df.withColumn(weight_col, w)


def random_forest(n_trees: int = 100, seed: int = 0, **kw) -> RandomForestClassifier:
    """A forest of bounded depth (Spark ML grows at most 30 levels and keeps the model on the
    driver); forests of full depth are :mod:`ledgerline.operators.trees`."""
    return RandomForestClassifier(numTrees=n_trees, seed=seed, **kw)


def logistic(n_rows: int, c: float = 1.0, tol: float = 1e-4, max_iter: int = 100, **kw) -> LogisticRegression:
    """L2-penalised logistic regression with inverse strength ``c``
    (penalty ½‖w‖²/c on the summed loss = regParam 1/(c·n) on the mean);
    stopping tolerance and iteration cap as the scripts' solver defaults."""
    return LogisticRegression(regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0, standardization=False,
                              tol=tol, maxIter=max_iter, **kw)


def linear_svm(n_rows: int | None = None, c: float = 1.0, tol: float = 1e-3, max_iter: int = 100, **kw) -> LinearSVC:
    """Linear-kernel SVM: hinge loss with ½‖w‖² + c·Σ hinge, i.e.
    regParam 1/(c·n) on Spark's mean hinge loss. Scores are margins, not
    probabilities."""
    reg = 0.0 if not n_rows else 1.0 / (c * n_rows)
    return LinearSVC(regParam=reg, tol=tol, maxIter=max_iter, **kw)


def fit(train: DataFrame, features: Sequence[str], label: str, estimator, scale: bool = False) -> PipelineModel:
    """Assemble features (optionally standardise with the *training*
    statistics, C1) and fit. The assembled training frame is what the
    learners iterate over."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    else:
        stages[0].setOutputCol("features")
    estimator = estimator.copy()
    estimator.setFeaturesCol("features").setLabelCol(label)
    stages.append(estimator)
    return Pipeline(stages=stages).fit(train.withColumn(label, F.col(label).cast("double")))


def score(model: PipelineModel, df: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, label, score, prediction). ``score`` is the class-1
    probability, or the class-1 margin for the SVM."""
    return score_fitted(model, df, id_col, label)


def score_fitted(model, df: DataFrame, id_col: str, label: str) -> DataFrame:
    """:func:`score` of any fitted classifier whose input columns ``df`` has."""
    out = model.transform(df)
    if "probability" in out.columns:
        s = vector_to_array("probability")[1]
    else:
        s = vector_to_array("rawPrediction")[1]
    return out.select(
        F.col(id_col).alias("id"),
        F.col(label).cast("int").alias("label"),
        s.alias("score"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance), most important first (tree models)."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda t: (-t[1], t[0]))


def importance_frame(spark, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(importances(model, features), "feature string, importance double")


def standardise(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str], ddof: int = 0) -> list[DataFrame]:
    """C1 on plain columns: z-scores with the training mean and standard
    deviation (``ddof`` 0 as the scripts' scaler; Spark ML's scaler uses 1),
    applied to every frame given — the test rows never set the statistics."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[sd(c).alias(f"s_{c}") for c in cols]).first()
    def apply(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: F.try_divide(F.col(c) - F.lit(stats[f"m_{c}"]), F.lit(stats[f"s_{c}"])) for c in cols}
        )
    return [apply(train)] + [apply(o) for o in others]
