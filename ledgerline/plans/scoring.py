"""Scoring job (F12): split → rebalance → (scale) → fit → score → evaluate,
top-k feature refit.

Every step is distributed: the split and the rebalancing are key-hash
functions (repeatable after a task retry), fitting is Spark ML, evaluation
is aggregate queries. The modelling frame is written to the shared
checkpoint folder once, so the split, the learners' many passes, scoring
and any executor loss re-read it instead of recomputing the features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import evaluate, models, sampling, trees
from ledgerline.session import cores, cut_lineage


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    features: list[str]
    label: str
    id_col: str


def prepare(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    id_col: str,
    test_percent: int = 20,
    rebalance: bool = True,
    checkpoint: bool = True,
) -> Split:
    """M1 + M2: key-hash split, then as many draws with replacement from the minority class of
    the training part as its majority has rows. The training part is written once more: its
    ranks and joins would otherwise run again in every pass of a learner."""
    cols = [id_col, label, *features]
    frame = df.select(*cols)
    if checkpoint:
        # split, rebalancing, the learners' passes and test scoring all
        # re-read this instead of recomputing the features upstream
        frame = cut_lineage(frame, min_partitions=cores(df.sparkSession))
    train, test = sampling.train_test(frame, id_col, test_percent)
    if rebalance:
        # the copy number stays: it tells draws of one row apart
        train = cut_lineage(sampling.bootstrap(train, label, id_col), min_partitions=cores(df.sparkSession))
    return Split(train, test, list(features), label, id_col)


def fit_score(split: Split, estimator, scale: bool = False):
    """Fit on the training part, score the test part: (model, scored)."""
    model = models.fit(split.train, split.features, split.label, estimator, scale=scale)
    return model, models.score(model, split.test, split.id_col, split.label)


def fit_score_forest(split: Split, n_trees: int = 100, seed: int = 0):
    """A forest of full depth on the training part, the test part scored: (forest, scored)."""
    copy = F.col("copy") if "copy" in split.train.columns else F.lit(0)
    key = F.concat_ws("|", F.col(split.id_col).cast("string"), copy.cast("string"))
    forest = trees.random_forest(split.train, split.features, split.label, key, n_trees=n_trees, seed=seed)
    return forest, forest.score(split.test, split.id_col, split.label, ranked=True)


def fit_score_bagged(split: Split, n_estimators: int = 1000, rows_per_tree: int = 120, seed: int = 123):
    """Trees of full depth on exact bags of the training part: (forest, scored)."""
    key = [split.id_col] + (["copy"] if "copy" in split.train.columns else [])
    forest = trees.bagged_trees(split.train, split.features, split.label, key, n_estimators, rows_per_tree, seed)
    return forest, forest.score(split.test, split.id_col, split.label)


def evaluation(scored: DataFrame, model_name: str) -> DataFrame:
    """V1-V4 and V6 of one model (model, metric, value): see :func:`evaluate.compare`."""
    return evaluate.compare(scored.withColumn("model", F.lit(model_name)), sweep=False)


def top_features(model, features: Sequence[str], k: int) -> list[str]:
    """The k most important features of a tree model."""
    if isinstance(model, trees.Forest):
        rows = model.importances().orderBy(F.desc("importance"), "feature").limit(k).collect()
        return [r["feature"] for r in rows]
    return [f for f, _ in models.importances(model, features)[:k]]


def scoring_job(df: DataFrame, features: Sequence[str], label: str, id_col: str, k: int = 30, test_percent: int = 20, n_estimators: int = 1000) -> DataFrame:
    """F12 from the forest on (T5, T10, T11, T4, T6, V1-V5): importances of a forest of full depth,
    a new split and rebalancing of all rows on the ``k`` most important features (all where there
    are fewer), a bagged and a standardised logistic refit; (model, metric, value).

    As in the scripts the second split has the seed of the first: key hashes give the same rows."""
    frame = cut_lineage(df.select(id_col, label, *features), min_partitions=cores(df.sparkSession))
    first = prepare(frame, features, label, id_col, test_percent, checkpoint=False)
    forest, _ = fit_score_forest(first)
    again = prepare(frame, top_features(forest, features, k), label, id_col, test_percent, checkpoint=False)
    _, bagged = fit_score_bagged(again, n_estimators)
    train, test = models.standardise(again.train, [again.test], again.features)
    scaled = Split(train, test, again.features, label, id_col)
    _, logistic = fit_score(scaled, models.logistic(train.count()))
    both = bagged.withColumn("model", F.lit("bagged_refit")).unionByName(logistic.withColumn("model", F.lit("logistic_refit")))
    return evaluate.compare(both)
