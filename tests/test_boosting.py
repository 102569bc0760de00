"""Boosting from packed blocks has the scores of Spark ML's rule, and takes over for many rows."""

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

FEATURES = ["f0", "f1", "f2", "f3"]


def _rows(spark, n=600):
    rows = spark.range(0, n, 1, 3).select(
        "id", *[(F.abs(F.xxhash64("id", F.lit(i))) % (7 + 3 * i)).cast("double").alias(f"f{i}") for i in range(4)]
    ).withColumn("label", (F.col("f0") + F.col("f1") * F.col("f2") / 10 + F.abs(F.xxhash64("id", F.lit(99))) % 5 > 9).cast("int"))
    return rows.withColumn("w", F.lit(0.5) + F.col("label"))


@pytest.fixture
def packed(monkeypatch):
    from ledgerline.operators import boosting

    monkeypatch.setattr(boosting, "SMALL_ROWS", 0)
    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "FRESH", 4)
    return boosting


@pytest.mark.parametrize("weight", [None, "w"])
def test_scores_of_spark_ml(spark, packed, weight):
    from ledgerline.operators import models

    kw = {"maxIter": 7, "maxDepth": 3, "stepSize": 0.3} | ({"weightCol": weight} if weight else {})
    rows = _rows(spark)
    ours, theirs = models.fit(rows, FEATURES, "label", packed.BoostedTrees(**kw)), models.fit(rows, FEATURES, "label", GBTClassifier(**kw))
    assert isinstance(ours.stages[-1], packed.BoostedModel)
    a, b = ({r["id"]: (r["score"], r["prediction"]) for r in models.score(m, rows, "id", "label").collect()} for m in (ours, theirs))
    assert len(a) == 600 and all(abs(a[i][0] - b[i][0]) < 1e-9 and a[i][1] == b[i][1] for i in b)
    shares = dict(models.importances(theirs, FEATURES))
    assert all(abs(v - shares[f]) < 1e-6 for f, v in models.importances(ours, FEATURES))


def test_share_of_rows_and_features(spark, packed):
    """Half of the rows and features per tree still find the signal; the same seed the same trees."""
    from ledgerline.operators import evaluate, models

    rows = _rows(spark, 300)
    one, two = (models.fit(rows, FEATURES, "label", models.leaf_limited_boosting(rounds=6)) for _ in range(2))
    scored = models.score(one, rows, "id", "label")
    assert evaluate.roc_auc(scored).first()["auc"] > 0.6
    assert [t[0].tolist() for t in one.stages[-1].trees] == [t[0].tolist() for t in two.stages[-1].trees]


@pytest.mark.parametrize("labels", [0, 1])
def test_one_class(spark, packed, labels):
    from ledgerline.operators import models

    rows = _rows(spark, 50).withColumn("label", F.lit(labels))
    scored = models.score(models.fit(rows, FEATURES, "label", models.extreme_boosting(2)), rows, "id", "label")
    assert {r["prediction"] for r in scored.collect()} == {labels}


def test_few_rows_stay_with_spark_ml(spark):
    from ledgerline.operators import models

    fitted = models.fit(_rows(spark, 100), FEATURES, "label", models.gradient_boosting(3, subsample=0.8)).stages[-1]
    assert (fitted.getNumTrees, fitted.getOrDefault("maxDepth"), fitted.getOrDefault("subsamplingRate")) == (3, 3, 0.8)


def test_odd_training_rows_raise(spark, packed):
    """As Spark ML does: a missing feature, or a label other than 0 and 1."""
    from ledgerline.operators import models

    rows = _rows(spark, 50)
    for odd in (rows.withColumn("f3", F.when(F.col("id") != 7, F.col("f3"))), rows.withColumn("label", F.lit(2))):
        with pytest.raises(Exception, match="training rows need"):
            models.fit(odd, FEATURES, "label", models.extreme_boosting(2))


@pytest.mark.parametrize("level", [0, 2])
def test_features_share_a_pass_over_the_rows(monkeypatch, level):
    """A level had two passes over the rows for each feature; features of few bins share them."""
    import numpy as np

    from ledgerline.operators import boosting

    rnd = np.random.default_rng(1)
    widths, n = [5, 32, 3, 7, 32], 400
    bins, y, margin = np.array([rnd.integers(0, w, n) for w in widths], np.uint8), rnd.integers(0, 2, n).astype(np.uint8), rnd.normal(size=n)
    tree = (np.full(15, -1), np.zeros(15, np.intp), np.zeros(15))
    tree[0][0], tree[1][0], tree[0][2], tree[1][2] = 1, 20, 0, 1
    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: calls.append(1) or bincount(*a))
    block = ((0, 0), bins.tobytes(), y.tobytes(), b"", margin.tobytes())
    got = next(boosting._histograms([block], tree, level, 3, widths, 1.0, 0, [], 0, 0.1)).reshape(2, 1 << level, -1)
    assert len(boosting._shared(widths)) == 2 and len(calls) == 4
    sign = y * 2.0 - 1.0
    target = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
    # the root sends rows right above bin 20 of feature 1, its right child above bin 1 of feature 0
    right = bins[1] > 20
    node = np.where(right, 2 + (bins[0] > 1), 0) if level else np.zeros(n, int)
    start = 0
    for f, width in enumerate(widths):
        for i in range(1 << level):
            for b in range(width):
                rows = (node == i) & (bins[f] == b)
                assert got[0, i, start + b] == rows.sum() and abs(got[1, i, start + b] - target[rows].sum()) < 1e-9
        start += width
