"""The registered learners run the scripts' tree counts and depths."""

import pytest

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def test_counts_of_boosting():
    from ledgerline.plans.catalog import _learners

    assert _learners()["fit_xgb_like"][0](None).getMaxIter() == 100


def test_full_boosting(spark, monkeypatch):
    from ledgerline.operators import models
    from ledgerline.plans.catalog import REGISTRY

    def fit(train, features, label, estimator, scale=False):
        raise Seen(estimator.getMaxIter(), estimator.getSubsamplingRate())

    monkeypatch.setattr(models, "fit", fit)
    with pytest.raises(Seen) as seen:
        REGISTRY["fit_gbt_full"][0](spark, SF)
    assert seen.value.args == (800, 0.8)


@pytest.mark.parametrize("name", ["fit_forest", "fit_bagging", "feature_importance", "topk_refit"])
def test_counts_of_forests(spark, monkeypatch, name):
    from ledgerline.operators import trees
    from ledgerline.plans.catalog import REGISTRY

    def forest(*args, n_trees, **kw):
        raise Seen(n_trees)

    def bags(train, features, label, key, n_estimators, rows_per_tree, seed):
        raise Seen(n_estimators, rows_per_tree)

    monkeypatch.setattr(trees, "random_forest", forest)
    monkeypatch.setattr(trees, "bagged_trees", bags)
    with pytest.raises(Seen) as seen:
        REGISTRY[name][0](spark, SF)
    assert seen.value.args == ((1000, 120) if name == "fit_bagging" else (100,))
