"""The scoring job (F12) as one query: refits on the top features, evaluated on their own scores."""

import math
import random

SF = "/root/testdata/sf0.001"


def test_scoring_job(spark):
    from ledgerline.plans.catalog import REGISTRY, _modelling_split

    rows = REGISTRY["scoring_job"][0](spark, SF).collect()
    by = {(r["model"], r["metric"]): r["value"] for r in rows}
    assert len(by) == len(rows) and {m for m, _ in by} == {"bagged_refit", "logistic_refit"}
    n = _modelling_split(spark, SF).test.count()
    for model in ("bagged_refit", "logistic_refit"):
        assert by[model, "0 support"] + by[model, "1 support"] == n
        assert sum(v for (m, name), v in by.items() if m == model and " predicted " in name) == n
        sweep = {name: v for (m, name), v in by.items() if m == model and " above " in name}
        assert len(sweep) == 300 and sweep["recall above 0.00"] >= sweep["recall above 0.50"] >= sweep["recall above 0.99"]
        # the models predict 1 above 0.5, so the sweep of their own scores meets the report there
        for measure in ("precision", "recall", "f1"):
            assert math.isclose(sweep[f"{measure} above 0.50"], by[model, f"1 {measure}"], abs_tol=1e-12)
        assert 0 <= by[model, "roc_auc"] <= 1


def test_top_features_carry_the_signal(spark):
    """40 features of which the first decides: both refits on the top 30 find it."""
    from ledgerline.plans import scoring

    rnd = random.Random(7)
    names = [f"f{i}" for i in range(40)]
    rows = []
    for i in range(400):
        x = [rnd.gauss(0, 1) for _ in names]
        rows.append((i, int(x[0] + rnd.gauss(0, 0.2) > 0.6), *x))
    frame = spark.createDataFrame(rows, "id long, label int, " + ", ".join(f"{n} double" for n in names))
    out = scoring.scoring_job(frame, names, "label", "id", n_estimators=60).where("metric = 'roc_auc'").collect()
    assert len(out) == 2 and all(r["value"] > 0.9 for r in out)
