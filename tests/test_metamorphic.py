"""Metamorphic and invariant checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import evaluate, grouped

SF = "/root/testdata/sf0.001"


def test_attach_group_stat_equals_window(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = grouped.attach_group_stat(o, "o_custkey", {"m": F.max("o_totalprice"), "n": F.count(F.lit(1))})
    w = Window.partitionBy("o_custkey")
    windowed = o.withColumns({"m": F.max("o_totalprice").over(w), "n": F.count(F.lit(1)).over(w)})
    cols = ["o_orderkey", "o_custkey", "m", "n"]
    assert sorted(map(tuple, joined.select(*cols).collect())) == sorted(map(tuple, windowed.select(*cols).collect()))


def test_exact_auc_equals_evaluator_without_bins(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    scored = li.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") * 10 + F.col("l_tax")).alias("score"),
    )
    ours = evaluate.roc_auc(scored).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC", numBins=0)
    theirs = ev.evaluate(scored.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - theirs) < 1e-12


def test_model_invariants(spark):
    from ledgerline.operators import models
    from ledgerline.plans import catalog, scoring

    split = catalog._modelling_split(spark, SF)
    train_keys = split.train.select("o_orderkey").distinct()
    assert train_keys.join(split.test.select("o_orderkey"), "o_orderkey").count() == 0
    balance = {r[0]: r[1] for r in split.train.groupBy("label").count().collect()}
    assert balance[0] == balance[1]
    model, scored = scoring.fit_score(split, models.random_forest(10))
    imp = models.importances(model, split.features)
    assert abs(sum(v for _, v in imp) - 1.0) < 1e-9
    bad = scored.where((F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull()).count()
    assert bad == 0 and scored.count() == split.test.count()
