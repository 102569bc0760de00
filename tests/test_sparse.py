"""One-hot vectors and their logistic fit with nothing per place on the driver."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import encode, sparse


def lines(spark, n=3000):
    df = spark.range(n).select("id", (F.col("id") * 7 % 40).cast("string").alias("part"), F.expr("id div 40 % 5").alias("s"))
    turned = F.pmod(F.xxhash64("id"), F.lit(10)) < 2
    return df.select(
        "id", F.when(F.col("part") != "3", F.col("part")).alias("part"), F.concat_ws("-", "part", "s").alias("pair"),
        ((F.col("part").cast("int") % 3 == 0) != turned).cast("int").alias("label"),
    )


def test_vectors_name_no_place(spark):
    """The encoder's output once had an attribute per value in its metadata, held by the driver."""
    out, sizes = encode.sparse_one_hot(lines(spark), ["part", "pair"])
    assert out.schema["onehot"].metadata == {}
    rows = out.withColumn("at", encode.places("onehot")).limit(50).collect()
    assert all(r["at"] == r["onehot"].indices.tolist() and r["onehot"].size == sum(sizes) for r in rows)


def test_fit_is_the_minimum_that_spark_ml_finds(spark):
    from pyspark.ml.classification import LogisticRegression

    out, sizes = encode.sparse_one_hot(lines(spark), ["part", "pair"])
    out = out.cache()
    ours = sparse.sparse_logistic(out, "label", "onehot", "part", sum(sizes), reg=1e-2)
    small = sparse.sparse_logistic(out.repartition(5), "label", "onehot", "part", sum(sizes), reg=1e-2, rows_per_block=20)
    theirs = LogisticRegression(featuresCol="onehot", labelCol="label", regParam=1e-2, maxIter=500, tol=1e-12).fit(out)
    got = {r["place"]: r["coefficient"] for r in ours.coefficients.collect()}
    assert abs(ours.intercept - theirs.intercept) < 1e-3 and ours.size == theirs.coefficients.size
    assert all(abs(theirs.coefficients[p] - c) < 1e-3 for p, c in got.items()) and len(got) > 150
    assert all(abs(got[r["place"]] - r["coefficient"]) < 1e-3 for r in small.coefficients.collect())
    scored = {r["id"]: r for r in ours.score(out, "id", "label").collect()}
    assert len(scored) == 3000
    for r in theirs.transform(out).collect():
        assert abs(scored[r["id"]]["score"] - r["probability"][1]) < 1e-3


def test_places_under_several_values_are_an_error(spark):
    out, sizes = encode.sparse_one_hot(lines(spark).withColumn("pair", F.col("id") % 2), ["part", "pair"])
    with pytest.raises(sparse.NotNested):
        sparse.sparse_logistic(out, "label", "onehot", "part", sum(sizes), rows_per_block=4)


def test_one_class_and_unseen_places(spark):
    out, sizes = encode.sparse_one_hot(lines(spark, 200), ["part", "pair"])
    ones = sparse.sparse_logistic(out.where("label = 1"), "label", "onehot", "part", sum(sizes))
    assert ones.intercept == math.inf and {r["score"] for r in ones.score(out, "id", "label").collect()} == {1.0}
    some = sparse.sparse_logistic(out.where("id < 20"), "label", "onehot", "part", sum(sizes))
    assert some.score(out, "id", "label").where("score between 0 and 1").count() == 200


def test_query_keeps_no_model_of_the_driver(spark, monkeypatch):
    """``sparse_logistic`` fitted Spark ML's learner, whose arrays of all places fill the driver."""
    from pyspark.ml.classification import LogisticRegression

    from ledgerline.plans.catalog import REGISTRY

    monkeypatch.setattr(LogisticRegression, "fit", lambda *a, **k: pytest.fail("a fit on the driver"))
    row = REGISTRY["sparse_logistic"][0](spark, "/root/testdata/sf0.001").first()
    assert row["n_coefficients"] > 2000 and row["n_test"] > 500


def test_vectors_are_made_from_what_is_written(spark, monkeypatch):
    """The vectors and their copies of the dictionaries were written whole."""
    from ledgerline.operators import ranking

    seen, cut = [], ranking.cut_lineage
    for module in (ranking, encode):
        monkeypatch.setattr(module, "cut_lineage", lambda df, **kw: seen.append(df.columns) or cut(df, **kw))
    df = lines(spark, 300)
    out, sizes = encode.sparse_one_hot(df, ["part", "pair"], written=["id", "label"])
    assert seen == [["_value", "_range"], ["_value", "_range"], ["id", "label", "part_position", "pair_position"]]
    assert out.columns == ["id", "label", "onehot"]
    plain, again = encode.sparse_one_hot(df, ["part", "pair"])
    assert sizes == again and {r["id"]: r["onehot"] for r in out.collect()} == {r["id"]: r["onehot"] for r in plain.collect()}


def test_ranks_by_columns_and_expressions(spark):
    from ledgerline.operators.ranking import global_rank

    df = spark.range(50).select("id", (F.col("id") * 7 % 10).alias("k"))
    ranked = global_rank(df, ["k", -F.col("id")], "place")
    assert ranked.columns == ["id", "k", "place"]
    assert [r["id"] for r in ranked.orderBy("place").collect()] == sorted(range(50), key=lambda i: (i * 7 % 10, -i))
