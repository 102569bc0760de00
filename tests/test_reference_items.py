"""Gram co-moments, regression chains, inferred CSV types, sparse one-hot vectors, bucketed layout."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import encode, gram, impute, profile
from ledgerline.sources import readers
from ledgerline.sources.layout import bucketed


@pytest.mark.parametrize("big", [50, 10**6, 10**11])
def test_gram_is_exact_with_missing_values(spark, big, monkeypatch):
    monkeypatch.setattr(gram, "ROWS", 64)
    rnd = random.Random(big)
    rows = [tuple(None if rnd.random() < 0.1 else rnd.randint(-big, big) for _ in range(4)) for _ in range(700)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    for r in gram.comoments(df, list("abcd"), dict.fromkeys("abcd", 0)).collect():
        i, j = "abcd".index(r["a"]), "abcd".index(r["b"])
        pairs = [(x[i], x[j]) for x in rows if x[i] is not None and x[j] is not None]
        want = (len(pairs), sum(x for x, _ in pairs), sum(y for _, y in pairs), sum(x * x for x, _ in pairs), sum(y * y for _, y in pairs), sum(x * y for x, y in pairs))
        assert tuple(int(r[m]) for m in gram.MEASURES) == want


def test_matrix_equals_pairwise_aggregates(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 9), None if rnd.random() < 0.2 else round(rnd.uniform(-5, 5), 2), 7.0) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b double, c double")
    scales = {"a": 0, "b": 2, "c": 2}
    for kind in ("corr", "covar"):
        got = {(r["a"], r["b"]): r["value"] for r in profile.correlation_matrix(df, list("abc"), kind=kind, scales=scales).collect()}
        one = profile._corr if kind == "corr" else profile._covar
        assert len(got) == 9
        for (a, b), v in got.items():
            assert v == df.agg(one(a, b, scales)).first()[0]
    assert got["a", "a"] == pytest.approx(statistics.variance(r[0] for r in rows))


def test_two_hundred_columns_in_one_scan(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-1000, 1000, (300, 200))
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"c{i} int" for i in range(200)))
    m = profile.correlation_matrix(df, df.columns, scales=dict.fromkeys(df.columns, 0))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = m.toPandas()
    assert len(got) == 200 * 200
    want = np.corrcoef(x.T)
    at = got.a.str[1:].astype(int), got.b.str[1:].astype(int)
    assert np.allclose(got.value, want[at], atol=1e-12)
    assert profile.correlation_matrix(df.limit(0), ["c0", "c1"], scales={"c0": 0, "c1": 0}).count() == 0


def brute_chain(rows, links, names):
    """Each link by least squares on complete rows, in order."""
    table = {n: np.array([np.nan if r[i] is None else r[i] for r in rows], float) for i, n in enumerate(names)}
    for target, predictors, out in links:
        x = np.column_stack([np.ones(len(rows)), *(table[p] for p in predictors)])
        plain = [p for _, ps, _ in links for p in ps if p in names]
        ok = ~np.isnan(table[target]) & ~np.isnan(np.column_stack([table[p] for p in plain])).any(1)
        beta = np.linalg.lstsq(x[ok], table[target][ok], rcond=None)[0]
        table[out] = np.where(np.isnan(table[target]), x @ beta, table[target])
    return table


def test_regression_chain_equals_link_by_link_fits(spark):
    rnd = random.Random(2)
    names = ["a", "b", "c", "t1", "t2", "t3"]
    rows = []
    for _ in range(400):
        a, b, c = rnd.gauss(1e5, 30), rnd.gauss(0, 1), rnd.randint(0, 3)
        t1, t2 = a / 50 + b + rnd.gauss(0, 0.1), 2 * b - c + rnd.gauss(0, 0.1)
        rows.append((a, b if rnd.random() > 0.03 else None, c, *(None if rnd.random() < 0.3 else t for t in (t1, t2, t1 + t2))))
    df = spark.createDataFrame(rows, "a double, b double, c int, t1 double, t2 double, t3 double")
    links = [("t1", ["a", "b"], "e1"), ("t2", ["b", "c", "e1"], "e2"), ("t3", ["c", "e1", "e2"], "e3")]
    want = brute_chain(rows, links, names)
    got = impute.regression_chain(df, links).collect()
    for i, r in enumerate(got):
        for out in ("e1", "e2", "e3"):
            if np.isnan(want[out][i]):
                assert r[out] is None
            else:
                assert r[out] == pytest.approx(want[out][i], rel=1e-7, abs=1e-6)
    assert impute.regression_chain(df.limit(0), links).count() == 0
    # nothing to learn from: the target stays as it is
    none = impute.regression_chain(df.withColumn("t1", F.lit(None).cast("double")), links[:1])
    assert none.where("e1 is not null").count() == 0


def test_median_of_neighbouring_doubles(spark, monkeypatch):
    """More rows than a small bucket between two neighbouring doubles are counted, not ranked."""
    monkeypatch.setattr(impute, "SMALL_BUCKET", 10)
    x = 1.0
    y = float(np.nextafter(x, 2))
    z = float(np.nextafter(y, 2))
    values = [x] * 40 + [y] * 35 + [z] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert impute.exact_median(df, "v") == statistics.median(values)


def test_inferred_types_and_rejected_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,big,x,flag,name,none,mixed\n1,99999999999999999999,1.5,True,"a, b",,1\n2,3,NA,false,null,NA,x\n+3,4,-2e3,TRUE,c,nan,\n'
        "too,few\n7,1,2,True,d,,3,extra\n4,5,.5,,e,,2\n"
    )
    df = readers.read_csv_inferred(spark, str(tmp_path / "a.csv"))
    types = dict(df.dtypes)
    assert types == {"id": "bigint", "big": "double", "x": "double", "flag": "boolean", "name": "string", "none": "string", "mixed": "string", "_rejected": "string"}
    rows = df.collect()
    good = [tuple(r)[:-1] for r in rows if r["_rejected"] is None]
    assert sorted(good) == [
        (1, 1e20, 1.5, True, "a, b", None, "1"), (2, 3.0, None, False, None, None, "x"), (3, 4.0, -2000.0, True, "c", None, None), (4, 5.0, 0.5, None, "e", None, "2"),
    ]
    assert sorted(r["_rejected"] for r in rows if r["_rejected"]) == ["7,1,2,True,d,,3,extra", "too,few"]
    assert readers.read_csv_inferred(spark, str(tmp_path / "a.csv"), keep_rejected=False).count() == 4


def test_sparse_one_hot_with_many_values(spark):
    from pyspark.ml.classification import LogisticRegression

    df = spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 1000 != 7, F.concat(F.lit("v."), F.col("id") % 12_000)).alias("wide"), (F.col("id") % 3).cast("string").alias("few"),
        (F.col("id") % 3 == 1).cast("double").alias("label"),
    )
    out, sizes = encode.sparse_one_hot(df, ["wide", "few"])
    assert sizes == [12_000 - 12 + 1, 4] and set(out.columns) == {*df.columns, "onehot"}
    for r in out.where("id < 50 or id % 1000 = 7").limit(80).collect():
        assert r["onehot"].size == sum(sizes) and len(r["onehot"].indices) == 2 and set(r["onehot"].values) == {1.0}
        if r["wide"] is None:
            assert r["onehot"].indices[0] == sizes[0] - 1
        assert r["onehot"].indices[1] == sizes[0] + int(r["few"])
    model = LogisticRegression(featuresCol="onehot", labelCol="label", maxIter=5).fit(out)
    assert model.coefficients.size == sum(sizes)
    with pytest.raises(encode.VocabularyTooLarge):
        encode.vocabularies(df, ["wide"])


def test_bucketed_tables_meet_without_exchange(spark):
    a = bucketed(spark.range(500).select((F.col("id") % 50).alias("k"), F.col("id").alias("v")), "k", 4, "a")
    b = bucketed(spark.range(50).select(F.col("id").alias("k2")), "k2", 4, "b")
    agg = a.groupBy("k").agg(F.sum("v").alias("s"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = b.join(agg, b.k2 == agg.k, "left")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert out.count() == 50 and out.agg(F.sum("s")).first()[0] == sum(range(500))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_customer_row_moves_no_rows(spark):
    """Over tables bucketed by customer the joined feature row has no exchange."""
    from ledgerline.plans import jobs

    customers, loans = jobs.bucketed_inputs(spark, "/root/testdata/sf0.001", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = jobs.customer_row(customers, loans)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan and plan.count("Join") >= 2

