"""Micro-fixtures for the missing-value / zero / order traps."""

import math

from pyspark.sql import functions as F

from ledgerline.functions import rows as R
from ledgerline.functions.aggs import Recipe, share_columns
from ledgerline.operators import encode, grouped, history, profile


def test_null_group_aggregates(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "u"), ("a", None, None), ("b", None, "v"), ("b", None, "v"), ("c", 5.0, None), (None, 7.0, "u")],
        "k string, x double, s string",
    )
    spec = {"x": ["sum", "mean", "var", "count", "size"], "s": ["nunique"]}
    out = {r["k"]: r for r in grouped.group_features(df, "k", [Recipe(spec)]).collect()}
    assert set(out) == {"a", "b", "c"}  # null key dropped
    assert [out[k]["x_SUM"] for k in "abc"] == [1.0, 0.0, 5.0]  # all-missing sum is 0
    assert out["a"]["x_MEAN"] == 1.0 and out["b"]["x_MEAN"] is None
    assert all(out[k]["x_VAR"] is None for k in "abc")  # n <= 1
    assert [out[k]["x_COUNT"] for k in "abc"] == [1, 0, 1]
    assert [out[k]["x_SIZE"] for k in "abc"] == [2, 2, 1]
    assert [out[k]["s_NUNIQUE"] for k in "abc"] == [1, 1, 0]


def test_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (None, 1.0), (3.0, 2.0)], "num double, den double")
    got = [r[0] for r in df.select(R.ratio("num", "den")).collect()]
    assert got == [None, None, None, None, 1.5]


def test_status_flags_and_clamp(spark):
    df = spark.createDataFrame([("Closed", -1.0), ("Active", 0.0), (None, None)], "c string, d double")
    got = df.select(R.flag_unless_equal("c", "Closed"), R.flag_unless_negative("d"), R.clamp_zero("d")).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0.0), (1, 1, 0.0), (1, 1, 0.0)]


def test_not_equal_keeps_missing_and_factorize(spark):
    df = spark.createDataFrame([(1, "M"), (2, "F"), (3, None), (4, "M"), (5, "XNA")], "id int, g string")
    kept = df.where(R.not_value_keep_missing("g", "XNA"))
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 4]
    codes = encode.factorize(kept, ["g"], [F.col("id")])
    assert [r.g for r in codes.orderBy("id").collect()] == [0, 1, -1, 0]


def test_sentinel_and_indicators(spark):
    df = spark.createDataFrame([(365243.0,), (-10.0,), (None,)], "d double")
    got = df.select(R.sentinel_to_null("d").alias("d")).select("d", R.missing_indicator("d")).collect()
    assert [tuple(r) for r in got] == [(None, 1), (-10.0, 0), (None, 1)]


def test_row_sum_inversion_order(spark):
    df = spark.createDataFrame([(1, 0, None), (None, None, None), (1, 1, 1), (0, 1, 0)], "a int, b int, c int")
    got = df.select(R.row_sum(["a", "b"]), R.row_sum(["a", "b", R.invert_flag("c")])).collect()
    # a missing flag inverts to missing and is skipped by the total
    assert [tuple(r) for r in got] == [(1, 1), (0, 0), (2, 2), (1, 2)]


def test_history_last_n_and_last_value(spark):
    df = spark.createDataFrame(
        [("k", 1, 10, "A", 1.0), ("k", 2, 20, "R", 2.0), ("k", 3, 20, "A", 3.0), ("k", 4, None, "R", 4.0),
         ("k", 5, 5, "A", None), ("j", 6, 1, "R", 6.0), ("j", 7, 2, "A", 8.0), ("j", 8, 2, "R", None)],
        "k string, id int, t int, status string, v double",
    )
    top = history.latest_rows(df, "k", "t", "id", 3, salt_buckets=4)
    ranked = {(r.k, r.recency): r.id for r in top.collect()}
    # missing time is latest, then larger t, ties by larger id
    assert ranked[("k", 1)] == 4 and ranked[("k", 2)] == 3 and ranked[("k", 3)] == 2
    assert ranked[("j", 1)] == 8 and ranked[("j", 2)] == 7
    means = {r.k: r for r in history.last_n_means(df, "k", "t", "id", {"v": "v_{n}"}, (1, 3, 5), salt_buckets=4).collect()}
    assert means["k"]["v_1"] == 4.0 and means["k"]["v_3"] == 3.0 and means["k"]["v_5"] == 2.5
    assert means["j"]["v_1"] is None and means["j"]["v_3"] == 7.0
    last = {r.k: r.s for r in history.last_value(df, "k", "t", "id", {"s": F.col("status")}).collect()}
    assert last == {"k": "R", "j": "R"}


def test_family_missing_versus_zero(spark):
    df = spark.createDataFrame(
        [("a", 1, 2.0), ("a", 0, 3.0), ("b", 0, 4.0), ("c", 1, None), ("c", 1, None), ("c", 0, 1.0)],
        "k string, active int, amt double",
    )
    r = Recipe({"amt": ["sum", "mean"]}, prefix="ALL_", families={"ACTIVE_": F.col("active") == 1})
    out = {x.k: x for x in grouped.group_features(df, "k", [r]).collect()}
    assert out["a"]["ACTIVE_amt_SUM"] == 2.0
    assert out["b"]["ACTIVE_amt_SUM"] is None  # no active row: missing, as the left join gave
    assert out["c"]["ACTIVE_amt_SUM"] == 0.0  # active rows, all amounts missing: 0
    assert out["c"]["ACTIVE_amt_MEAN"] is None


def test_family_equals_filter_aggregate_join(spark):
    df = spark.range(200).select(
        (F.col("id") % 7).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("f"), (F.col("id") * 1.25).alias("x")
    )
    fused = grouped.group_features(df, "k", [Recipe({"x": ["sum", "max"]}, families={"F_": F.col("f") == 1})])
    fam = df.where("f = 1").groupBy("k").agg(F.sum("x").alias("F_x_SUM"), F.max("x").alias("F_x_MAX"))
    joined = df.groupBy("k").agg(F.sum("x").alias("x_SUM"), F.max("x").alias("x_MAX")).join(fam, "k", "left")
    assert sorted(map(tuple, fused.select(*joined.columns).collect())) == sorted(map(tuple, joined.collect()))


def test_two_level_mean_of_means(spark):
    months = spark.createDataFrame(
        [(1, -1, "C"), (1, -2, "X"), (2, -1, "C"), (2, -2, "C"), (2, -3, "C"), (3, -1, "X"), (3, -5, None)],
        "loan int, month int, status string",
    )
    loans = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "k string, loan int")
    r1 = Recipe({"month": ["min", "max", "size"]})
    r2 = Recipe({"month_MIN": ["min"], "month_SIZE": ["mean", "sum"]})
    out = {
        r.k: r for r in grouped.two_level(
            months, "loan", [r1], loans, "loan", "k", [r2],
            first_extra=share_columns("status", ["C", "X"]),
            second_extra=[F.avg("status_C_MEAN").alias("C_MEAN_MEAN")],
        ).collect()
    }
    assert out["a"]["C_MEAN_MEAN"] == (0.5 + 1.0) / 2  # unweighted by months
    assert out["b"]["C_MEAN_MEAN"] == 0.0  # loan 4 has no months: skipped
    assert out["b"]["month_SIZE_SUM"] == 2 and out["b"]["month_SIZE_MEAN"] == 2.0


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 2.0), (4.0, 2.0)], "x double, y double")
    got = profile.target_correlation(df, "y", ["x"]).collect()
    assert got[0]["corr"] is None
    exact = profile.target_correlation(df, "y", ["x"], scales={"x": 2, "y": 2}).collect()
    assert exact[0]["corr"] is None


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "y"), ("b", "y")], "k string, c string")
    out = grouped.group_features(df, "k", [], share_columns("c", ["x", "y"], "P_", True)).collect()
    for r in out:
        assert math.isclose(r["P_c_x_MEAN"] + r["P_c_y_MEAN"] + r["P_c_nan_MEAN"], 1.0)


def test_exact_variance_large_values_against_fractions(spark):
    """Units whose squares overflow 64 bits take the decimal path; the
    result is within 2 ulp of the exactly computed variance."""
    from fractions import Fraction

    from ledgerline.functions.aggs import exact_var

    vals = ["98765432.10", "12345678.91", "55555555.55", "-77777777.77"]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = df.agg(exact_var(F.col("x"), 2)).first()[0]
    xs = [Fraction(v) for v in vals]
    n = len(xs)
    mean = sum(xs) / n
    want = sum((x - mean) ** 2 for x in xs) / (n - 1)
    assert abs(Fraction(got) - want) <= 2 * abs(want) * Fraction(1, 2 ** 52)


def test_one_hot_vector_form(spark):
    from pyspark.ml import Pipeline

    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    model = Pipeline(stages=encode.one_hot_vector_stages(["c"])).fit(df)
    out = [tuple(r.c_vec.toArray()) for r in model.transform(df).collect()]
    assert out == [(0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0)]


def test_approx_nunique_option(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    out = {r.k: r.id_NUNIQUE_APPROX for r in grouped.group_features(df, "k", [Recipe({"id": ["nunique_approx"]})]).collect()}
    assert all(abs(v - 333) < 40 for v in out.values())


def test_presence_count_equals_count_distinct(spark):
    from ledgerline.functions.aggs import presence_count

    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", None), ("b", None), ("c", 3)], "k string, v int")
    got = {r.k: r.n for r in df.groupBy("k").agg(presence_count(F.col("v"), ["1", "2", "3"]).alias("n")).collect()}
    want = {r.k: r.n for r in df.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    assert got == want == {"a": 2, "b": 0, "c": 1}
    r = Recipe({"v": ["nunique"]}, families={"F_": F.col("v") > 1}, vocab={"v": ["1", "2", "3"]})
    out = {x.k: x for x in grouped.group_features(df, "k", [r]).collect()}
    assert out["a"]["v_NUNIQUE"] == 2 and out["a"]["F_v_NUNIQUE"] == 1 and out["b"]["F_v_NUNIQUE"] is None
