"""Imputation, sampling and evaluation against brute force on small inputs."""

import random

from pyspark.sql import functions as F

from ledgerline.operators import evaluate, impute, sampling


def test_exact_median_matches_sorting(spark):
    rnd = random.Random(1)
    for n in (1, 2, 7, 1000, 1001):
        vals = [rnd.choice([rnd.random() * 100, 3.0, -1.5]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
        s = sorted(vals)
        a, b = s[(n - 1) // 2], s[n // 2]
        assert impute.exact_median(df, "x") == a + (b - a) * 0.5


def test_mode_ties_go_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert impute.mode_value(df, "c") == "a"
    filled = impute.impute(df, ["c"], "most_frequent").collect()
    assert sorted(r.c for r in filled) == ["a", "a", "a", "a", "a", "b", "b"]


def test_oversample_exact_size_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    out = sampling.oversample(df, "label", "key")
    counts = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    assert counts[1] == counts[0] == 857
    again = sampling.oversample(df, "label", "key")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    per_key = [r[0] for r in out.where("label = 1").groupBy("key").count().select("count").collect()]
    assert set(per_key) <= {5, 6}  # balanced replication: q or q + 1 copies


def test_hash_split_share(spark):
    df = spark.range(20000).select(F.col("id").alias("k"))
    train, test = sampling.train_test(df, "k", 20)
    n_test = test.count()
    assert 3600 < n_test < 4400 and train.count() + n_test == 20000
    assert train.join(test, "k").count() == 0


def _brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y != 1]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def test_auc_and_sweep_against_brute_force(spark):
    rnd = random.Random(7)
    pairs = [(rnd.randint(0, 1), rnd.choice([0.5, 0.3, 0.07, round(rnd.random(), 3)])) for _ in range(400)]
    df = spark.createDataFrame(pairs, "label int, score double")
    auc = evaluate.roc_auc(df, buckets=8).first()["auc"]
    assert abs(auc - _brute_auc(pairs)) < 1e-12
    sweep = {r.x: r for r in evaluate.threshold_sweep(df).collect()}
    assert len(sweep) == 100
    npos = sum(y for y, _ in pairs)
    for i in (0, 7, 30, 50, 99):
        t = i / 100
        tp = sum(1 for y, s in pairs if y == 1 and s > t)
        fp = sum(1 for y, s in pairs if y == 0 and s > t)
        r = sweep[t]
        assert r.precision == (tp / (tp + fp) if tp + fp else 0.0)
        assert r.recall == tp / npos


def test_class_report(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    rows = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert rows["1"]["precision"] == 0.5 and rows["1"]["recall"] == 0.5 and rows["1"]["support"] == 2
    assert abs(rows["0"]["f1"] - 2 / 3) < 1e-15
    assert rows["weighted avg"]["support"] == 5


def test_median_narrowing_rounds(spark, monkeypatch):
    """Force several histogram rounds (tiny buckets) and compare with sorting."""
    monkeypatch.setattr(impute, "HISTOGRAM_BUCKETS", 4)
    monkeypatch.setattr(impute, "SMALL_BUCKET", 10)
    rnd = random.Random(3)
    data = [(rnd.gauss(0, 1) ** 3, float(rnd.randint(0, 5)), None if i % 5 == 0 else rnd.random()) for i in range(2000)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = impute.exact_medians(df, ["a", "b", "c"])
    for j, name in enumerate("abc"):
        vals = sorted(r[j] for r in data if r[j] is not None)
        n = len(vals)
        lo, hi = vals[(n - 1) // 2], vals[n // 2]
        assert got[name] == lo + (hi - lo) * 0.5


def test_modes_together(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (10, "x"), (10, None), (None, None)], "a int, s string")
    assert impute.mode_values(df, ["a", "s"]) == {"a": 2, "s": "x"}


def test_oversample_chunked_copies(spark, monkeypatch):
    """Copies made in many steps give the same rows as in one."""
    df = spark.range(300).select(F.col("id").alias("key"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    plain = sorted(map(tuple, sampling.oversample(df, "label", "key").collect()))
    monkeypatch.setattr(sampling, "COPIES_PER_STEP", 7)
    chunked = sorted(map(tuple, sampling.oversample(df, "label", "key").collect()))
    assert plain == chunked and len(chunked) == 2 * 294


def test_oversample_exact_with_repeated_keys(spark):
    rows = [(0, i % 3, i) for i in range(7)] + [(1, i % 2, i) for i in range(4)] + [(0, 9, 9)] * 40 + [(1, 9, 9)] * 3
    df = spark.createDataFrame(rows, "label int, key int, x int")
    counts = {r[0]: r[1] for r in sampling.oversample(df, "label", "key").groupBy("label").count().collect()}
    assert counts[0] == counts[1] == 47


def test_median_with_nan_and_infinities(spark, monkeypatch):
    monkeypatch.setattr(impute, "SMALL_BUCKET", 10)
    inf, nan = float("inf"), float("nan")
    columns = {
        "a": [float(i) for i in range(100)] + [nan], "b": [float(i) for i in range(100)] + [inf], "c": [-inf] * 60 + [1.0] * 41,
        "d": [inf] * 70 + [0.0] * 31, "e": [5e-324 * (i % 3) for i in range(101)], "f": [1.7e308 if i % 2 else -1.7e308 for i in range(101)], "g": [nan] * 101,
    }
    n = 101
    df = spark.createDataFrame([tuple(v[i] for v in columns.values()) for i in range(n)], ", ".join(f"{c} double" for c in columns))
    got = impute.exact_medians(df, list(columns))
    for name, values in columns.items():
        s = sorted(v for v in values if v == v)
        if not s:
            assert got[name] is None
            continue
        lo, hi = s[(len(s) - 1) // 2], s[len(s) // 2]
        assert got[name] == (lo if lo == hi else lo + (hi - lo) * 0.5), name


def test_variance_of_many_rows(spark):
    """Denominators beyond 64 bits: 31 million rows at scale 2, 400 thousand at scale 4."""
    from ledgerline.functions.aggs import exact_covar, exact_var

    x = (F.col("id") % 2).cast("double") / 4
    n = 31_000_000
    v, c = spark.range(n).agg(exact_var(x, 2), exact_covar(x, x, 2, 2)).first()
    assert abs(v - 1 / 64 * n / (n - 1)) < 1e-15 and v == c
    n = 400_000
    assert abs(spark.range(n).agg(exact_var(x, 4)).first()[0] - 1 / 64 * n / (n - 1)) < 1e-15


def test_auc_of_many_rows(spark):
    """Class counts of three billion each, as a table of counts per score."""
    from ledgerline.operators import evaluate as E

    big = 3_000_000_000
    scored = spark.createDataFrame([(0.1, 0, big, 0), (0.9, big, 0, big)], "s double, pos bigint, neg bigint, below bigint")
    assert E.auc_from_counts(scored).first()["auc"] == 1.0


def test_class_report_takes_classes_from_data(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2)], "label int, prediction int")
    rows = {r["class"]: r for r in evaluate.class_report(df).collect()}
    assert set(rows) == {"1", "2", "macro avg", "weighted avg"}
    assert rows["1"]["support"] == rows["2"]["support"] == 2 and rows["macro avg"]["support"] == 4
    assert rows["2"]["precision"] == 2 / 3 and rows["1"]["recall"] == 0.5
    given = {r["class"]: r for r in evaluate.class_report(df, classes=(2, 3)).collect()}
    assert set(given) == {"2", "3", "macro avg", "weighted avg"} and given["3"]["support"] == 0


def test_names_with_dots(spark):
    from ledgerline.functions.aggs import share_columns
    from ledgerline.operators import encode, profile
    from ledgerline.plans import features

    df = spark.createDataFrame([(1, "admin.", 1.0), (1, "x", 2.0), (2, "admin.", 4.0)], "k int, job string, v double")
    hot, names = encode.one_hot(df, encode.vocabularies(df, ["job"]))
    assert names == ["job_admin.", "job_x", "job_nan"]
    assert profile.correlation_matrix(hot, ["v", "job_admin."]).count() == 4
    assert profile.target_correlation(hot, "job_x", ["job_admin.", "v"]).count() == 2
    assert features.all_column_features(df, "k", ["job"], "CC_", "CC_COUNT").count() == 2
    assert df.groupBy("k").agg(*share_columns("job", ["admin."])).count() == 2


def test_codes_of_many_values(spark):
    from ledgerline.operators import encode

    n = 12_000
    df = spark.range(n * 2).select(F.col("id"), F.concat(F.lit("v."), (F.col("id") * 7919 % n).cast("string")).alias("a.b"), F.lit(None).cast("string").alias("none"))
    got = {r["id"]: (r["a.b"], r["none"]) for r in encode.label_encode(df, ["a.b", "none"]).collect()}
    values = {i: f"v.{i * 7919 % n}" for i in range(n * 2)}
    code = {v: k for k, v in enumerate(sorted(set(values.values())))}
    assert got == {i: (code[v], None) for i, v in values.items()}
    seen: dict = {}
    for i in range(n * 2):
        seen.setdefault(values[i], len(seen))
    got = {r["id"]: (r["a.b"], r["none"]) for r in encode.factorize(df, ["a.b", "none"], [F.col("id")]).collect()}
    assert got == {i: (seen[v], -1) for i, v in values.items()}


def test_median_rounds_share_a_histogram_per_column(spark, monkeypatch):
    """Every value was once compared with both ranks' ranges of all columns."""
    import statistics

    from ledgerline.operators import impute

    seen, bucket = [], impute._bucket
    monkeypatch.setattr(impute, "_bucket", lambda x, lo, hi: seen.append((lo, hi)) or bucket(x, lo, hi))
    df = spark.range(100).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000 + i)).cast("double").alias(f"c{i}") for i in range(6)])
    got = impute.exact_medians(df, df.columns)
    rows = df.collect()
    assert all(got[c] == statistics.median(r[c] for r in rows) for c in df.columns)
    assert len(seen) == 6
