"""Distributed forests: growth, bags, tops by histograms, importances, scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evaluate, sampling, trees


def frame(spark, n=1500, seed=1, noise=0.1):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 4)).round(2)
    y = ((x[:, 1] > 0.3) ^ (rnd.random(n) < noise)).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double, d double")


def brute_tree(x, y, w):
    """Recursive growth over all features, from the definition: {rows: value} of the leaves."""
    out = {}

    def go(rows):
        wt, w1 = w[rows].sum(), (w * y)[rows].sum()
        best = None
        if 0 < w1 < wt:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for a, b in zip(values, values[1:], strict=False):
                    left = x[rows, f] <= a
                    score = 0.0
                    for side in (left, ~left):
                        s, s1 = w[rows][side].sum(), (w * y)[rows][side].sum()
                        score += (s1 * s1 + (s - s1) ** 2) / s
                    if best is None or score > best[0] + 1e-9:
                        best = (score, rows[left], rows[~left])
        if best is None:
            for r in rows:
                out[r] = w1 / wt
        else:
            go(best[1])
            go(best[2])

    go(np.arange(len(x)))
    return np.array([out[i] for i in range(len(x))])


@pytest.mark.parametrize("seed", range(8))
def test_growth_fits_every_row_it_can(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(1, 300))
    x = rnd.integers(0, 6, (n, 3)).astype(np.float32)
    y, w = rnd.integers(0, 2, n).astype(float), rnd.integers(1, 4, n).astype(float)
    t = trees.grow(x, y, w, 3, (seed,))
    got = trees.leaf_values(t, x)
    # full depth: rows with the same values share the weighted mean of their labels, no others do
    for i in range(n):
        same = (x == x[i]).all(1)
        assert abs(got[i] - (w * y)[same].sum() / w[same].sum()) < 1e-9 or got[i] in (0.0, 1.0)
    pure = np.array([len(set(y[(x == x[i]).all(1)])) == 1 for i in range(n)])
    assert (got[pure] == y[pure]).all()
    assert abs(got - brute_tree(x, y, w)).max() < 1e-9


def test_first_split_is_the_best_one():
    x = np.array([[0, 5], [1, 4], [2, 3], [3, 2], [4, 1], [5, 0]], np.float32)
    x[:, 1] = [1, 1, 2, 2, 1, 2]
    t = trees.grow(x, np.array([0, 0, 1, 1, 0, 1.0]), np.ones(6), 2, (0,))
    assert t.feature[0] == 1 and t.threshold[0] == 1.5 and len(t.feature) == 3 and t.gain[0] == 3.0


def test_missing_values_go_right():
    x = np.array([[1.0], [2.0], [np.nan], [np.inf]], np.float32)
    t = trees.grow(x, np.array([0, 0, 1.0, 0]), np.ones(4), 1, (0,))
    assert trees.leaf_values(t, x).tolist() == [0, 0, 1, 0]


def test_forest_learns_and_names_the_feature(spark):
    df = frame(spark)
    train, test = sampling.train_test(df, "id", 25)
    for forest in (
        trees.random_forest(train, ["a", "b", "c", "d"], "y", F.col("id"), n_trees=25),
        trees.bagged_trees(train, ["a", "b", "c", "d"], "y", ["id"], n_estimators=60, rows_per_tree=60),
    ):
        scored = forest.score(test, "id", "y")
        assert scored.count() == test.count()
        assert evaluate.roc_auc(scored).first()["auc"] > 0.85
        ranked = forest.importances().orderBy(F.desc("importance")).collect()
        assert ranked[0]["feature"] == "b" and abs(sum(r["importance"] for r in ranked) - 1) < 1e-9


def test_tops_by_histograms(spark, monkeypatch):
    """With room for few rows in a task the tops are split first; the forest still fits its rows."""
    df = frame(spark, 1200, noise=0.0)
    monkeypatch.setattr(trees, "HISTOGRAM_BYTES", 20 * 4 * 65 * 16)
    small = trees.random_forest(df, ["a", "b", "c", "d"], "y", F.col("id"), n_trees=8, max_rows=150)
    assert small.top.trees and small.nodes.select("tree", "root").distinct().count() > 16
    scored = small.score(df, "id", "y")
    assert scored.count() == 1200 and evaluate.accuracy(scored).first()["accuracy"] > 0.97
    assert small.importances().orderBy(F.desc("importance")).first()["feature"] == "b"
    # nodes of one tree cover every row it draws once
    weight = small.nodes.where("node = 0").groupBy("tree").agg(F.sum("weight").alias("w")).collect()
    keys = np.array([r[0] for r in df.select(F.xxhash64("id")).collect()], np.int64)
    for r in weight:
        assert r["w"] == trees._poisson(0, r["tree"], keys).sum()


def test_forest_does_not_depend_on_partitions(spark):
    df = frame(spark, 400)
    one = [trees.random_forest(d, ["a", "b"], "y", F.col("id"), n_trees=5).nodes.orderBy("tree", "node").collect() for d in (df.repartition(1), df.repartition(7))]
    assert one[0] == one[1]


def test_edges(spark):
    df = frame(spark, 200)
    missing = df.withColumn("a", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("a"))).withColumn("y", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("y")))
    f = trees.random_forest(missing, ["a", "b"], "y", F.col("id"), n_trees=5)
    assert f.score(missing, "id", "y").count() == 200
    one_class = trees.random_forest(df.where("y = 1"), ["a"], "y", F.col("id"), n_trees=3)
    assert {r["score"] for r in one_class.score(df, "id", "y").collect()} == {1.0}
    assert {r["importance"] for r in one_class.importances().collect()} == {0.0}


def test_bags_are_exact(spark):
    df = frame(spark, 77)
    bags = trees.exact_bags(df, ["id"], 40, 30, seed=9)
    got = bags.groupBy("tree").agg(F.sum("draws").alias("n")).collect()
    assert len(got) == 40 and {r["n"] for r in got} == {30}
    assert bags.select("id").distinct().count() > 70


def test_bootstrap_is_exact_and_repeats(spark):
    df = frame(spark, 500).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    out = sampling.bootstrap(df, "y", "id", seed=3)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 450, 1: 450}
    copies = out.where("y = 1").groupBy("id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    assert all(r["n"] == r["m"] + 1 for r in copies)
    # draws with replacement: some rows are missing only if drawn by none, and counts differ
    assert len({r["n"] for r in copies}) > 3
    again = sampling.bootstrap(df.repartition(5), "y", "id", seed=3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert sampling.bootstrap(df.where("y = 0"), "y", "id").count() == 450


def test_full_depth_leaves_no_node_table(spark, monkeypatch):
    """Importances and scores are read off the trees a few at a time; the nodes, which are more
    than the rows, were once written whole, after all trees' rows had been shuffled at once."""
    df = frame(spark, 600)
    batches, dealt = [], trees._dealt
    monkeypatch.setattr(trees, "_dealt", lambda top, of, seed: batches.append(list(of)) or dealt(top, of, seed))
    whole = trees.random_forest(df, ["a", "b", "c", "d"], "y", F.col("id"), n_trees=7, max_rows=100)
    monkeypatch.setattr(trees, "_grown", lambda *a: pytest.fail("nodes of all trees"))
    one = {r["id"]: r["score"] for r in whole.score(df, "id", "y").collect()}
    shares = {r["feature"]: r["importance"] for r in whole.importances().collect()}
    assert batches == [list(range(7))] * 2
    # room for three trees' rows: as many shuffles of a bounded size, the same forest
    monkeypatch.setattr(trees, "DEALT_BYTES", int(3.5 * 0.64 * 600 * 18))
    batches.clear()
    few = {r["id"]: r["score"] for r in whole.score(df, "id", "y").collect()}
    assert batches == [[0, 1, 2], [3, 4, 5], [6]] and len(one) == 600
    assert all(abs(few[i] - s) < 1e-9 for i, s in one.items())
    assert all(abs(r["importance"] - shares[r["feature"]]) < 1e-9 for r in whole.importances().collect())
    # and the scores are those of the table of nodes
    monkeypatch.undo()
    by_root = {}
    for r in whole.nodes.collect():
        by_root.setdefault((r["tree"], r["root"]), []).append(r)
    rows = df.collect()
    x = np.array([[r["a"], r["b"], r["c"], r["d"]] for r in rows], np.float32)
    total = np.zeros(600)
    for t in range(7):
        root = whole.top.roots(t, x)
        for at in np.unique(root).tolist():
            nodes = sorted(by_root[t, at], key=lambda r: r["node"])
            tree = trees.Tree(*(np.array([r[c] for r in nodes]) for c in ("feature", "threshold", "left", "value", "gain", "weight")))
            total[root == at] += trees.leaf_values(tree, x[root == at])
    assert all(abs(one[r["id"]] - total[i] / 7) < 1e-9 for i, r in enumerate(rows))


def test_parts_of_a_level_give_the_same_tree(monkeypatch):
    """Levels are split a few neighbouring nodes at a time, and equal rows are one."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 3)).astype(np.float32).round(1)
    x[rnd.random(900) < 0.1, 2] = np.nan
    y, w = rnd.integers(0, 2, 900), rnd.integers(1, 4, 900)
    one = trees.grow(x, y, w, 2, (5, 1, 0))
    twice, order = np.r_[x, x], rnd.permutation(1800)
    monkeypatch.setattr(trees, "PART_ROWS", 16)
    many = [trees.grow(x, y, w, 2, (5, 1, 0)), trees.grow(twice[order], np.r_[y, y][order], np.r_[w, w][order], 2, (5, 1, 0))]
    monkeypatch.setattr(trees, "MOST_PAIRS", 0)
    many.append(trees.grow(x, y, w, 2, (5, 1, 0)))
    for t, times in zip(many, (1, 2, 1), strict=True):
        for c in ("feature", "threshold", "left", "value"):
            assert (getattr(t, c) == getattr(one, c)).all()
        assert (t.weight == times * one.weight).all() and abs(t.gain - times * one.gain).max() < 1e-9


def test_scores_and_importances_of_one_growth(spark, monkeypatch):
    """A forest that is scored and ranked was grown twice."""
    from ledgerline.plans import scoring

    df = frame(spark, 500)
    batches, dealt = [], trees._dealt
    monkeypatch.setattr(trees, "_dealt", lambda top, of, seed: batches.append(list(of)) or dealt(top, of, seed))
    train, test = sampling.train_test(df, "id", 25)
    split = scoring.Split(train, test, ["a", "b", "c", "d"], "y", "id")
    forest, scored = scoring.fit_score_forest(split, n_trees=6)
    assert scoring.top_features(forest, split.features, 1) == ["b"] and scored.count() == test.count()
    assert batches == [list(range(6))]
    kept = {r["feature"]: r["importance"] for r in forest.importances().collect()}
    forest.gains = None
    assert all(abs(r["importance"] - kept[r["feature"]]) < 1e-9 for r in forest.importances().collect())
