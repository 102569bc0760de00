"""Classifier evaluation as aggregate queries over a scored frame (V1-V6).

Input: a DataFrame with an integer ``label``, a ``prediction`` and/or a
real ``score``. All metrics are computed from a handful of conditional
counts; the sweep and the exact AUC first collapse the rows to at most one
row per threshold / per distinct score, so no row-level data moves to one
place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V1: long-form confusion matrix (label, prediction, n)."""
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V2: share of rows where prediction equals label, and the rounded
    percentage the scripts print (``round(acc, 2) * 100``)."""
    correct = F.sum((F.col(label) == F.col(prediction)).cast("int"))
    acc = (correct.cast("double") / F.count(F.lit(1)))
    return df.agg(
        correct.cast("bigint").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        acc.alias("accuracy"),
    )


def accuracy_percent(acc: Column) -> Column:
    """The printed form ``round(acc, 2) * 100``: half-even on the exact
    binary value (``bround``), as the scripts' rounding does."""
    return F.bround(acc, 2) * F.lit(100.0)


def _safe(num: Column, den: Column) -> Column:
    # sklearn reports 0 where a ratio is undefined
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def class_report(
    df: DataFrame,
    classes: Sequence[int] | None = None,
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """V3: per-class precision / recall / f1 / support plus macro and weighted averages
    (rows keyed by ``class``). The classes are those of the labels and predictions, or the
    ones given (with zeros where they do not occur). One pass: everything follows from the
    counts of (label, prediction)."""
    spark = df.sparkSession
    pairs = df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("y").cast("bigint").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("s"), zero.alias("m")),
        F.struct(F.col("p").cast("bigint").alias("c"), zero.alias("tp"), zero.alias("s"), F.col("n").alias("m")),
    )).alias("r")).select("r.*").where(F.col("c").isNotNull())
    if classes is not None:
        wanted = spark.createDataFrame([(int(c), 0, 0, 0) for c in classes], "c bigint, tp bigint, s bigint, m bigint")
        sides = sides.where(F.col("c").isin([int(c) for c in classes])).unionByName(wanted)
    counts = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("s").alias("s"), F.sum("m").alias("m"))
    tp, s, m = F.col("tp"), F.col("s"), F.col("m")
    rows = counts.select(
        F.col("c").cast("string").alias("class"), _safe(tp, m).alias("precision"), _safe(tp, s).alias("recall"),
        _safe(2 * tp, s + m).alias("f1"), s.alias("support"),
    )
    metrics = ("precision", "recall", "f1")
    # in class order, so the sums of a few doubles do not depend on partitions
    ordered = F.array_sort(F.collect_list(F.struct("class", *metrics, "support")))
    total = F.aggregate("r", zero, lambda t, x: t + x["support"])

    def summed(k: str, weighted: bool) -> Column:
        return F.aggregate("r", F.lit(0.0), lambda t, x: t + (x[k] * x["support"] if weighted else x[k]))

    plain = [_safe(summed(k, False), F.size("r")).alias(k) for k in metrics]
    weighted = [_safe(summed(k, True), total).alias(k) for k in metrics]
    together = rows.agg(ordered.alias("r"))
    macro = together.select(F.lit("macro avg").alias("class"), *plain, total.alias("support"))
    return rows.unionByName(macro).unionByName(together.select(F.lit("weighted avg").alias("class"), *weighted, total.alias("support")))


SCORES_PER_RANGE = 2_000_000  # distinct scores one window task ranks


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """V4: exact ROC AUC (ties count one half), one row ``auc``.

    Rows collapse to one row per distinct score; distinct scores are cut
    into ranges at approximate quantiles (a bounded array), negatives below
    each score are a window *within* a range plus the total of the earlier
    ranges (one row per range). No single-partition window.
    """
    from pyspark.ml.feature import Bucketizer

    per_score = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    if buckets is None:
        # the per-score table is read three times (count, cut points, ranks):
        # write it once instead of re-scoring the input for each pass
        per_score = cut_lineage(per_score)
        # ranges grow with the number of distinct scores: each range's
        # window sees at most about SCORES_PER_RANGE rows
        n_scores = per_score.count()
        buckets = max(64, -(-n_scores // SCORES_PER_RANGE))
    accuracy = max(1000, 4 * buckets)
    cuts = per_score.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], accuracy)).first()[0] or []
    splits = [float("-inf")] + sorted(set(cuts)) + [float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="s", outputCol="rng").transform(per_score)
    totals = ranged.groupBy("rng").agg(F.sum("neg").alias("rng_neg"))
    offsets = totals.select(
        "rng",
        F.coalesce(F.sum("rng_neg").over(Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
    )
    within = Window.partitionBy("rng").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    scored = ranged.join(offsets, "rng").withColumn(
        "below", F.col("offset") + F.coalesce(F.sum("neg").over(within), F.lit(0))
    )
    return auc_from_counts(scored)


def auc_from_counts(scored: DataFrame) -> DataFrame:
    """AUC from rows (pos, neg, below: negatives under the score). 2·Σ pos·(below + neg/2)
    is an integer: exact (38 digits) until the final division."""
    wide = lambda c: c.cast("decimal(38,0)")
    twice = F.sum(wide(wide(F.col("pos")) * wide(2 * F.col("below") + F.col("neg"))))
    pairs = wide(F.sum("pos")) * wide(F.sum("neg")) * F.lit(2).cast("decimal(1,0)")
    return scored.agg(F.try_divide(twice.cast("double"), pairs.cast("double")).alias("auc"))


def sweep_index(score: Column, steps: int = 100) -> Column:
    """How many thresholds i/steps (i = 0..steps-1) lie strictly below the
    score; exact — a candidate from ``ceil`` is corrected by comparing
    with the very thresholds used in the report."""
    s = score.cast("double")
    guess = F.least(F.greatest(F.ceil(s * F.lit(float(steps))), F.lit(0)), F.lit(steps))
    # guess thresholds below: i < guess; fix when (guess-1)/steps >= s or guess/steps < s
    down = (guess > 0) & ((guess - 1).cast("double") / F.lit(float(steps)) >= s)
    up = (guess < steps) & (guess.cast("double") / F.lit(float(steps)) < s)
    return F.when(down, guess - 1).when(up, guess + 1).otherwise(guess)


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", steps: int = 100) -> DataFrame:
    """V5: class-1 precision / recall / f1 of ``score > i/steps`` for every
    i in 0..steps-1 — rows collapse to ≤ steps+1 groups, then suffix sums.
    Undefined ratios are 0 (as the report prints them)."""
    spark = df.sparkSession
    groups = df.where(F.col(score).isNotNull()).groupBy(sweep_index(F.col(score), steps).alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    thresholds = spark.range(steps).select(F.col("id").cast("int").alias("i"))
    # rows above threshold i are the groups with k > i (≤ steps+1 groups)
    above = (
        groups.where(F.col("k") > 0)
        .select(F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), "pos", "neg")
        .groupBy("i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    )
    # the positives ride along: one row, in the same plan
    npos = groups.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("npos"))
    out = thresholds.join(above, "i", "left").join(F.broadcast(npos), F.lit(True)).select(
        (F.col("i").cast("double") / F.lit(float(steps))).alias("x"),
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("fp", F.lit(0)).alias("fp"),
        F.col("npos").cast("bigint").alias("npos"),
    )
    tp, fp, npos_c = F.col("tp"), F.col("fp"), F.col("npos")
    return out.select(
        "x",
        _safe(tp, tp + fp).alias("precision"),
        _safe(tp, npos_c).alias("recall"),
        _safe(2 * tp, 2 * tp + fp + (npos_c - tp)).alias("f1"),
    )


# ---------------------------------------------------- several models at once
def score_groups(scored: DataFrame, label: str = "label", score: str = "score", prediction: str = "prediction", model: str = "model") -> DataFrame:
    """(model, s, y, p, n): rows of every model by score, label and prediction. Whatever is
    reported about the models follows from this one pass over their rows; written once."""
    grouped = scored.groupBy(
        F.col(model).alias("model"), F.col(score).cast("double").alias("s"), F.col(label).cast("bigint").alias("y"), F.col(prediction).cast("bigint").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(grouped)


def keyed_auc(groups: DataFrame) -> DataFrame:
    """(model, auc): exact ROC AUC of every model of ``groups``.

    Models and scores are sorted together by range partitions; negatives below a score are
    counted within its range, and the ranges' totals (one row per range and model) are added
    up. A model with all the rows is spread over the ranges like many small ones."""
    per_score = groups.where(F.col("s").isNotNull()).groupBy("model", "s").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") != 1, F.col("n")).otherwise(0)).alias("neg")
    )
    ranged = cut_lineage(per_score.repartitionByRange("model", "s").withColumn("rng", F.spark_partition_id()))
    totals = ranged.groupBy("model", "rng").agg(F.sum("neg").alias("rng_neg"))
    earlier = Window.partitionBy("model").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("model", "rng", F.coalesce(F.sum("rng_neg").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("model", "rng").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("offset") + F.coalesce(F.sum("neg").over(within), F.lit(0))
    wide = lambda c: c.cast("decimal(38,0)")
    twice = F.sum(wide(wide(F.col("pos")) * wide(2 * F.col("below") + F.col("neg"))))
    pairs = wide(F.sum("pos")) * wide(F.sum("neg")) * F.lit(2).cast("decimal(1,0)")
    return (
        ranged.join(offsets, ["model", "rng"]).withColumn("below", below)
        .groupBy("model").agg(F.try_divide(twice.cast("double"), pairs.cast("double")).alias("auc"))
    )


def keyed_report(groups: DataFrame) -> DataFrame:
    """(model, metric, value): confusion counts (``<label> predicted <prediction>``), per class,
    macro and weighted precision / recall / f1 / support, accuracy and its printed percentage."""
    pairs = groups.groupBy("model", "y", "p").agg(F.sum("n").alias("n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero)
    sides = pairs.select("model", F.explode(F.array(
        F.struct(F.col("y").alias("c"), hit.alias("tp"), F.col("n").alias("s"), zero.alias("m")),
        F.struct(F.col("p").alias("c"), zero.alias("tp"), zero.alias("s"), F.col("n").alias("m")),
    )).alias("r")).select("model", "r.*").where(F.col("c").isNotNull())
    counts = sides.groupBy("model", "c").agg(F.sum("tp").alias("tp"), F.sum("s").alias("s"), F.sum("m").alias("m"))
    tp, s, m = F.col("tp"), F.col("s"), F.col("m")
    rows = counts.select(
        "model", F.col("c").cast("string").alias("class"), _safe(tp, m).alias("precision"), _safe(tp, s).alias("recall"), _safe(2 * tp, s + m).alias("f1"), s.alias("support")
    )
    measures = ("precision", "recall", "f1")
    # in class order, so the sums of a few doubles do not depend on partitions
    together = rows.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("class", *measures, "support"))).alias("r"))
    total = F.aggregate("r", zero, lambda t, x: t + x["support"])

    def summed(k: str, weighted: bool) -> Column:
        return F.aggregate("r", F.lit(0.0), lambda t, x: t + (x[k] * x["support"] if weighted else x[k]))

    plain = [_safe(summed(k, False), F.size("r")).alias(k) for k in measures]
    weighted = [_safe(summed(k, True), total).alias(k) for k in measures]
    averages = [together.select("model", F.lit(f"{name} avg").alias("class"), *values, total.alias("support")) for name, values in (("macro", plain), ("weighted", weighted))]
    report = rows.unionByName(averages[0]).unionByName(averages[1])
    long = report.select("model", "class", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("value")) for k in (*measures, "support")])).alias("x"))
    long = long.select("model", F.concat_ws(" ", "class", "x.k").alias("metric"), "x.value")
    acc = pairs.groupBy("model").agg(F.try_divide(F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).cast("double"), F.sum("n").cast("double")).alias("acc"))
    acc = acc.select("model", F.explode(F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.col("acc").alias("value")),
        F.struct(F.lit("accuracy percent").alias("metric"), accuracy_percent(F.col("acc")).alias("value")),
    )).alias("x")).select("model", "x.*")
    confusion_rows = pairs.select("model", F.concat_ws(" predicted ", F.col("y").cast("string"), F.col("p").cast("string")).alias("metric"), F.col("n").cast("double").alias("value"))
    return long.unionByName(acc).unionByName(confusion_rows)


def keyed_sweep(groups: DataFrame, steps: int = 100) -> DataFrame:
    """(model, x, precision, recall, f1) of ``score > i/steps`` for every model and threshold."""
    by_k = groups.where(F.col("s").isNotNull()).groupBy("model", sweep_index(F.col("s"), steps).alias("k")).agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") != 1, F.col("n")).otherwise(0)).alias("neg")
    )
    # every model has all thresholds; rows above threshold i are the groups with k > i
    per_model = by_k.groupBy("model").agg(F.sum("pos").alias("npos"))
    grid = per_model.select("model", "npos", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    above = (
        by_k.where("k > 0").select("model", F.explode(F.sequence(F.lit(0), F.col("k").cast("int") - 1)).alias("i"), "pos", "neg")
        .groupBy("model", "i").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    )
    out = grid.join(above, ["model", "i"], "left")
    tp, fp, npos = F.coalesce("tp", F.lit(0)), F.coalesce("fp", F.lit(0)), F.col("npos")
    return out.select(
        "model", (F.col("i").cast("double") / F.lit(float(steps))).alias("x"),
        _safe(tp, tp + fp).alias("precision"), _safe(tp, npos).alias("recall"), _safe(2 * tp, tp + fp + npos).alias("f1"),
    )


def compare(scored: DataFrame, label: str = "label", score: str = "score", prediction: str = "prediction", model: str = "model", sweep: bool = True) -> DataFrame:
    """V1-V6 of every model of ``scored`` as (model, metric, value): the rows are read once, and
    report, AUC and sweep are keyed by the model, so their number costs no further passes."""
    groups = score_groups(scored, label, score, prediction, model)
    out = keyed_report(groups).unionByName(keyed_auc(groups).select("model", F.lit("roc_auc").alias("metric"), F.col("auc").alias("value")))
    if not sweep:
        return out
    measures = F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in ("precision", "recall", "f1")])
    swept = keyed_sweep(groups).select("model", "x", F.explode(measures).alias("r"))
    return out.unionByName(swept.select("model", F.concat_ws(" above ", "r.m", F.format_number("x", 2)).alias("metric"), "r.value"))
