"""Imputation.

Statistics are computed by distributed aggregates whose results are a few
numbers; the fill itself is a ``coalesce`` with a literal (narrow, inside
codegen). The exact median never gathers a column in one place: it narrows
a value range with bounded histograms until the middle rank's bucket is
small, then reads only that bucket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.aggs import exact_mean
from ledgerline.functions.columns import named

HISTOGRAM_BUCKETS = 4096
SMALL_BUCKET = 50_000  # rows ranked inside one bucket (one task each)


def _stack(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as long (column id ``c``, value ``x``), missing and NaN dropped."""
    return df.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), named(c).cast("double").alias("x")) for i, c in enumerate(cols)])).alias("p")
    ).select("p.c", "p.x").where(F.col("x").isNotNull() & ~F.isnan("x"))


def _bucket(x: Column, lo: float, hi: float) -> Column:
    """Bucket of a value in [lo, hi]; both factors stay finite for any finite range."""
    width = hi / HISTOGRAM_BUCKETS - lo / HISTOGRAM_BUCKETS
    if width == 0.0:
        # a range of a few smallest doubles: its ends are buckets of their own
        return F.when(x <= F.lit(lo), F.lit(0)).when(x >= F.lit(hi), F.lit(2)).otherwise(F.lit(1))
    at = F.floor(x / F.lit(width) - F.lit(lo / width))
    return F.greatest(F.lit(0), F.least(at, F.lit(HISTOGRAM_BUCKETS - 1)))


def _nth_value(values: DataFrame, rank: int) -> float:
    """The value at ``rank`` (from 0) among rows of few distinct values (one bucket between
    neighbouring doubles): counted per value, so the rows never meet in one task."""
    counts = values.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).where(F.col("upto") > F.lit(rank)).agg(F.min("x")).first()[0]


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Medians of several columns (linear interpolation between the two
    middle values, as pandas / SQL ``median``), computed together.

    Each middle rank of each column is a *task* with its own value range.
    A round is one scan + one aggregate over (range, bucket) with at most
    ranges × HISTOGRAM_BUCKETS result rows; a task ends when its bucket holds
    one distinct value, or few enough rows to rank inside that bucket. No
    global sort, and no column gathered in one task."""
    if not cols:
        return {}
    stacked = _stack(df, cols)
    x = F.col("x")
    # a round reads each column's own value against its own ranges, not every value against all
    value = [named(c).cast("double") for c in cols]
    inside = lambda i, lo, hi: (value[i] >= F.lit(lo)) & (value[i] <= F.lit(hi))
    finite = F.abs(x) < F.lit(float("inf"))
    stats = {r["c"]: r for r in stacked.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x == F.lit(float("-inf"))).alias("low"), F.count_if(x == F.lit(float("inf"))).alias("high"),
        F.min(F.when(finite, x)).alias("lo"), F.max(F.when(finite, x)).alias("hi")).collect()}
    # task: column id, rank, lo, hi, rows below lo, answer
    tasks: list[list] = []
    for i in range(len(cols)):
        st = stats.get(i)
        if st is not None:
            for rank in sorted({(st["n"] - 1) // 2, st["n"] // 2}):
                # infinities are end buckets of their own: only finite values are narrowed
                known = float("-inf") if rank < st["low"] else float("inf") if rank >= st["n"] - st["high"] else st["lo"] if st["lo"] == st["hi"] else None
                tasks.append([i, rank, st["lo"], st["hi"], st["low"], known])
    while True:
        open_ids = [tid for tid, t in enumerate(tasks) if t[5] is None]
        if not open_ids:
            break
        # both middle ranks of a column share a range until they part: one histogram a range
        ranges = list(dict.fromkeys((tasks[tid][0], tasks[tid][2], tasks[tid][3]) for tid in open_ids))
        pairs = [
            F.when(inside(i, lo, hi), F.struct(F.lit(k).alias("t"), _bucket(value[i], lo, hi).alias("b"), value[i].alias("x")))
            for k, (i, lo, hi) in enumerate(ranges)
        ]
        hist = (
            df.select(F.explode(F.array(*pairs)).alias("m")).where("m is not null").select("m.*")
            .groupBy("t", "b").agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
            .collect()
        )
        per_range: dict[tuple, list] = {}
        for r in hist:
            per_range.setdefault(ranges[r["t"]], []).append(r)
        small = []
        for tid in open_ids:
            t = tasks[tid]
            for r in sorted(per_range[t[0], t[2], t[3]], key=lambda r: r["b"]):
                if t[4] + r["n"] > t[1]:
                    break
                t[4] += r["n"]
            if r["lo"] == r["hi"]:
                t[5] = r["lo"]
            elif r["n"] <= SMALL_BUCKET:
                small.append((tid, r["lo"], r["hi"], t[1] - t[4]))
            elif (r["lo"], r["hi"]) == (t[2], t[3]):
                # a round without progress: neighbouring doubles, few of them however many rows
                t[5] = _nth_value(df.where(inside(t[0], r["lo"], r["hi"])).select(value[t[0]].alias("x")), t[1] - t[4])
            else:
                t[2], t[3] = r["lo"], r["hi"]
        if small:
            # rank inside the small buckets only (≤ SMALL_BUCKET rows per task)
            picks = [
                F.when(inside(tasks[tid][0], lo, hi), F.struct(F.lit(tid).alias("t"), value[tasks[tid][0]].alias("x")))
                for tid, lo, hi, _ in small
            ]
            ranked = (
                df.select(F.explode(F.array(*picks)).alias("m")).where("m is not null").select("m.*")
                .withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy("x")))
            )
            want = F.lit(False)
            for tid, _, _, local in small:
                want = want | ((F.col("t") == tid) & (F.col("r") == local + 1))
            for r in ranked.where(want).collect():
                tasks[r["t"]][5] = r["x"]
    out: dict[str, float | None] = {}
    for i, name in enumerate(cols):
        vals = [t[5] for t in tasks if t[0] == i]
        out[name] = None if not vals else vals[0] if vals[0] == vals[-1] else vals[0] + (vals[-1] - vals[0]) * 0.5
    return out


def exact_median(df: DataFrame, col: str) -> float | None:
    return exact_medians(df, [col])[col]


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent non-missing value of several columns in one job
    (grouping sets give the value counts of every column), ties to the
    smallest value; the second aggregate keeps one winner per column."""
    if not cols:
        return {}
    n = len(cols)
    counts = df.groupingSets([[c] for c in cols], *cols).agg(
        F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_gid")
    )
    picks = []
    for i, c in enumerate(cols):
        mine = (F.col("_gid") == (2 ** n - 1) - 2 ** (n - 1 - i)) & F.col(c).isNotNull()
        order = F.struct((-F.col("_n")).alias("m"), F.col(c).alias("v"))
        picks.append(F.min_by(F.when(mine, F.col(c)), F.when(mine, order)).alias(c))
    row = counts.agg(*picks).first()
    return {c: row[c] for c in cols}


def mode_value(df: DataFrame, col: str):
    """Most frequent non-missing value; ties go to the smallest value."""
    return mode_values(df, [col])[col]


def mean_value(df: DataFrame, col: str, scale: int | None = None) -> float | None:
    x = F.col(col)
    if scale is None:
        return df.agg(F.avg(x)).first()[0]
    return df.agg(exact_mean(x, scale)).first()[0]


def fill(df: DataFrame, values: Mapping[str, object], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Replace missing values by the given constants (optionally renaming the
    filled column, as the cleaning job does)."""
    rename = rename or {}
    out = df.withColumns({rename.get(c, c): F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})
    drop = [c for c in values if c in rename and rename[c] != c]
    return out.drop(*drop)


def statistics(
    df: DataFrame,
    cols: Sequence[str],
    strategy: str,
    scales: Mapping[str, int] | None = None,
    fill_value=0,
) -> dict:
    """The fill value of each column under one strategy (no data changed)."""
    scales = scales or {}
    if strategy == "median":
        return exact_medians(df, cols)
    if strategy == "most_frequent":
        return mode_values(df, cols)
    if strategy == "mean":
        return {c: mean_value(df, c, scales.get(c)) for c in cols}
    if strategy == "constant":
        return {c: fill_value for c in cols}
    raise ValueError(strategy)


def apply_fill(df: DataFrame, values: Mapping[str, object], strategy: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    out = df
    if strategy in ("median", "mean"):
        # the statistic is fractional in general: the filled column is double
        out = out.withColumns({c: F.col(c).cast("double") for c in values})
        values = {c: None if v is None else float(v) for c, v in values.items()}
    return fill(out, values, rename)


def impute(
    df: DataFrame,
    cols: Sequence[str],
    strategy: str = "median",
    rename: Mapping[str, str] | None = None,
    scales: Mapping[str, int] | None = None,
    fill_value=0,
    materialize: bool = False,
) -> DataFrame:
    """``median`` | ``most_frequent`` | ``mean`` | ``constant``.

    (The cleaning job's "fill 0" step is written with the default strategy,
    which is the mean; pass ``constant`` for the value it names.)

    ``materialize`` computes the statistics on a checkpoint of just these
    columns: worth it when ``df`` is a derived table (joins, aggregates)
    that the statistics' passes would otherwise recompute."""
    source = df
    if materialize and strategy in ("median", "most_frequent", "mean"):
        from ledgerline.session import cut_lineage

        source = cut_lineage(df.select(*cols))
    values = statistics(source, cols, strategy, scales, fill_value)
    return apply_fill(df, values, strategy, rename)


def regression_fill(
    df: DataFrame,
    target: str,
    predictors: Sequence[str],
    out_col: str | None = None,
) -> DataFrame:
    """Fit ordinary least squares on rows where ``target`` is present,
    predict every row, fill only the missing targets. Spark ML's normal
    solver aggregates the Gram matrix on the executors (k² numbers)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    out_col = out_col or target
    assembler = VectorAssembler(inputCols=list(predictors), outputCol="_features", handleInvalid="keep")
    data = assembler.transform(df.withColumns({p: F.col(p).cast("double") for p in predictors}))
    train = data.where(F.col(target).isNotNull())
    model = LinearRegression(featuresCol="_features", labelCol=target, solver="normal", predictionCol="_pred").fit(train)
    scored = model.transform(data)
    return scored.withColumn(out_col, F.coalesce(F.col(target).cast("double"), F.col("_pred"))).drop("_features", "_pred")


def regression_fill_one(df: DataFrame, target: str, predictor: str, out_col: str | None = None) -> DataFrame:
    """I5, one-predictor form as SQL aggregates (``regr_slope`` /
    ``regr_intercept``): a single pass, no model object."""
    out_col = out_col or target
    coef = df.agg(
        F.regr_slope(F.col(target).cast("double"), F.col(predictor).cast("double")).alias("slope"),
        F.regr_intercept(F.col(target).cast("double"), F.col(predictor).cast("double")).alias("icpt"),
    ).first()
    pred = F.lit(coef["icpt"]) + F.lit(coef["slope"]) * F.col(predictor).cast("double")
    return df.withColumn(out_col, F.coalesce(F.col(target).cast("double"), pred))


@dataclass
class Fit:
    """One link of a regression chain: ``out`` is ``target`` where it is present, else the
    intercept plus the coefficients times the predictors (columns, or earlier outputs)."""

    target: str
    predictors: list[str]
    out: str
    coefficients: list[float]  # intercept first


def _gram_by_pattern(df: DataFrame, columns: Sequence[str], targets: Sequence[str]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Gram matrices of (1, columns, targets), one per set of missing targets (bit t of the key:
    target t is missing, and counts as 0), and the values that columns were shifted by.

    One scan: rows are grouped by their set of missing targets, at most 2^targets groups. Rows
    with a missing column are left out. A row of the table shifts the values, so that sums of
    squares keep the digits of their spread."""
    names = [*columns, *targets]
    first = df.select(*[named(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)]).limit(1).collect()
    shift = [0.0 if v is None else float(v) for v in first[0]] if first else [0.0] * len(names)
    x = [F.coalesce(named(c).cast("double") - F.lit(s), F.lit(0.0)) for c, s in zip(names, shift, strict=True)]
    key = F.lit(0)
    for t, target in enumerate(targets):
        key = key + F.when(named(target).isNull(), F.lit(1 << t)).otherwise(F.lit(0))
    rows = df
    for c in columns:
        rows = rows.where(named(c).isNotNull())
    rows = rows.select(key.alias("key"), *[v.alias(f"x{i}") for i, v in enumerate(x)])
    k = len(names)
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(k)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    grams = {}
    for r in rows.groupBy("key").agg(*sums).collect():
        g = np.zeros((k + 1, k + 1))
        g[0, 0] = r["n"]
        for i in range(k):
            g[0, i + 1] = g[i + 1, 0] = r[f"s{i}"]
            for j in range(i, k):
                g[i + 1, j + 1] = g[j + 1, i + 1] = r[f"p{i}_{j}"]
        grams[r["key"]] = g
    return grams, np.array(shift)


def fit_chain(df: DataFrame, links: Sequence[tuple[str, Sequence[str], str]]) -> list[Fit]:
    """The least-squares fits of a chain (target, predictors, out), where a link may use the
    filled outputs of earlier ones, all from one scan of ``df``.

    A filled output is the target where it is present and a linear function of the columns
    where it is not, so for each set of missing targets it is a linear map of the Gram matrix
    of the plain columns; a link's normal equations add these maps up over the sets in which
    its target is present. Rows with a missing plain predictor take no part in any fit."""
    targets, outs = [t for t, _, _ in links], [o for _, _, o in links]
    columns = list(dict.fromkeys(p for _, ps, _ in links for p in ps if p not in outs))
    grams, shift = _gram_by_pattern(df, columns, targets)
    place = {c: i + 1 for i, c in enumerate(columns)}
    at_target = [len(columns) + 1 + t for t in range(len(targets))]
    size = 1 + len(columns) + len(targets)
    fits: list[Fit] = []
    # per set of missing targets, each output so far as a row over (1, columns, targets), shifted by its target's shift
    filled: dict[int, dict[str, np.ndarray]] = {key: {} for key in grams}
    for t, (target, predictors, out) in enumerate(links):
        a = np.zeros((len(predictors) + 1, len(predictors) + 1))
        b = np.zeros(len(predictors) + 1)
        design = {}
        for key, g in grams.items():
            d = np.zeros((len(predictors) + 1, size))
            d[0, 0] = 1.0
            for i, p in enumerate(predictors):
                if p in place:
                    d[i + 1, place[p]] = 1.0
                else:
                    d[i + 1] = filled[key][p]
            design[key] = d
            if not key >> t & 1:
                a += d @ g @ d.T
                b += d @ g[:, at_target[t]]
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
        beta = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-13)[0] / scale if a[0, 0] else np.full(len(b), np.nan)
        for key in grams:
            row = np.zeros(size)
            if key >> t & 1:
                row = beta @ design[key]
            else:
                row[at_target[t]] = 1.0
            filled[key][out] = row
        # back from shifted values to plain ones
        base = {**{c: shift[place[c] - 1] for c in columns}, **{o: shift[at_target[i] - 1] for i, o in enumerate(outs)}}
        intercept = beta[0] + shift[at_target[t] - 1] - sum(w * base[p] for w, p in zip(beta[1:], predictors, strict=True))
        fits.append(Fit(target, list(predictors), out, [float(intercept), *map(float, beta[1:])]))
    return fits


def regression_chain(df: DataFrame, links: Sequence[tuple[str, Sequence[str], str]]) -> DataFrame:
    """I5 in full: ``df`` with every link's output. The fits take one scan (:func:`fit_chain`);
    the fill is a projection. A missing target whose predictors are not all present stays
    missing, and so does one whose link had no row to learn from."""
    out = df
    for f in fit_chain(df, links):
        pred = F.lit(f.coefficients[0])
        for w, p in zip(f.coefficients[1:], f.predictors, strict=True):
            pred = pred + F.lit(w) * named(p).cast("double")
        known = all(math.isfinite(w) for w in f.coefficients)
        out = out.withColumn(f.out, F.coalesce(named(f.target).cast("double"), pred if known else F.lit(None).cast("double")))
    return out
