"""Table profile (A13-A20): value sets, token counts, class balance,
correlation and covariance with a target.

Every statistic is one aggregate pass over the table with a bounded result
(one row, or one row per column / column pair); nothing row-level reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.aggs import exact_corr, exact_covar
from ledgerline.functions.columns import named


def report(x: Column, digits: int) -> Column:
    """Round half up to ``digits`` decimals with plain double arithmetic
    (``floor(x·10^d + 0.5) / 10^d``), so any engine gives the same double."""
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def value_sets(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The distinct values of every column, long form (column_name, value).
    Distributed ``distinct``; no per-column set is built in one buffer."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), named(c).cast("string").alias("value")) for c in cols])
    )
    return df.select(pairs.alias("p")).select("p.column_name", "p.value").distinct()


def token_counts(df: DataFrame, token: str, cols: Sequence[str] | None = None) -> DataFrame:
    """How often ``token`` appears in each string column (one pass), long form."""
    cols = cols if cols is not None else [c for c, t in df.dtypes if t == "string"]
    wide = df.agg(*[F.count_if(named(c) == F.lit(token)).alias(c) for c in cols])
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), named(c).alias("n")) for c in cols])).alias("p")
    ).select("p.column_name", "p.n")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _pairwise(a: Column, b: Column) -> tuple[Column, Column]:
    # pairwise-complete: each input is blanked where the other one is missing
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def corr_expr(a: Column, b: Column) -> Column:
    """Pearson correlation that yields NULL (not an error, not NaN) for a
    constant column: covariance over the product of standard deviations."""
    x, y = _pairwise(a, b)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def _corr(a: str, b: str, scales: Mapping[str, int] | None) -> Column:
    if scales and a in scales and b in scales:
        return exact_corr(named(a), named(b), scales[a], scales[b])
    return corr_expr(named(a).cast("double"), named(b).cast("double"))


def _covar(a: str, b: str, scales: Mapping[str, int] | None) -> Column:
    if scales and a in scales and b in scales:
        return exact_covar(named(a), named(b), scales[a], scales[b])
    x, y = _pairwise(named(a).cast("double"), named(b).cast("double"))
    return F.covar_samp(x, y)


def target_correlation(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    absolute: bool = False,
    digits: int | None = None,
    scales: Mapping[str, int] | None = None,
) -> DataFrame:
    """Correlation of every feature with the target, long form
    (feature, corr); one aggregate pass. Fixed-point columns (``scales``)
    use exact co-moments; others the streaming double form."""
    exprs = []
    for f in features:
        c = _corr(f, target, scales)
        if absolute:
            c = F.abs(c)
        if digits is not None:
            c = report(c, digits)
        exprs.append(c.alias(f))
    wide = df.agg(*exprs)
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), named(f).alias("corr")) for f in features])).alias("p")
    ).select("p.feature", "p.corr")


def target_profile(df: DataFrame, target: str, features: Sequence[str], scales: Mapping[str, int], threshold: float = 0.05) -> DataFrame:
    """A17 + A19 + A20 against the target only: (feature, corr, covar) of every fixed-point
    feature, absolute correlations above ``threshold``, sorted by them (then by name). One
    aggregate pass over the rows."""
    exprs = []
    for i, f in enumerate(features):
        exprs += [F.abs(_corr(f, target, scales)).alias(f"r{i}"), _covar(f, target, scales).alias(f"v{i}")]
    wide = df.agg(*exprs)
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("corr"), F.col(f"v{i}").alias("covar")) for i, f in enumerate(features)])).alias("p"))
    return rows.select("p.*").where(F.col("corr") > F.lit(threshold)).orderBy("corr", "feature")


PAIRS_PER_PASS = 256  # column pairs aggregated in one scan


def correlation_matrix(
    df: DataFrame,
    cols: Sequence[str],
    digits: int | None = None,
    kind: str = "corr",
    scales: Mapping[str, int] | None = None,
    pairs_per_pass: int = PAIRS_PER_PASS,
) -> DataFrame:
    """All pairs (pairwise-complete), long form (a, b, value), both
    orders and the diagonal. Fixed-point columns (every one in ``scales``) are one
    Gram matrix, built in a single scan whatever their number. Pairs of other
    columns are aggregated in batches (one scan and one single-row aggregate per
    batch), so a wide table does not become one aggregate with tens of
    thousands of buffers."""
    if scales and all(c in scales for c in cols):
        from ledgerline.operators import gram

        half = gram.statistic(df, cols, scales, kind)
        if digits is not None:
            half = half.withColumn("value", report(F.col("value"), digits))
        sides = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = F.explode(F.when(F.col("a") == F.col("b"), F.slice(sides, 1, 1)).otherwise(sides))
        return half.select(both.alias("p"), "value").select("p.a", "p.b", "value")
    pairs = list(combinations(cols, 2)) + [(c, c) for c in cols]
    parts = []
    for start in range(0, len(pairs), pairs_per_pass):
        items = []
        for a, b in pairs[start:start + pairs_per_pass]:
            v = _corr(a, b, scales) if kind == "corr" else _covar(a, b, scales)
            if digits is not None:
                v = report(v, digits)
            items.append((a, b, v))
        wide = df.agg(*[v.alias(f"{a}\u0001{b}") for a, b, v in items])
        structs = []
        for a, b, _ in items:
            value = named(f"{a}\u0001{b}").alias("value")
            structs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value))
            if a != b:
                structs.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), value))
        parts.append(wide.select(F.explode(F.array(*structs)).alias("p")).select("p.a", "p.b", "p.value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def select_strong(corrs: DataFrame, value: str = "corr", threshold: float = 0.05) -> DataFrame:
    """Keep entries above the threshold (missing dropped), sorted ascending."""
    return corrs.where(F.col(value) > F.lit(threshold)).orderBy(value)
