"""Campaign-table profile (F11): every statistic the exploratory script
prints, each as a bounded distributed query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.columns import named, numeric_columns, string_columns
from ledgerline.operators import encode, profile
from ledgerline.sources import first_rows


def campaign_profile(
    df: DataFrame,
    target: str,
    key: str,
    token: str = "unknown",
    preview: int = 3,
    scales: Mapping[str, int] | None = None,
    drop: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """shape, preview, value sets of every column, token counts, class balance, correlation
    and covariance (long form), strong correlations; and, with every string column as
    dummies, what correlates with the target (absolute value above 0.05, ascending)."""
    df = df.drop(*drop)
    strings = string_columns(df)
    numbers = [c for c in numeric_columns(df) if c != key]
    corr = profile.correlation_matrix(df, numbers, scales=scales)
    return {
        "shape": df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")),
        "preview": first_rows(df, preview, [F.col(key)]),
        "value_sets": profile.value_sets(df, df.columns),
        "token_counts": profile.token_counts(df, token, strings),
        "class_balance": profile.class_counts(df, target),
        "correlation": corr,
        "covariance": profile.correlation_matrix(df, numbers, kind="covar", scales=scales),
        "strong": profile.select_strong(
            corr.where(F.col("b") == target).withColumn("value", F.abs("value")), "value", 0.05
        ),
        "strong_dummies": dummy_profile(df, target, strings, [c for c in numbers if c != target], scales or {}),
    }


def campaign_report(df: DataFrame, target: str, key: str, **options) -> DataFrame:
    """:func:`campaign_profile` as one long result (section, item, other, value).

    ``shape`` rows and columns; ``preview`` column, value as text, row number; ``value_sets`` column
    and value; ``token_counts`` column, token, count; ``class_balance`` class, rows;
    ``correlation`` / ``covariance`` both columns; ``strong`` column and target; ``strong_dummies``
    feature and statistic (corr, covar)."""
    parts = campaign_profile(df, target, key, **options)
    token = options.get("token", "unknown")
    row = lambda section, item, other, value: [
        F.lit(section).alias("section"), item.cast("string").alias("item"), other.cast("string").alias("other"), value.cast("double").alias("value")
    ]
    none = F.lit(None)
    long = lambda names: F.explode(F.array(*[F.struct(F.lit(c).alias("c"), named(c).cast("string").alias("v")) for c in names]))
    preview = parts["preview"]
    numbered = preview.withColumn("_row", F.row_number().over(Window.orderBy(key)))  # at most ``preview`` rows
    shape = parts["shape"].select(F.explode(F.array(
        F.struct(F.lit("rows").alias("c"), F.col("rows").cast("double").alias("v")), F.struct(F.lit("columns").alias("c"), F.col("columns").cast("double").alias("v"))
    )).alias("x"))
    dummies = parts["strong_dummies"].select("feature", F.explode(F.array(
        F.struct(F.lit("corr").alias("c"), F.col("corr").alias("v")), F.struct(F.lit("covar").alias("c"), F.col("covar").alias("v"))
    )).alias("x"))
    frames = [
        shape.select(*row("shape", F.col("x.c"), none, F.col("x.v"))),
        numbered.select("_row", long(preview.columns).alias("x")).select(*row("preview", F.col("x.c"), F.col("x.v"), F.col("_row"))),
        parts["value_sets"].select(*row("value_sets", F.col("column_name"), F.col("value"), none)),
        parts["token_counts"].select(*row("token_counts", F.col("column_name"), F.lit(token), F.col("n"))),
        parts["class_balance"].select(*row("class_balance", named(target), none, F.col("n"))),
        parts["correlation"].select(*row("correlation", F.col("a"), F.col("b"), F.col("value"))),
        parts["covariance"].select(*row("covariance", F.col("a"), F.col("b"), F.col("value"))),
        parts["strong"].select(*row("strong", F.col("a"), F.col("b"), F.col("value"))),
        dummies.select(*row("strong_dummies", F.col("feature"), F.col("x.c"), F.col("x.v"))),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def dummy_profile(
    df: DataFrame, target: str, strings: Sequence[str], numbers: Sequence[str], scales: Mapping[str, int], threshold: float = 0.05,
) -> DataFrame:
    """One-hot columns of the strings next to the numbers: (feature, corr, covar) with the target."""
    wide, dummies = encode.one_hot(df.select(target, *strings, *numbers), encode.vocabularies(df, strings), with_missing=False)
    known = {**{c: 0 for c in (target, *dummies)}, **scales}
    return profile.target_profile(wide, target, [*numbers, *dummies], known, threshold)
