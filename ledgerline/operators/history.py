"""Time-ordered history per key.

"Last n rows per key" is ``row_number()`` over ``partitionBy(key)`` kept to
``<= n``. For n up to ``spark.sql.optimizer.windowGroupLimitThreshold``
(1000 by default) Catalyst inserts a *partial* ``WindowGroupLimit`` before
the shuffle: each map task sends at most n rows per key, so a key holding a
third of all rows arrives as at most n × (map tasks) rows. Above that
threshold (or on request) ``latest_rows`` ranks in two stages instead: first
within ``(key, salt)`` buckets (a hot key spread over ``salt_buckets``
tasks, each keeping its own top n), then within the key over at most
``salt_buckets × n`` survivors. Both forms are exact.

"Last value" needs no window at all: ``max_by`` over a total order key is
an aggregate with a one-row buffer, partially aggregated map-side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.aggs import exact_mean


def _latest_first(time_col: str, tiebreak: str) -> list[Column]:
    # pandas sorts ascending with missing times last, and "tail" takes the
    # end of that order, so the latest rows are: missing time first, then the
    # largest times; ties broken by the larger id.
    return [F.col(time_col).desc_nulls_first(), F.col(tiebreak).desc()]


def latest_rows(
    df: DataFrame,
    key: str,
    time_col: str,
    tiebreak: str,
    n: int,
    salt_buckets: int | None = None,
    rank_name: str = "recency",
) -> DataFrame:
    """The last ``n`` rows per key, ``recency`` 1 = latest.
    ``salt_buckets=None`` picks the form (see the module note)."""
    order = _latest_first(time_col, tiebreak)
    if salt_buckets is None:
        limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
        if n <= limit:
            ranked = df.where(F.col(key).isNotNull()).withColumn(
                rank_name, F.row_number().over(Window.partitionBy(key).orderBy(*order))
            )
            return ranked.where(F.col(rank_name) <= n)
        salt_buckets = 32
    salted = df.where(F.col(key).isNotNull()).withColumn(
        "_salt", F.pmod(F.xxhash64(F.col(tiebreak)), F.lit(salt_buckets))
    )
    stage1 = salted.withColumn(
        "_r1", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    ).where(F.col("_r1") <= n)
    stage2 = stage1.withColumn(
        rank_name, F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ).where(F.col(rank_name) <= n)
    return stage2.drop("_salt", "_r1")


def last_n_means(
    df: DataFrame,
    key: str,
    time_col: str,
    tiebreak: str,
    measures: Mapping[str, str],
    ns: Sequence[int] = (1, 3, 5),
    scales: Mapping[str, int] | None = None,
    salt_buckets: int | None = None,
) -> DataFrame:
    """Mean of each measure over the last n rows, for every n at once.

    ``measures`` maps a column to its output name template with ``{n}``.
    """
    scales = scales or {}
    top = latest_rows(df, key, time_col, tiebreak, max(ns), salt_buckets)
    cols = []
    for n in ns:
        for col, template in measures.items():
            x = F.when(F.col("recency") <= n, F.col(col))
            agg = exact_mean(x, scales[col]) if col in scales else F.avg(x)
            cols.append(agg.alias(template.format(n=n)))
    return top.groupBy(key).agg(*cols)


def last_value(
    df: DataFrame,
    key: str,
    time_col: str,
    tiebreak: str,
    values: Mapping[str, Column],
) -> DataFrame:
    """The value at the latest row per key (missing values skipped, as
    pandas ``last`` does). One aggregate, no window, no sort."""
    order = F.struct(
        F.col(time_col).isNull().alias("t_missing"),
        F.col(time_col).alias("t"),
        F.col(tiebreak).alias("id"),
    )
    cols = [F.max_by(v, F.when(v.isNotNull(), order)).alias(name) for name, v in values.items()]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*cols)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top k (``TakeOrderedAndProject``: a bounded heap per task)."""
    return df.orderBy(*order).limit(k)
