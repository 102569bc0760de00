"""Per-key aggregation, joins back onto a base table, two-level roll-ups
(A1-A12, J1-J3).

Plan shape: every feature job is one ``HashAggregate`` (partial on the map
side, so a hot key is combined before the shuffle) followed by at most one
left join to the base rows. Catalyst keeps the aggregate's hash
partitioning, so the join only shuffles the base side; AQE may turn it into
a broadcast join when the runtime size of the aggregate is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` (a checked bound).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.aggs import Recipe


SPLIT_DISTINCT_ABOVE = 8  # plain aggregates beside a distinct count that justify a second aggregate


def group_features(
    df: DataFrame,
    key: str | Sequence[str],
    recipes: Sequence[Recipe] = (),
    extra: Sequence[Column] = (),
    distinct: Sequence[Column] = (),
) -> DataFrame:
    """One ``groupBy(key).agg(...)`` holding every recipe.

    Rows with a missing key are dropped first: the pandas group-by the
    recipes come from never forms a group for them (trap 6).

    Distinct counts (the recipes' ``nunique`` and the ``distinct`` columns)
    next to more than ``SPLIT_DISTINCT_ABOVE`` other aggregates go to their
    own aggregate, joined back on the key. A distinct aggregate makes Spark
    push *every* other partial buffer through an extra shuffle keyed by
    (key, value); split, the wide buffers shuffle once by key and only
    narrow (key, value) pairs take the distinct path. (Bounded columns are
    better written as presence counts, which need no distinct path.) Both sides come out hash-partitioned on the key, so the
    join adds no exchange."""
    keys = [key] if isinstance(key, str) else list(key)
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    rows = df.where(present)
    plain = [c for r in recipes for c in r.columns("plain")] + list(extra)
    dist = [c for r in recipes for c in r.columns("distinct")] + list(distinct)
    if not dist or len(plain) <= SPLIT_DISTINCT_ABOVE:
        # few plain buffers ride along the distinct path cheaply: one aggregate
        every = [c for r in recipes for c in r.columns()] + list(extra) + list(distinct)
        return rows.groupBy(*keys).agg(*every)
    names = rows.groupBy(*keys).agg(*[c for r in recipes for c in r.columns()], *extra, *distinct).columns  # analysis only
    joined = rows.groupBy(*keys).agg(*plain).join(rows.groupBy(*keys).agg(*dist), on=keys, how="inner")
    return joined.select(*names)


def attach(base: DataFrame, features: DataFrame, base_key: str, feature_key: str | None = None) -> DataFrame:
    """Left join of per-key features onto the base rows."""
    if feature_key and feature_key != base_key:
        features = features.withColumnRenamed(feature_key, base_key)
    return base.join(features, on=base_key, how="left")


def attach_group_stat(df: DataFrame, key: str, stats: dict[str, Column]) -> DataFrame:
    """Put per-key statistics (aggregate columns by output name) back on
    every detail row of the key.

    Written as aggregate + join rather than ``avg().over(partitionBy(key))``:
    a window sends a whole key to one task, while the aggregate combines a
    hot key map-side and AQE's skew-join handling splits a hot key on the
    detail side of the join.
    """
    stat = df.where(F.col(key).isNotNull()).groupBy(key).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(stat, on=key, how="left")


def proportion(df: DataFrame, key: str, flag: Column, name: str) -> DataFrame:
    """Per-key mean of a 0/1 flag (exact count / rows)."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.try_divide(F.sum(flag.cast("long")).cast("double"), F.count(flag)).alias(name))
    )


def two_level(
    detail: DataFrame,
    detail_key: str,
    first: Sequence[Recipe],
    parent: DataFrame,
    parent_key: str,
    group_key: str,
    second: Sequence[Recipe],
    first_extra: Sequence[Column] = (),
    second_extra: Sequence[Column] = (),
) -> DataFrame:
    """A10: aggregate detail rows to their parent (e.g. months → loan), left
    join onto the parents, aggregate parents to the group key (loan →
    customer). Parents without detail rows keep NULL first-level features,
    which the second level skips (its means are unweighted by detail rows).
    Two shuffles: by parent key, then by group key."""
    per_parent = group_features(detail, detail_key, first, first_extra)
    enriched = attach(parent, per_parent, parent_key, detail_key).drop(parent_key)
    return group_features(enriched, group_key, second, second_extra)


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """The distinct non-missing keys."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()
