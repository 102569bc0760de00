"""Splits and class rebalancing (M1, M2).

Both are deterministic functions of a row key, so a re-run — or a task
retried after an executor loss — selects exactly the same rows, and the
result does not depend on partitioning (``randomSplit`` does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_bucket(key: str | Column, buckets: int = 100) -> Column:
    """Stable bucket in [0, buckets) from the md5 of the key text."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def hash_split(df: DataFrame, key: str, test_percent: int = 20, name: str = "split") -> DataFrame:
    """M1: label rows ``train`` / ``test`` by key hash (test share = test_percent %)."""
    return df.withColumn(name, F.when(key_bucket(key) < F.lit(test_percent), F.lit("test")).otherwise(F.lit("train")))


def train_test(df: DataFrame, key: str, test_percent: int = 20) -> tuple[DataFrame, DataFrame]:
    b = key_bucket(key)
    return df.where(b >= F.lit(test_percent)), df.where(b < F.lit(test_percent))


COPIES_PER_STEP = 1_000_000  # copies of one row that one expression holds at a time


def key_hash(key: str | Column) -> Column:
    """52-bit stable hash of the key text (first 13 hex digits of its md5); independent
    draws salt the text."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 13), 16, 10).cast("bigint")


def draw_place(n: int, seed: int, *parts: Column) -> Column:
    """A place in 0 .. n-1 drawn for ``parts`` (md5 of ``seed|part|...``): draws with replacement
    that any engine and any retried task repeats."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.pmod(key_hash(text), F.lit(n))


def bootstrap(df: DataFrame, label: str, key: str, minority=1, majority=0, seed: int = 0, copy_col: str = "copy") -> DataFrame:
    """M2: the majority as it is and as many draws with replacement from the minority.

    Draw i takes the minority row at place md5(seed|i) mod n in a total row order (key hash,
    key, then the hash of the whole row). Draws are generated and counted per place on the
    executors, places are a distributed rank, and the two meet by an equi-join: exact in size,
    repeatable, and at no point is a class on the driver. A row drawn m times appears with
    copy numbers 0 .. m-1, one that is not drawn not at all. Rows of other labels stay out, as
    in the scripts; without minority or majority rows ``df`` comes back unchanged."""
    from ledgerline.operators.ranking import global_rank

    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n_min, n_maj = counts.get(minority, 0), counts.get(majority, 0)
    if n_min == 0 or n_maj == 0:
        return df.withColumn(copy_col, F.lit(0))
    draws = df.sparkSession.range(n_maj).select(draw_place(n_min, seed, F.col("id")).alias("_place"))
    drawn = draws.groupBy("_place").agg(F.count(F.lit(1)).alias("_draws"))
    minor = global_rank(df.where(F.col(label) == F.lit(minority)), [key_hash(key), F.col(key), F.xxhash64(*df.columns)], "_place")
    copies = F.explode(F.sequence(F.lit(0), F.col("_draws").cast("int") - 1))
    grown = minor.join(drawn, "_place").select(*df.columns, copies.alias(copy_col))
    return df.where(F.col(label) == F.lit(majority)).withColumn(copy_col, F.lit(0)).unionByName(grown)


def oversample(df: DataFrame, label: str, key: str, minority=1, majority=0, copy_col: str = "copy") -> DataFrame:
    """M2: grow the minority class to exactly the majority's size.

    Balanced replication instead of a with-replacement draw: every minority
    row appears ``q = n_major // n_minor`` times, and the ``r = n_major -
    q·n_minor`` minority rows that come first in a total row order (key hash,
    key, then the hash of the whole row) appear once more; keys may repeat.
    The order is a distributed rank, at every size; copies are generated in
    two nested steps, so no expression holds more than ``COPIES_PER_STEP``.
    """
    from ledgerline.operators.ranking import global_rank

    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n_min, n_maj = counts.get(minority, 0), counts.get(majority, 0)
    if n_min == 0 or n_maj <= n_min:
        return df.withColumn(copy_col, F.lit(0))
    q, r = divmod(n_maj, n_min)
    minor = df.where(F.col(label) == F.lit(minority))
    rank = F.lit(0)
    if r:
        minor = global_rank(minor, [key_hash(key), F.col(key), F.xxhash64(*df.columns)], "_rank")
        rank = F.col("_rank")
    copies = F.when(rank < F.lit(r), F.lit(q + 1)).otherwise(F.lit(q)).cast("bigint")
    step = F.lit(COPIES_PER_STEP).cast("bigint")
    stepped = minor.withColumn("_copies", copies).withColumn("_step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_copies - 1) div {COPIES_PER_STEP}"))))
    stop = F.least((F.col("_step") + 1) * step, F.col("_copies")) - 1
    grown = stepped.withColumn(copy_col, F.explode(F.sequence(F.col("_step") * step, stop))).withColumn(copy_col, F.col(copy_col).cast("int")).select(*df.columns, copy_col)
    return df.where(F.col(label) == F.lit(majority)).withColumn(copy_col, F.lit(0)).unionByName(grown)
