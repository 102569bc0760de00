"""Global ranks without a global sort in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 0) in ``order``: rows are range-partitioned, ranked
    inside their range, and the ranges' row counts (one row per partition) are added up.
    Equal rows under ``order`` get neighbouring places. The ranges are written to the
    shared checkpoint folder, so every later job sees the same ones."""
    # what is a column already is not written twice
    added = {f"_o{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    keyed = df.withColumns(added) if added else df
    keys = [c if isinstance(c, str) else f"_o{i}" for i, c in enumerate(order)]
    parts = cut_lineage(keyed.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    counts = parts.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return (
        parts.withColumn("_inside", inside).join(before, "_range")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_inside", "_before", *added)
    )
