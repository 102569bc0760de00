"""The per-key feature recipes on a stream of detail rows.

The scripts have no streaming; this module only lets the same recipe
aggregates (A2-A9, A11) keep a feature table current as new detail files
arrive, instead of recomputing it. Structured Streaming holds the partial
aggregates (sums, counts, decimal unit sums) in its checkpointed state
store, so a restarted query resumes where it stopped.

Distinct counts are not available on streams (Spark refuses them); use the
batch job for ``nunique``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerline.functions.aggs import Recipe
from ledgerline.operators import grouped
from ledgerline.session import checkpoint_dir


def detail_stream(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 16) -> DataFrame:
    """New parquet files under ``path`` as a stream (declared schema)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def feature_stream(
    detail: DataFrame,
    key: str,
    recipes: Sequence[Recipe],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """The streaming counterpart of ``grouped.group_features``."""
    for r in recipes:
        if any("nunique" in aggs for aggs in r.spec.values()):
            raise ValueError("distinct counts are not supported on streams")
    return grouped.group_features(detail, key, recipes, extra)


def run_updates(
    features: DataFrame,
    sink: Callable[[DataFrame, int], None],
    name: str,
    checkpoint: str | None = None,
    trigger_seconds: int | None = None,
) -> StreamingQuery:
    """Start the feature query in ``update`` mode; each micro-batch's changed
    keys go to ``sink(batch_df, batch_id)`` (e.g. a MERGE into a table).
    State lives under the shared checkpoint folder unless one is given."""
    location = checkpoint or f"{checkpoint_dir(features.sparkSession).rstrip('/')}/streams/{name}"
    writer = features.writeStream.outputMode("update").option("checkpointLocation", location).foreachBatch(sink)
    if trigger_seconds:
        writer = writer.trigger(processingTime=f"{trigger_seconds} seconds")
    return writer.queryName(name).start()
