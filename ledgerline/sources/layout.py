"""Tables laid out by key, for jobs that run again and again.

A table bucketed and sorted on its key is read with that partitioning: an aggregate or a
join on the key needs no exchange. The layout costs one shuffle when the table is written;
every later job over it saves its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ledgerline.session import checkpoint_dir


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder in ``buckets`` buckets of ``key``, each sorted by
    it, and read back. Tables that meet on their keys take the same number of buckets; a bucket
    should fit a task (a hot key stays in one bucket: pre-aggregate or salt it before)."""
    spark = df.sparkSession
    table = f"ledgerline_{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{table}"
    # one writer per bucket, so that a bucket is one file
    rows = df.repartition(buckets, key)
    rows.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
