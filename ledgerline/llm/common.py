"""Shared helpers of the corpus operators: table reading, id hashing, work tables.

Intermediate results that several jobs read are written once as Parquet in the
shared folder named by ``spark.checkpoint.dir`` (:class:`Workspace`): the files
outlive the executors that wrote them, so later jobs never depend on a
machine-local copy.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read by Spark whatever the store."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(col: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo ``modulus`` (the train / held-out fold)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % modulus


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, text) with a null text read as empty; every other column is dropped
    before the operator sees the rows, so extra or clashing names cannot reach it."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *more,
    )


class Workspace:
    """A fresh folder below the shared checkpoint folder for one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/ledgerline-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it as read back from the shared folder."""
        path = f"{self.path}/{name}"
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def drop(self, name: str) -> None:
        """Delete a table of this workspace that no later job reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors' Python workers (once per context), so that
    its functions can be imported there wherever the driver found the package."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerline_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="ledgerline-src-")) / "ledgerline_sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._ledgerline_shipped = True
