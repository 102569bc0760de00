"""Session helpers.

The library never owns the cluster configuration: it reads what the caller's
session says and only fills gaps (tests, local runs).
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Settings the library's plans are designed for on a cluster (the job's
# configuration owns them; nothing here sets them on a shared session).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",                      # runtime re-planning
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",             # split hot keys on the detail side of joins
    "spark.sql.files.maxPartitionBytes": "256m",               # scan splits
    "spark.sql.shuffle.partitions": "4000",                    # upper bound; AQE coalesces
    "spark.sql.codegen.maxFields": "1000",                     # wide feature aggregates keep codegen
    "spark.sql.ansi.enabled": "true",                          # overflow raises, never wraps
    "spark.checkpoint.dir": "<shared folder, e.g. an object-store path>",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerline") -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # wide feature aggregates (hundreds of buffer fields) keep whole-stage
        # codegen; methods over the JVM limit fall back to interpretation
        .config("spark.sql.codegen.maxFields", "1000")
        .config("spark.driver.memory", os.environ.get("LEDGERLINE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session leaves it unset and runs locally (tests) is a
    fresh scratch folder created and registered; a cluster session without
    a shared folder raises (a machine-local folder would not survive the
    loss of the executor that wrote it).
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder: a machine-local scratch "
            "folder does not survive the loss of the executor that wrote it"
        )
    # spark.checkpoint.dir cannot change at runtime: register the scratch
    # folder with the context (found again above on the next call)
    path = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    ``min_partitions``: iterative consumers (learners, multi-pass statistics)
    want at least one partition per core. A frame that came out with fewer
    partitions (only a small one does, after AQE coalescing) is spread
    round-robin and written once more; large frames are left as they are.
    A cluster session without a shared folder raises (see :func:`checkpoint_dir`)."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if min_partitions and out.rdd.getNumPartitions() < min_partitions:
        out = out.repartition(min_partitions).checkpoint(eager=True)
    return out


def cores(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def release(spark: SparkSession) -> None:
    """Between the steps of a long job: let Spark's cleaner delete the files of shuffles that
    nothing refers to any more (it waits for collections of the driver's garbage, which a
    driver with little to hold may not run for half an hour)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors' Python workers (once per context), so that
    functions of tasks can be imported there wherever the driver found the package."""
    sc = spark.sparkContext
    if getattr(sc, "_ledgerline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ledgerline-src-")) / "ledgerline_sources.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, str(source.relative_to(root.parent)))
    sc.addPyFile(str(target))
    sc._ledgerline_shipped = True
