"""Per-stage task summary of one registered query from Spark's event log
(written to a fresh scratch folder; the UI stays off).

    python tools/stage_report.py <query> [sf_dir] [--skew] [--spread]

``--skew`` moves a third of all orders onto one customer first (for the
order-based queries), to show how the hot key's work is spread over tasks.
"""

from __future__ import annotations

import glob
import json
import statistics
import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main(argv: list[str]) -> None:
    name = argv[1]
    sf_dir = next((a for a in argv[2:] if a.startswith("/")), "/root/testdata/sf0.1")
    skew = "--skew" in argv
    spread = "--spread" in argv  # no partition coalescing, small scan splits
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    logdir = tempfile.mkdtemp(prefix="ledgerline-events-")
    spark = (
        SparkSession.builder.master("local[8]").appName(f"stage-report-{name}")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logdir)
        .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
        .config("spark.sql.shuffle.partitions", "16").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.maxFields", "1000")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false" if spread else "true")
        .config("spark.sql.files.maxPartitionBytes", "256k" if spread else "128m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from ledgerline.plans import catalog

    if skew:
        original = catalog._t

        def skewed(spark_, d, table):
            df = original(spark_, d, table)
            if table == "orders":
                df = df.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")))
            return df

        catalog._t = skewed
    catalog.REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    stages: dict[int, list[tuple[int, int]]] = {}
    names: dict[int, str] = {}
    for path in [p for p in glob.glob(f"{logdir}/**/*", recursive=True) if Path(p).is_file() and "appstatus" not in p]:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerTaskEnd":
                    info, metrics = ev["Task Info"], ev.get("Task Metrics") or {}
                    shuffle = metrics.get("Shuffle Read Metrics", {})
                    records = shuffle.get("Total Records Read", 0) + metrics.get("Input Metrics", {}).get("Records Read", 0)
                    stages.setdefault(ev["Stage ID"], []).append((info["Finish Time"] - info["Launch Time"], records))
                elif kind == "SparkListenerStageCompleted":
                    names[ev["Stage Info"]["Stage ID"]] = ev["Stage Info"]["Stage Name"].split(" at ")[0]
    print(f"{name}{' (skewed)' if skew else ''}: {len(stages)} stages, {sum(len(t) for t in stages.values())} tasks")
    print(f"{'stage':>5} {'tasks':>5} {'max ms':>7} {'med ms':>7} {'max rec':>9} {'med rec':>9}  name")
    for sid in sorted(stages):
        t = stages[sid]
        d = [x[0] for x in t]
        r = [x[1] for x in t]
        print(f"{sid:>5} {len(t):>5} {max(d):>7} {int(statistics.median(d)):>7} {max(r):>9} {int(statistics.median(r)):>9}  {names.get(sid, '')}")


if __name__ == "__main__":
    main(sys.argv)
