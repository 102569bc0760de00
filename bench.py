"""Benchmark: run the headline registered queries at $BENCH_SF_DIR on
local[$BENCH_CPUS] and print one JSON line.

Each query is executed end to end with a ``noop`` write (the whole plan runs
on the executors, nothing is collected); the time includes the small
planning jobs some queries run first (vocabularies, medians). The headline
set runs first, $BENCH_REPEAT times (default 2); each query reports its median, and
``runs`` has every run. ``value`` sums the medians of the headline set. Every other
registered query of the catalog runs once after that, while fewer than $BENCH_BUDGET seconds
(default 900) have gone since the start; a query that takes more than $BENCH_LIMIT seconds
(default 180) is cancelled. Queries that were cancelled, failed or not begun are listed in
``not_ended``. The line is printed too when the process is asked to stop (SIGTERM).
"""

from __future__ import annotations

import json
import os
import signal
import sys
import threading
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "customer_features", "prev_features", "agg_recipe", "prev_behaviour", "last_n_mean", "last_value", "agg_family",
    "agg_two_level", "bureau_features", "pos_features", "instalment_features", "card_features",
    "application_features", "loan_history", "attach_group_mean", "clean_features", "onehot_nan",
    "factorize", "label_encode", "target_corr", "corr_matrix", "covariance", "impute_median",
    "impute_mode", "hash_split", "oversample", "class_report", "roc_auc", "threshold_sweep",
    "fit_gbt", "fit_logistic",
]


def _timed(spark, fn, sf_dir: str, limit: float) -> float:
    """Seconds of one run; its jobs are cancelled, and an error raised, after ``limit`` seconds."""
    timer = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
    timer.daemon = True
    t0 = time.perf_counter()
    timer.start()
    try:
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    finally:
        timer.cancel()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "2")))
    budget, limit = float(os.environ.get("BENCH_BUDGET", "900")), float(os.environ.get("BENCH_LIMIT", "180"))
    only = sys.argv[1:]
    begun = time.perf_counter()

    from ledgerline.plans.catalog import REGISTRY
    from ledgerline.session import local_session

    headline = [n for n in HEADLINE if not only or n in only]
    rest = [n for n in REGISTRY if n not in HEADLINE and (not only or n in only)]
    runs: dict[str, list[float]] = {}
    not_ended = dict.fromkeys(headline + rest, "not begun")

    def line() -> str:
        times = {name: round(median(r), 3) for name, r in runs.items()}
        sf = Path(sf_dir).name.removeprefix("sf")
        return json.dumps({
            "metric": "total_headline_query_time",
            "value": round(sum(t for n, t in times.items() if n in HEADLINE), 3),
            "unit": "sec",
            "queries": times,
            "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            "cpus": cpus,
            "repeat": repeat,
            "statistic": "median",
            "runs": runs,
            "not_ended": not_ended,
        })

    def stop(*_):
        print(line(), flush=True)
        os._exit(0)

    signal.signal(signal.SIGTERM, stop)
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="ledgerline-bench")
    # warm the JVM (class loading, JIT of the aggregation paths) with one
    # untimed feature job, so the first timed query is not a cold start
    REGISTRY["pos_features"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()

    def run(name: str, most: float) -> None:
        try:
            took = _timed(spark, REGISTRY[name][0], sf_dir, most)
        except Exception as e:  # noqa: BLE001 - one failing query must not lose the other figures
            not_ended[name] = f"{type(e).__name__} or cancelled after {most:.0f} s"
            print(f"# {name}: {not_ended[name]}", file=sys.stderr)
            return
        not_ended.pop(name, None)
        runs.setdefault(name, []).append(took)
        print(f"# {name}: {took:.2f}s", file=sys.stderr)

    for _ in range(repeat):
        for name in headline:
            run(name, limit)
    for name in rest:
        left = budget - (time.perf_counter() - begun)
        if left > 0:
            run(name, min(limit, max(left, 1.0)))
    print(line(), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
