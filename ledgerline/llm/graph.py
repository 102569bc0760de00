"""Connected components of a link table, on Spark.

Every task first contracts its links with union-find to a forest; large-star and
small-star rounds then join the forests until no link changes. Links and
components stay in tables; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace


def forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Union-find over links: every node that is not a root, with its root (the smallest node)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return nodes, [root(x) for x in nodes]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []
    for batch in batches:
        a, b = forest(a + batch.column(0).to_pylist(), b + batch.column(1).to_pylist())
    for i in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_pydict({"a": np.array(a[i : i + 100_000], np.int64), "b": np.array(b[i : i + 100_000], np.int64)})


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) of every node of ``links`` (columns a, b): the smallest node it reaches."""
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    state = work.save(links.mapInArrow(_contract, "a long, b long").distinct(), f"{name}_0")
    mark, step = None, 0
    while True:
        # one row, whatever the number of links
        seen = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark or seen[0] == 0:
            break
        mark, step = seen, step + 1
        after = work.save(_small_star(_large_star(state).distinct()).distinct(), f"{name}_{step}")
        work.drop(f"{name}_{step - 1}")
        state = after
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        state.select("b", "b").distinct()
    )
