"""Exact co-moments of many fixed-point columns in one scan.

Counts, sums, square sums and products of all column pairs are one Gram matrix. Tasks build
it in blocks of rows as matrix products over 20-bit pieces of the integer units, so every
product of a block is an exact whole number in a double; pieces are put together as whole
numbers, and the tasks' matrices (one row per pair) are added up as 38-digit decimals. A
missing value leaves the row out of the pairs that hold it (pairwise-complete), by products
with the 0/1 matrix of present values.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.aggs import units
from ledgerline.functions.columns import named
from ledgerline.session import ship

#: 2^12 products of two 20-bit pieces stay below 2^53
PIECE, ROWS = 20, 1 << 12
#: blocks added in 64 bits before they are put together
BLOCKS = 64

MEASURES = ("n", "sx", "sy", "sxx", "syy", "sxy")


class _Sums:
    """Matrices by power of 2^PIECE, as 64-bit whole numbers until they are put together."""

    def __init__(self, k: int):
        self.total = np.zeros((k, k), object)
        self.parts: dict[int, np.ndarray] = {}

    def add(self, power: int, product: np.ndarray) -> None:
        whole = product.astype(np.int64)
        if power in self.parts:
            self.parts[power] += whole
        else:
            self.parts[power] = whole

    def flush(self) -> np.ndarray:
        for power, part in self.parts.items():
            self.total = self.total + part.astype(object) * (1 << (PIECE * power))
        self.parts = {}
        return self.total


def _pieces(u: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as 20-bit pieces, the highest one signed."""
    top = max(abs(int(u.min(initial=0))), abs(int(u.max(initial=0)))).bit_length()
    n = max(1, -(-top // PIECE))
    low = [((u >> (PIECE * i)) & ((1 << PIECE) - 1)).astype(np.float64) for i in range(n - 1)]
    return [*low, (u >> (PIECE * (n - 1))).astype(np.float64)]


def _gram(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, p = (_Sums(k) for _ in range(4))
        blocks = 0
        for batch in batches:
            present = np.stack([~np.asarray(c.is_null()) for c in batch.columns], 1)
            values = np.stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(np.int64)
            for at in range(0, len(values), ROWS):
                m = present[at : at + ROWS].astype(np.float64)
                u = _pieces(values[at : at + ROWS])
                n.add(0, m.T @ m)
                for i, a in enumerate(u):
                    s.add(i, a.T @ m)
                    for j, b in enumerate(u):
                        p.add(i + j, a.T @ b)
                        q.add(i + j, (a * b).T @ m)
                blocks += 1
                if blocks % BLOCKS == 0:
                    for x in (n, s, q, p):
                        x.flush()
        if blocks:
            n_, s_, q_, p_ = (x.flush() for x in (n, s, q, p))
            i, j = np.triu_indices(k)
            columns = [n_[i, j], s_[i, j], s_[j, i], q_[i, j], q_[j, i], p_[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array([str(v) for v in c]) for c in columns)],
                names=["i", "j", *MEASURES],
            )

    return run


def comoments(df: DataFrame, cols: Sequence[str], scales: Mapping[str, int]) -> DataFrame:
    """(a, b, n, sx, sy, sxx, syy, sxy) of every pair of ``cols`` (a no later than b), in integer
    units: counts and sums over the rows in which both are present, as decimal(38,0)."""
    ship(df.sparkSession)
    u = df.select(*[units(named(c), scales[c]).cast("bigint").alias(f"u{i}") for i, c in enumerate(cols)])
    schema = "i int, j int, " + ", ".join(f"{m} string" for m in MEASURES)
    parts = u.mapInArrow(_gram(len(cols)), schema)
    total = parts.groupBy("i", "j").agg(*[F.sum(F.col(m).cast("decimal(38,0)")).cast("decimal(38,0)").alias(m) for m in MEASURES])
    names = F.array(*[F.lit(c) for c in cols])
    return total.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), *MEASURES)


def statistic(df: DataFrame, cols: Sequence[str], scales: Mapping[str, int], kind: str = "corr") -> DataFrame:
    """(a, b, value) of every pair and the diagonal (a no later than b): ``corr`` or ``covar``.
    Numerators are exact, then converted and divided once, as in :mod:`ledgerline.functions.aggs`."""
    pairs = comoments(df, cols, scales)
    wide = lambda c: c.cast("decimal(38,0)")
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    cxy = wide(wide(n * F.col("sxy")) - wide(sx * sy)).cast("double")
    if kind == "corr":
        cxx = wide(wide(n * F.col("sxx")) - wide(sx * sx)).cast("double")
        cyy = wide(wide(n * F.col("syy")) - wide(sy * sy)).cast("double")
        value = F.try_divide(cxy, F.sqrt(cxx * cyy))
    else:
        places = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(scales[c]))])
        power = F.pow(F.lit(10.0), F.element_at(places, F.col("a")) + F.element_at(places, F.col("b"))).cast("decimal(38,0)")
        value = F.when(n > 1, cxy / wide(wide(n * (n - 1)) * power).cast("double"))
    return pairs.select("a", "b", value.alias("value"))
