"""Logistic regression over one-hot vectors of any number of places (T6 with E1).

Spark ML's learner keeps several arrays of all coefficients on the driver and in every task;
this one keeps them nowhere. The caller names a column whose values the places are *nested* in
(parts for part-supplier pairs: a place occurs under one value of it). Equal vectors become one
row with its counts, rows of one value meet in one block, and a block's coefficients depend on
other blocks by the intercept alone. For a given intercept every block finds its optimum in a
task; the intercept is moved by Newton steps on the sums of the blocks. The result is the exact
minimum, whatever the blocks, and the coefficients are a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.columns import named
from ledgerline.operators.encode import places
from ledgerline.session import cut_lineage, release, ship

#: different vectors in one block
ROWS_PER_BLOCK = 1 << 16


class NotNested(ValueError):
    pass


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * m))


def _conjugate(times, g: np.ndarray, diag: np.ndarray, tol: float, steps: int = 500) -> np.ndarray:
    """x with H x = g up to ``tol`` by conjugate gradients, scaled by the diagonal."""
    x, r = np.zeros_like(g), g.copy()
    z = r / diag
    p, rz = z.copy(), float(r @ z)
    end = tol * tol * rz
    for _ in range(steps):
        if rz <= end or rz == 0.0:
            break
        hp = times(p)
        a = rz / float(p @ hp)
        x += a * p
        r -= a * hp
        z = r / diag
        rz, before = float(r @ z), rz
        p = z + (rz / before) * p
    return x


class _Curvature:
    """Solves H x = g for H = X' diag(q) X + diag(penalty). A place that one row alone has (the
    finest of nested ones, equal vectors being one row) is eliminated exactly, one a row; what is
    left goes to conjugate gradients, which nested places then leave little to do."""

    def __init__(self, row: np.ndarray, col: np.ndarray, size: int, k: int):
        alone = np.flatnonzero(np.bincount(col, minlength=k)[col] == 1)
        _, first = np.unique(row[alone], return_index=True)
        own = alone[first]
        self.row, self.col = row[own], col[own]
        rest = np.ones(k, bool)
        rest[self.col] = False
        self.rest, self.size = np.flatnonzero(rest), size
        entry = rest[col]
        self.r, self.c = row[entry], (np.cumsum(rest) - 1)[col[entry]]

    def into(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, v[self.c], self.size)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.c, v[self.r], len(self.rest))

    def solved(self, q: np.ndarray, penalty: np.ndarray, g: np.ndarray, tol: float) -> np.ndarray:
        x = np.zeros_like(g)
        own = q[self.row] + penalty[self.col]
        weight, pulled = q.copy(), np.zeros(self.size)
        weight[self.row] *= penalty[self.col] / own
        pulled[self.row] = q[self.row] * g[self.col] / own
        if len(self.rest):
            left = penalty[self.rest]
            times = lambda v: self.back(weight * self.into(v)) + left * v
            x[self.rest] = _conjugate(times, g[self.rest] - self.back(pulled), self.back(weight) + left, tol)
        x[self.col] = (g[self.col] - q[self.row] * self.into(x[self.rest])[self.row]) / own
        return x


def solve(row: np.ndarray, col: np.ndarray, n: np.ndarray, ones: np.ndarray, penalty: np.ndarray, intercept: float, tol: float = 1e-7):
    """Coefficients that minimise the log loss of rows with ``n`` copies, ``ones`` of them of
    class 1, plus ``penalty`` / 2 times their squares; ``(row, col)`` are the ones of the matrix.
    Also the slope and curvature of that minimum in the intercept."""
    k, size = len(penalty), len(n)
    w = np.zeros(k)
    into = lambda v: np.bincount(row, v[col], size)
    back = lambda v: np.bincount(col, v[row], k)
    loss = lambda m, w: float((n * np.logaddexp(0.0, m) - ones * m).sum() + 0.5 * (penalty * w * w).sum())
    curvature = _Curvature(row, col, size, k)
    m = intercept + into(w)
    value = loss(m, w)
    for _ in range(100):
        p = _sigmoid(m)
        g = back(n * p - ones) + penalty * w
        q = n * p * (1.0 - p)
        size_g = math.sqrt(float((g * g / (back(q) + penalty)).sum()) / max(float(n.sum()), 1.0))
        if size_g <= tol:
            break
        d = curvature.solved(q, penalty, g, min(0.1, size_g))
        step, down = 1.0, float(g @ d)
        while True:
            tried = w - step * d
            m = intercept + into(tried)
            now = loss(m, tried)
            if now <= value - 1e-4 * step * down or step < 1e-6:
                break
            step /= 2
        stuck = now >= value
        w, value = tried, now
        if stuck:
            break
    p = _sigmoid(m)
    q = n * p * (1.0 - p)
    cross = back(q)
    turn = curvature.solved(q, penalty, cross, 1e-6)
    return w, float((n * p - ones).sum()), max(float(q.sum() - cross @ turn), 0.0)


_PACKED = "block long, rows binary"


def _pack(key, table):
    at = table.column("at").combine_chunks()
    lengths = np.diff(at.offsets.to_numpy())
    parts = [np.array([len(lengths), int(lengths.sum())], np.int64), lengths.astype(np.int32), at.flatten().to_numpy().astype(np.int32)]
    parts += [table.column(c).to_numpy().astype(np.int64) for c in ("n", "ones")]
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "rows": pa.array([b"".join(p.tobytes() for p in parts)], pa.binary())})


def _opened(b) -> tuple[np.ndarray, ...]:
    size, entries = np.frombuffer(b, np.int64, 2).tolist()
    lengths = np.frombuffer(b, np.int32, size, 16)
    at = np.frombuffer(b, np.int32, entries, 16 + 4 * size)
    n, ones = np.frombuffer(b, np.int64, 2 * size, 16 + 4 * (size + entries)).reshape(2, size).astype(np.float64)
    return np.repeat(np.arange(size), lengths), at, n, ones


def _pass(intercept: float, total: float, reg: float, coefficients: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("rows"):
                row, at, n, ones = _opened(b.as_buffer())
                place, col = np.unique(at, return_inverse=True)
                share = np.bincount(col, n[row], len(place)) / total
                # the penalty is on standardised places, as Spark ML's; one that all rows have is the intercept
                varies = share < 1.0
                keep = varies[col]
                column = np.cumsum(varies) - 1
                spread = share[varies] * (1.0 - share[varies]) * total / max(total - 1.0, 1.0)
                w, slope, curve = solve(row[keep], column[col[keep]], n, ones, total * reg * spread, intercept)
                if coefficients:
                    yield pa.RecordBatch.from_arrays([pa.array(place[varies], pa.int32()), pa.array(w, pa.float64())], names=["place", "coefficient"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([slope]), pa.array([curve])], names=["slope", "curve"])

    return run


@dataclass
class SparseLogistic:
    """A fitted model: coefficients of the places seen in training (others are 0) as a table."""

    intercept: float
    coefficients: DataFrame  # place int, coefficient double
    size: int

    def score(self, df: DataFrame, id_col: str, label: str, vector: str = "onehot") -> DataFrame:
        """T9 (id, label, score, prediction): different vectors meet the coefficients by place."""
        rows = df.select(named(id_col).alias("id"), named(label).cast("int").alias("label"), places(vector).alias("_at"))
        rows = cut_lineage(rows)
        entries = rows.select("_at").distinct().select("_at", F.explode_outer("_at").alias("place"))
        margins = entries.join(self.coefficients, "place", "left").groupBy("_at").agg(F.coalesce(F.sum("coefficient"), F.lit(0.0)).alias("_margin"))
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_margin") + F.lit(self.intercept))))
        scored = rows.join(margins, "_at").select("id", "label", score.alias("score"))
        return scored.withColumn("prediction", (F.col("score") > F.lit(0.5)).cast("int"))


def sparse_logistic(train: DataFrame, label: str, vector: str, nested_in: str, size: int, reg: float = 1e-4, rows_per_block: int = ROWS_PER_BLOCK) -> SparseLogistic:
    """L2-penalised logistic regression (``reg`` / 2 on the squares of standardised
    coefficients, mean log loss) over 0/1 vectors of ``size`` places, each of which occurs under
    one value of ``nested_in``; :class:`NotNested` where one does not. Rows without a label are left out."""
    ship(train.sparkSession)
    rows = train.where(named(label).isNotNull()).select(F.xxhash64(named(nested_in)).alias("h"), places(vector).alias("at"), named(label).cast("long").alias("y"))
    equal = cut_lineage(rows.groupBy("h", "at").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")))
    found = equal.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum("ones").alias("ones")).first()
    n, ones = found["n"] or 0, found["ones"] or 0
    empty = train.sparkSession.createDataFrame([], "place int, coefficient double")
    if ones in (0, n):
        # one class: its share is certain without any coefficient, as in Spark ML
        return SparseLogistic(math.inf if ones else -math.inf, empty, size)
    blocks = -(-found["rows"] // rows_per_block)
    keyed = equal.select(F.pmod(F.col("h"), F.lit(blocks)).cast("long").alias("block"), "at", "n", "ones")
    packed = cut_lineage(keyed.groupBy("block").applyInArrow(_pack, _PACKED).repartition(blocks, "block"))
    release(train.sparkSession)
    intercept, low, high = math.log(ones / (n - ones)), -math.inf, math.inf
    for _ in range(50):
        s = packed.mapInArrow(_pass(intercept, float(n), reg, False), "slope double, curve double").agg(F.sum("slope"), F.sum("curve")).first()
        slope, curve = s[0], s[1]
        low, high = (low, intercept) if slope > 0 else (intercept, high)
        moved = intercept - slope / max(curve, 1e-12 * n)
        if not low < moved < high:
            moved = (low + high) / 2 if math.isfinite(low + high) else intercept - math.copysign(1.0, slope)
        # beyond this the loss changes by less than 1e-10 a row
        near = abs(slope) * abs(moved - intercept) <= 1e-10 * n
        intercept = moved
        if near:
            break
    table = cut_lineage(packed.mapInArrow(_pass(intercept, float(n), reg, True), "place int, coefficient double"))
    twice = table.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise NotNested(f"places of {vector} occur under several values of {nested_in}")
    return SparseLogistic(intercept, table, size)
