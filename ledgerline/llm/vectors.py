"""Embedding near-duplicates by collision counting over sorted projections.

Vectors of one label are projected on many random directions. A pair whose
cosine reaches the threshold lies within a small window of each other on most
directions; other pairs do on few. Per direction the projections are sorted, and
every vector's window centred on it gives its collisions; pairs that collide on
a calibrated number of directions are verified by their cosine in double
precision.

Equal vectors are one class. Classes of a label are dealt into slabs along the
first direction, a bounded number in each; a task compares two slabs, and only
slabs that the window's outer bound lets meet are compared. Tasks return counts
per vector and a spanning forest of their links, never pairs of all members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import graph
from ledgerline.llm.common import Workspace

#: directions, classes per slab at most about, and the window in deviations of a linked pair
DIRECTIONS, SLAB, WINDOW = 64, 1024, 1.0
#: probability that a pair at the threshold collides on too few directions
MISS = 1e-9


def directions(dim: int) -> np.ndarray:
    """(dim, DIRECTIONS) unit vectors, the same in every task."""
    x = np.random.default_rng(20240611).standard_normal((dim, DIRECTIONS))
    return x / np.linalg.norm(x, axis=0)


def calibration(dim: int, threshold: float) -> tuple[float, int, float]:
    """(window, collisions, outer bound) for unit vectors of ``dim`` components.

    A linked pair differs by at most sqrt(2 - 2 threshold), so on a random direction by a
    nearly normal amount of known deviation; the needed collisions are the binomial
    quantile that a pair at the threshold misses with probability ``MISS``. The bound holds
    for every pair on every direction."""
    most = math.sqrt(max(0.0, 2 - 2 * threshold))
    deviation = most / math.sqrt(dim)
    # in few dimensions projections are far from normal: all directions within the bound
    if dim < 16:
        return most + 1e-9, DIRECTIONS, most + 1e-9
    p = math.erf(WINDOW / math.sqrt(2)) * 0.95
    need, below = 0, 0.0
    for k in range(DIRECTIONS):
        below += math.comb(DIRECTIONS, k) * p**k * (1 - p) ** (DIRECTIONS - k)
        if below > MISS:
            break
        need = k + 1
    return WINDOW * deviation + 1e-9, need, most + 1e-9


def _unit(raw: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(len(raw), dim)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


VALID_SCHEMA = "vec_id long, label long, dim int, raw binary, first double"


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row; those with an id, a label and a finite vector that is not zero with its components
    as doubles (null in the others) and its first projection."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("raw", pa.binary()), ("first", pa.float64())])
    for batch in batches:
        ids, labels, vectors = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")
        out = []
        for i, label, v in zip(ids, labels, vectors, strict=True):
            v = v.values
            out.append({"vec_id": i, "label": label})
            if i is None or label is None or v is None or not len(v) or v.null_count:
                continue
            x = v.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zeros
            norm = np.linalg.norm(x)
            if np.isfinite(x).all() and norm > 0 and np.isfinite(norm):
                out[-1] |= {"dim": len(x), "raw": x.tobytes(), "first": float(x @ directions_of(len(x))[:, 0] / norm)}
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_cached: dict[int, np.ndarray] = {}


def directions_of(dim: int) -> np.ndarray:
    if dim not in _cached:
        _cached[dim] = directions(dim)
    return _cached[dim]


SLAB_SCHEMA = "label long, dim int, slab long, low double, high double, ids binary, copies binary, rows binary"


def _pack_slab(table: pa.Table) -> pa.Table:
    return pa.table({
        "label": table.column("label")[:1], "dim": table.column("dim")[:1], "slab": table.column("slab")[:1],
        "low": pa.array([min(table.column("first").to_pylist())]), "high": pa.array([max(table.column("first").to_pylist())]),
        "ids": pa.array([table.column("node").to_numpy().astype(np.int64).tobytes()], pa.binary()),
        "copies": pa.array([table.column("copies").to_numpy().astype(np.int64).tobytes()], pa.binary()),
        "rows": pa.array([b"".join(table.column("raw").to_pylist())], pa.binary()),
    })


def candidates(p: np.ndarray, q: np.ndarray, window: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of p, row of q) that collide on at least ``need`` directions: per direction the
    sorted projections of q, and the window centred on each of p."""
    count = np.zeros(len(p) * len(q), np.uint8)
    row = np.arange(len(p)) * len(q)
    for d in range(p.shape[1]):
        order = np.argsort(q[:, d], kind="stable")
        line = q[order, d]
        low = np.searchsorted(line, p[:, d] - window, "left")
        size = np.searchsorted(line, p[:, d] + window, "right") - low
        total = int(size.sum())
        at = np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)
        count[np.repeat(row, size) + order[at]] += 1  # a pair occurs once per direction
    hit = np.flatnonzero(count >= need)
    return hit // len(q), hit % len(q)


LINK_SCHEMA = "a long, b long, links long"


def _compare(threshold: float):
    """Two slabs: per vector its links (``b`` null), and a spanning forest of them."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                x, y = (np.frombuffer(r[k], np.float64).reshape(-1, dim) for k in ("rows_a", "rows_b"))
                nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                window, need, _ = calibration(dim, threshold)
                i, j = candidates(x / nx[:, None] @ directions_of(dim), y / ny[:, None] @ directions_of(dim), window, need)
                same = r["slab_a"] == r["slab_b"]
                if same:
                    i, j = i[i < j], j[i < j]
                good = np.zeros(len(i), bool)
                for s in range(0, len(i), 100_000):
                    a, b = i[s : s + 100_000], j[s : s + 100_000]
                    good[s : s + 100_000] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
                i, j = i[good], j[good]
                ids_a, ids_b, n_a, n_b = (np.frombuffer(r[k], np.int64) for k in ("ids_a", "ids_b", "copies_a", "copies_b"))
                node, other = graph.forest(ids_a[i].tolist(), ids_b[j].tolist())
                links_a = np.bincount(i, n_b[j], len(x)).astype(np.int64)
                links_b = np.bincount(j, n_a[i], len(y)).astype(np.int64)
                some_a, some_b = links_a > 0, links_b > 0
                a = np.concatenate([ids_a[some_a], ids_b[some_b], np.array(node, np.int64)])
                b = pa.array([None] * int(some_a.sum() + some_b.sum()) + other, pa.int64())
                n = np.concatenate([links_a[some_a], links_b[some_b], np.zeros(len(node), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "links"])

    return run_


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    Vectors are compared when their labels are equal and not null and their lengths agree.
    Null, empty, zero vectors and those with null or non-finite components link with
    nothing; so do rows without an id. Rows that repeat an id count as vectors of their own
    and share a component."""
    work = Workspace(embeddings.sparkSession, "vectors")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    every = work.save(rows.mapInArrow(_valid, VALID_SCHEMA), "valid")
    valid = every.filter("raw is not null")
    classes = work.save(
        valid.groupBy("label", "dim", "raw").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("first").alias("first")), "classes"
    )
    # slabs of equal numbers: quantiles of the first projection per label, a bounded number of cuts each
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("first", [i / 1000 for i in range(1, 1000)], 10_000).alias("q"))
    sizes = sizes.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.least(F.ceil(F.col("n") / SLAB), F.lit(1000)).cast("int").alias("slabs"), F.ceil(F.col("n") / (1000 * SLAB)).cast("int").alias("parts"), "q")
    cut = classes.join(F.broadcast(sizes) if sizes.count() <= 1000 else sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    rank = F.size(F.filter("q", lambda x: x < F.col("first")))
    # beyond a thousand slabs, each is dealt into parts by id
    slab = F.floor(rank * F.col("slabs") / 1000) * F.col("parts") + F.pmod(F.xxhash64("node"), F.col("parts"))
    slabs = work.save(
        cut.withColumn("slab", slab.cast("long")).select("label", "dim", "slab", "node", "copies", "raw", "first").groupBy("label", "dim", "slab").applyInArrow(_pack_slab, SLAB_SCHEMA), "slabs"
    )
    names = slabs.select("label", "dim", "slab", "low", "high")
    a = names.select(*[F.col(c).alias(f"{c}_a") for c in names.columns])
    b = names.select(*[F.col(c).alias(f"{c}_b") for c in names.columns])
    bound = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    meet = a.join(b, (F.col("label_a") == F.col("label_b")) & (F.col("dim_a") == F.col("dim_b")) & (F.col("slab_a") <= F.col("slab_b")))
    meet = meet.filter((F.col("low_a") <= F.col("high_b") + bound) & (F.col("low_b") <= F.col("high_a") + bound)).select(F.col("label_a").alias("label"), F.col("dim_a").alias("dim"), "slab_a", "slab_b")
    side = lambda s: slabs.select("label", "dim", F.col("slab").alias(f"slab_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "rows")])
    pairs = meet.join(side("a"), ["label", "dim", "slab_a"]).join(side("b"), ["label", "dim", "slab_b"])
    found = work.save(pairs.repartition(max(64, embeddings.sparkSession.sparkContext.defaultParallelism), "label", "slab_a", "slab_b").mapInArrow(_compare(threshold), LINK_SCHEMA), "found")
    component = graph.components(found.filter("b is not null").select("a", "b"), work, "links")
    links = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, F.col("node") == F.col("a"), "left").select("label", "dim", "raw", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of_class = of_class.join(component, "node", "left").select("label", "dim", "raw", "n_links", F.coalesce("component", "node").alias("component_id"))
    linked = valid.join(of_class, ["label", "dim", "raw"]).select("vec_id", "label", "n_links", "component_id")
    # a row that links with nothing shares the component of its id's other rows
    of_id = linked.groupBy("vec_id").agg(F.min("component_id").alias("component_id"))
    rest = every.filter("raw is null").select("vec_id").join(of_id, "vec_id", "left").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
