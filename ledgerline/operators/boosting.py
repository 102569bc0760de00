"""Boosted trees grown level by level from packed rows.

The rule is Spark ML's ``GBTClassifier``: labels -1 and 1, logistic loss, regression trees on
its residuals (variance, leaf means), the first tree whole and the others shrunk. What differs
is how the rows are kept. Spark ML keeps one object per row and writes a copy of all of them for
every tree; with hundreds of trees that copying is most of the time. Here

* each feature value becomes the number of its bin once, and rows travel in packed blocks of
  some thousands, a byte per feature;
* a level of a tree is one job: tasks add up their rows' histograms with numpy, features of few
  bins in one pass, and one small partial sum per task goes to the driver, which picks the splits;
* a row's margin travels with its block and is brought forward every few trees; tasks add what
  the trees since then give. Every ``FRESH`` trees margins are computed again from the blocks, so
  no lineage grows longer.

Blocks are kept by Spark (memory, then disk) and can be computed again from the training rows.
A job of Python tasks takes about 0.1 s more than one of Spark ML, however few the rows, so up to
``SMALL_ROWS`` training rows Spark ML's own learner is fitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, HasStepSize, HasWeightCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import cores, ship

#: bins of a feature, as in Spark ML; at most 256, as a bin is a byte
MAX_BINS = 32
#: rows of a block, and of a partition before more of them are made
BLOCK_ROWS, PARTITION_ROWS = 1 << 16, 1 << 22
#: trees after which margins are computed from the blocks instead of the last margins
FRESH = 48
#: trees between two kept margins while a partition has at most so many rows, else each is kept
KEEP, KEEP_ROWS = 4, 1 << 22
#: cells of the histogram that several features share
SHARED_BINS = 1 << 12
#: training rows up to which Spark ML's learner is the faster one
SMALL_ROWS = 1 << 19
#: partial sums that go to the driver at once; beyond, they are added up by a shuffle first
MAX_PARTIALS = 64

# A tree is (feature, bin, value) arrays in heap order: the children of node i are 2i+1 and
# 2i+2, a row goes left if its bin is at most the node's; feature -1 marks a leaf.


class _Boosting(HasFeaturesCol, HasLabelCol, HasWeightCol, HasMaxIter, HasStepSize, HasSeed):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows that a tree is grown on", TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "'all', or the share of the features tried per node", TypeConverters.toString)


class BoostedTrees(_Boosting, Estimator):
    """Estimator of boosted trees for labels 0 and 1; its settings are named as Spark ML's."""

    @keyword_only
    def __init__(self, *, maxIter: int = 20, maxDepth: int = 5, stepSize: float = 0.1, subsamplingRate: float = 1.0,
                 featureSubsetStrategy: str = "all", seed: int = 0, weightCol: str | None = None):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._setDefault(maxIter=20, maxDepth=5, stepSize=0.1, subsamplingRate=1.0, featureSubsetStrategy="all", seed=0)
        self._set(**given)

    def setFeaturesCol(self, value: str) -> BoostedTrees:
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> BoostedTrees:
        return self._set(labelCol=value)

    def getMaxDepth(self) -> int:
        return self.getOrDefault(self.maxDepth)

    def getSubsamplingRate(self) -> float:
        return self.getOrDefault(self.subsamplingRate)

    def _fit(self, dataset: DataFrame) -> Model:
        if dataset.count() <= SMALL_ROWS:
            small = GBTClassifier()
            return self._copyValues(small, {small.getParam(p.name): v for p, v in self.extractParamMap().items()}).fit(dataset)
        weight = F.col(self.getWeightCol()).cast("double") if self.isSet(self.weightCol) else F.lit(1.0)
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"), weight.alias("w"))
        ship(rows.sparkSession)
        n_rows, thresholds = _thresholds(rows)
        base = _blocks(rows, thresholds, n_rows, self.isSet(self.weightCol)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            trees, gains = _grow_all(base, self, [len(t) + 1 for t in thresholds], n_rows)
        finally:
            base.unpersist()
        return self._copyValues(BoostedModel(thresholds, trees, self.getStepSize(), gains))


class BoostedModel(_Boosting, Model):
    """Margins, probabilities and predictions as Spark ML's model has them."""

    def __init__(self, thresholds: list[np.ndarray], trees: list, step: float, gains: np.ndarray):
        super().__init__()
        self.thresholds, self.trees, self.step = thresholds, trees, step
        self.featureImportances = DenseVector(gains)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        thresholds, trees, step = self.thresholds, self.trees, self.step

        @F.pandas_udf("double")
        def margin(x):
            import pandas as pd

            return pd.Series(_margins(_binned(np.vstack(x.to_numpy()), thresholds), trees, 0, step, np.zeros(len(x)))) if len(x) else pd.Series([], dtype=float)

        m = F.col("_margin")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m))
        out = dataset.withColumn("_margin", margin(vector_to_array(self.getFeaturesCol())))
        out = out.withColumn("rawPrediction", array_to_vector(F.array(-m, m))).withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
        return out.withColumn("prediction", (p > F.lit(0.5)).cast("double")).drop("_margin")


# ------------------------------------------------------------------- bins
def _few_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The finite values of each feature, at most one more than there are bins."""
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        x = _matrix(batch)
        for f in range(x.shape[1]):
            have = seen.get(f, np.empty(0))
            if len(have) <= MAX_BINS:
                v = np.unique(x[:, f])
                seen[f] = np.union1d(have, v[np.isfinite(v)])[: MAX_BINS + 1]
    for f, values in seen.items():
        yield pa.RecordBatch.from_pydict({"f": np.full(len(values), f, dtype=np.int32), "v": values})


def _thresholds(rows: DataFrame) -> tuple[int, list[np.ndarray]]:
    """The number of rows, and the ascending split values of every feature: midway between its
    values if it has no more than ``MAX_BINS`` of them, else its quantiles over all rows."""
    head = rows.select(F.size("x").alias("n")).first()
    width = head["n"] if head else 0
    few = rows.select("x").mapInArrow(_few_values, "f int, v double").groupBy("f").agg(F.sort_array(F.slice(F.collect_set("v"), 1, MAX_BINS + 1)).alias("v"))
    values = {r["f"]: np.array(r["v"]) for r in few.collect()}
    many = [f for f in range(width) if len(values.get(f, ())) > MAX_BINS]
    shares = [i / MAX_BINS for i in range(1, MAX_BINS)]
    finite = lambda f: F.when(F.abs(F.col("x")[f]) < F.lit(float("inf")), F.col("x")[f])
    stats = rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(finite(f), shares, 10_000).alias(f"q{f}") for f in many]).first()
    cuts = [np.unique(np.array(stats[f"q{f}"])) if f in many else (values[f][1:] + values[f][:-1]) / 2 if f in values else np.empty(0) for f in range(width)]
    return stats["n"], cuts


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _binned(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """Bins by feature and row."""
    return np.array([np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(thresholds)], dtype=np.uint8).reshape(len(thresholds), len(x))


def _pack(batches: Iterator[pa.RecordBatch], thresholds: list[np.ndarray], size: int, weighted: bool) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        bins, y, w = (np.concatenate(parts, axis=-1) for parts in zip(*held))
        held.clear()
        return pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "y": [y.tobytes()], "w": [w.tobytes() if weighted else b""]})

    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            x, y, w = _matrix(part), part.column("y").to_numpy(zero_copy_only=False), part.column("w").to_numpy(zero_copy_only=False)
            if not (np.isfinite(x).all() and np.isin(y, (0.0, 1.0)).all() and (w >= 0.0).all()):
                raise ValueError("training rows need finite features, labels 0 or 1, and weights of at least 0 (as Spark ML's learner does)")
            held.append((_binned(x, thresholds), y.astype(np.uint8), w))
            if sum(len(h[1]) for h in held) >= size:
                yield block()
    if held:
        yield block()


def _blocks(rows: DataFrame, thresholds: list[np.ndarray], n_rows: int, weighted: bool):
    """(number, bins, labels, weights) of blocks of rows, dealt evenly over the cores."""
    at_once = cores(rows.sparkSession)
    parts = at_once * max(1, math.ceil(n_rows / (at_once * PARTITION_ROWS)))
    size = min(BLOCK_ROWS, max(1024, n_rows // (8 * parts)))
    packed = rows.mapInArrow(partial(_pack, thresholds=thresholds, size=size, weighted=weighted), "bins binary, y binary, w binary")
    return packed.repartition(parts).rdd.mapPartitionsWithIndex(_numbered)


def _numbered(part: int, blocks):
    for i, (bins, y, w) in enumerate(blocks):
        yield (part, i), bytes(bins), bytes(y), bytes(w)


# ---------------------------------------------------------------- growing
def _lower(bins: np.ndarray, tree, level: int, at: np.ndarray) -> np.ndarray:
    """Places of the rows in the level below ``level``; in a leaf they go left."""
    first, right = (1 << level) - 1, np.zeros(len(at), bool)
    for i in range(1 << level):
        f = tree[0][first + i]
        if f >= 0:
            beyond = bins[f] > tree[1][first + i]
            right |= (at == i) & beyond if level else beyond
    return at * at.dtype.type(2) + right


def _places(bins: np.ndarray, tree, depth: int) -> np.ndarray:
    """Places of the rows in level ``depth`` of a tree."""
    at = np.zeros(bins.shape[1], np.uint8 if depth <= 8 else np.uint32)
    for level in range(depth):
        at = _lower(bins, tree, level, at)
    return at


def _lowest(tree) -> np.ndarray:
    """Values by place in the lowest level, to which rows of a leaf above have gone left."""
    feature, value = tree[0], tree[2].copy()
    for node in np.flatnonzero(feature[: len(value) // 2] < 0).tolist():
        value[2 * node + 1] = value[node]
    return value[len(value) // 2 :]


def _margins(bins: np.ndarray, trees: list, first: int, step: float, margin: np.ndarray) -> np.ndarray:
    """``margin`` with ``trees`` added, whose numbers begin at ``first``; tree 0 is not shrunk."""
    for i, tree in enumerate(trees, first):
        depth = (len(tree[0]) + 1).bit_length() - 2
        margin = margin + ((1.0 if i == 0 else step) * _lowest(tree)).take(_places(bins, tree, depth))
    return margin


def _forward(blocks, trees: list, first: int, step: float):
    """Blocks with their margins brought forward by ``trees``."""
    for number, bins, y, w, *margin in blocks:
        n = len(y)
        old = np.frombuffer(margin[0]) if margin else np.zeros(n)
        yield number, bins, y, w, _margins(np.frombuffer(bins, np.uint8).reshape(-1, n), trees, first, step, old).tobytes()


def _shared(widths: list[int]) -> list[list[int]]:
    """Features that share a histogram: the product of their bins is bounded."""
    groups: list[list[int]] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        group = next((g for g in groups if math.prod(widths[i] for i in g) * widths[f] <= SHARED_BINS), None)
        if group is None:
            groups.append([f])
        else:
            group.append(f)
    return groups


def _histograms(blocks, tree, level: int, round_: int, widths: list[int], rate: float, seed: int, trees: list, first_tree: int, step: float):
    """Weights and weighted residuals of the rows by node of ``level`` and bin, summed over a
    partition; ``trees`` are those that the blocks' margins lack."""
    groups, starts = _shared(widths), np.cumsum([0, *widths])
    shapes = [[widths[f] for f in group] for group in groups]
    sums = [np.zeros((2, math.prod(shape) << level)) for shape in shapes]
    for number, bins, y, w, *margin in blocks:
        n = len(y)
        bins = np.frombuffer(bins, np.uint8).reshape(-1, n)
        margin = _margins(bins, trees, first_tree, step, np.frombuffer(margin[0]) if margin else np.zeros(n))
        sign, weight = np.frombuffer(y, np.uint8) * 2.0 - 1.0, np.frombuffer(w) if w else None
        at = _places(bins, tree, level)
        if rate < 1.0:
            drawn = np.flatnonzero(np.random.default_rng([seed, round_, *number]).random(n) < rate)
            sign, margin, at = sign.take(drawn), margin.take(drawn), at.take(drawn)
            weight = weight.take(drawn) if w else None
        target = sign if round_ == 0 else 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * margin, 700.0)))
        value, at = target * weight if w else target, at.astype(np.intp)
        for group, shape, sum_ in zip(groups, shapes, sums, strict=True):
            code = np.zeros(n, np.uint16)
            for f in group:
                code = code * np.uint16(widths[f]) + bins[f]
            place = (code.take(drawn) if rate < 1.0 else code).astype(np.intp)
            if level:
                place += at * math.prod(shape)
            sum_[0] += np.bincount(place, weight, sum_.shape[1])
            sum_[1] += np.bincount(place, value, sum_.shape[1])
    out = np.zeros((2, 1 << level, starts[-1]))
    for group, shape, sum_ in zip(groups, shapes, sums, strict=True):
        sum_ = sum_.reshape(2, 1 << level, *shape)
        for i, f in enumerate(group):
            out[:, :, starts[f] : starts[f + 1]] = sum_.sum(axis=tuple(2 + j for j in range(len(group)) if j != i))
    yield out.reshape(2, -1)


def _added(state, fn, parts: int) -> np.ndarray:
    partial_sums = state.mapPartitions(fn)
    return partial_sums.reduce(np.add) if parts <= MAX_PARTIALS else partial_sums.treeReduce(np.add, depth=2)


def _split(sums: np.ndarray, widths: list[int], tried: np.ndarray):
    """The best split of a node by variance: (gain, feature, bin, left and right mean), or none."""
    best, start = None, 0
    for f, width in enumerate(widths):
        w, s = sums[0, start:start + width], sums[1, start:start + width]
        start += width
        if width < 2 or f not in tried:
            continue
        wl, sl = np.cumsum(w)[:-1], np.cumsum(s)[:-1]
        wr, sr = w.sum() - wl, s.sum() - sl
        fits = (np.cumsum(w != 0)[:-1] > 0) & (np.cumsum((w != 0)[::-1])[::-1][1:] > 0)
        if not fits.any():
            continue
        with np.errstate(all="ignore"):
            gain = np.where(fits, sl * sl / wl + sr * sr / wr - s.sum() ** 2 / w.sum(), -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > 1e-12 * w.sum() and (best is None or gain[b] > best[0]):
            best = float(gain[b]), f, b, sl[b] / wl[b], sr[b] / wr[b]
    return best


def _grow_all(base, settings: BoostedTrees, widths: list[int], n_rows: int):
    rounds, depth, step = settings.getMaxIter(), settings.getMaxDepth(), settings.getStepSize()
    rate, seed, strategy = settings.getSubsamplingRate(), settings.getSeed(), settings.getOrDefault(settings.featureSubsetStrategy)
    n_tried = len(widths) if strategy == "all" else max(1, math.ceil(float(strategy) * len(widths)))
    parts = base.getNumPartitions()
    trees: list = []
    gains = np.zeros(len(widths))
    state, kept, since = base, None, 0  # margins of ``state`` have the trees before ``since``
    keep = KEEP if n_rows <= parts * KEEP_ROWS else 1
    for round_ in range(rounds):
        last = None
        if round_ and round_ % keep == 0:
            whole = round_ % FRESH == 0
            since, last = (0, kept) if whole else (since, kept)
            forward = partial(_forward, trees=trees[since:], first=since, step=step)
            state = kept = (base if whole else state).mapPartitions(forward).persist(StorageLevel.MEMORY_AND_DISK)
            since = round_
        tree, gain = (np.full((2 << depth) - 1, -1), np.zeros((2 << depth) - 1, dtype=np.intp), np.zeros((2 << depth) - 1)), np.zeros(len(widths))
        rng = np.random.default_rng([seed, round_])
        for level in range(depth):
            fn = partial(_histograms, tree=tree, level=level, round_=round_, widths=widths, rate=rate, seed=seed, trees=trees[since:], first_tree=since, step=step)
            sums = _added(state, fn, parts).reshape(2, 1 << level, -1)
            if level == 0:
                if last is not None:
                    last.unpersist()
                if widths:
                    w, s = sums[:, 0, :widths[0]].sum(axis=1)
                    tree[2][0] = s / w if w else 0.0
            grown = False
            for i in range(1 << level):
                node = (1 << level) - 1 + i
                tried = rng.permutation(len(widths))[:n_tried]
                best = _split(sums[:, i], widths, tried) if level == 0 or tree[0][(node - 1) // 2] >= 0 else None
                if best is None:
                    continue
                grown = True
                gain[best[1]] += best[0]
                tree[0][node], tree[1][node] = best[1], best[2]
                tree[2][2 * node + 1], tree[2][2 * node + 2] = best[3], best[4]
            if not grown:
                break
        trees.append(tree)
        gains += gain
    if kept is not None:
        kept.unpersist()
    return trees, gains / gains.sum() if gains.sum() else gains
