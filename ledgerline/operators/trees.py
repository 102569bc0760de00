"""Forests of full depth and exact bags, grown by Spark tasks.

A tree of full depth has about as many leaves as it has training rows, so a forest grows
with the data and cannot live on the driver. Here it never does:

* Every training row is dealt to the trees that draw it; rows of one tree and one *root*
  meet in one task, which grows that part of the tree to the end with numpy, all nodes of
  a level together. Rows travel as packed blocks, not one by one. Equal rows, which a bootstrap
  makes, are one row with their weights; a level is split by sorting one number per row and
  drawn feature, a cache's worth of neighbouring nodes at a time (:func:`grow`).
* While a tree's rows are more than ``max_rows``, its top is split first: histograms of
  the open nodes (partial sums in the tasks, added up by a shuffle) give the best split
  of each, level by level, until every open node fits a task. Those nodes are the roots.
* The nodes of such a forest are more than its rows, so they are written only where asked
  for (:attr:`Forest.nodes`). Importances and scores grow the trees a few at a time and keep
  what they need of them: gains by feature, or the values of the test rows that meet the
  training rows by (tree, root), or both. The rows dealt at a time are bounded in bytes.

Split rules are the scripts' library's: Gini impurity, 32-bit feature values, thresholds
midway between neighbouring values, ``max_features`` features drawn per node, more only
while those drawn are constant, growth until a node is pure or cannot be split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cores, cut_lineage, release, ship

#: rows of one tree that one task grows
MAX_ROWS = 1 << 20
#: bins of a feature in the histograms of nodes above that size
BINS = 64
#: bytes of training rows dealt to trees at a time
DEALT_BYTES = 2 << 30
#: bytes of histograms that one task holds
HISTOGRAM_BYTES = 64 << 20
#: rows that a task packs, deals or bins together, and bytes of dealt rows in one batch
BLOCK_ROWS, BATCH_BYTES = 1 << 16, 16 << 20
#: rows of neighbouring nodes that are split together: their arrays fit a core's cache
PART_ROWS = 1 << 15
#: different pairs of weights up to which equal rows are one
MOST_PAIRS = 1 << 12
#: rows that a task of a forest grows at least, where there are so many
TASK_ROWS = 1 << 17

_VALUE = "tree int, place long, value double"
_NODE = "tree int, root int, node int, feature int, threshold float, left int, value double, gain double, weight double"
_BLOCK = "tree int, root int, rows binary"
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of a counter-based generator."""
    x = (x + _U(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(*parts) -> np.ndarray:
    """Uniform numbers in [0, 1) that depend on ``parts`` alone."""
    h = np.zeros((), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = _mix(h ^ np.asarray(p).astype(np.int64).view(np.uint64))
    return (h >> _U(11)).astype(np.float64) * 2.0**-53


#: 53-bit numbers from which a row is drawn once, twice, ... (sums of the Poisson law)
_POISSON = np.array([math.ceil(c * 2.0**53) for c in np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])], np.uint64)


def _poisson(seed: int, tree: int, key: np.ndarray) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1, which n draws with replacement
    from n rows tend to; a function of the row's key, so any task finds the same."""
    with np.errstate(over="ignore"):
        h = _mix(_mix(_mix(np.asarray(seed).astype(np.int64).view(np.uint64)) ^ np.asarray(tree).astype(np.int64).view(np.uint64)) ^ key.view(np.uint64)) >> _U(11)
    n = np.zeros(len(h), np.uint8)
    for least in _POISSON[:3]:
        n += h >= least
    often = np.flatnonzero(n == 3)
    n[often] += np.searchsorted(_POISSON[3:], h[often], "right").astype(np.uint8)
    return n


# ------------------------------------------------------------------- growing
@dataclass
class Tree:
    feature: np.ndarray  # -1: a leaf
    threshold: np.ndarray
    left: np.ndarray  # the right child is left + 1
    value: np.ndarray  # share of class 1
    gain: np.ndarray  # impurity decrease times weight
    weight: np.ndarray


def _purity(w1: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight times (1 - Gini impurity)."""
    w0 = w - w1
    return (w1 * w1 + w0 * w0) / np.maximum(w, 1e-300)


def _midway(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A threshold t with a <= t < b."""
    with np.errstate(invalid="ignore", over="ignore"):
        t = (a.astype(np.float64) * 0.5 + b.astype(np.float64) * 0.5).astype(np.float32)
        return np.where((t >= a) & (t < b), t, a)


def _codes(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values (NaN last)."""
    bits = (x + np.float32(0)).view(np.uint32)  # -0.0 is 0.0
    bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))
    bits[np.isnan(x)] = 0xFFFFFFFF
    return bits


def _decoded(codes: np.ndarray) -> np.ndarray:
    return np.where(codes >> 31, codes & np.uint32(0x7FFFFFFF), ~codes).view(np.float32)


# the weight of some rows, and that of class 1 among them, in one whole number: sums are exact
_HALF, _LOW = np.int64(31), np.int64((1 << 31) - 1)


def _both(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (sums & _LOW).astype(np.float64), (sums >> _HALF).astype(np.float64)


def _merged(codes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one with their weights added up (some may stay apart, which changes no tree)."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
    order = np.argsort(h)
    c = codes.take(order, 0)
    other = np.zeros(len(c) - 1, bool)
    for k in range(c.shape[1]):
        other |= c[1:, k] != c[:-1, k]
    first = np.flatnonzero(np.r_[True, other])
    return c.take(first, 0), np.add.reduceat(sums.take(order), first)


@dataclass
class _Part:
    """Rows of the open nodes among some neighbouring nodes of a level."""

    codes: np.ndarray  # by row and feature, one after the other
    row: np.ndarray  # where a row's codes begin
    pair: np.ndarray  # the number of its pair of weights
    node: np.ndarray  # its place among the open nodes
    sums: np.ndarray  # weights of all nodes
    open: np.ndarray  # which of them are open


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, max_features: int, seed: tuple[int, ...]) -> Tree:
    """One tree of full depth on rows ``x`` (float32), labels 0/1 and weights, whole and positive.

    A row and a drawn feature are one number, of the node, the value and the pair of weights. They
    are sorted, and running sums over them are the weights left of every cut of every node."""
    f = x.shape[1]
    codes, sums = _codes(x), w.astype(np.int64) + ((w * y).astype(np.int64) << _HALF)
    if len(x):
        merged = _merged(codes, sums)
        if len(np.unique(merged[1])) <= MOST_PAIRS:
            codes, sums = merged
    pairs, pair = np.unique(sums, return_inverse=True)
    total = sums.sum(keepdims=True)
    opened = np.flatnonzero((total >> _HALF > 0) & (total >> _HALF < (total & _LOW)) & (len(codes) > 1))
    level = [_Part(codes.ravel(), np.arange(len(codes)) * f, pair.astype(np.uint64), np.zeros(len(codes), np.int64), total, opened)]
    done, out = 0, []
    while level:
        width, at, splits, below = sum(len(p.sums) for p in level), 0, 0, []
        for p in level:
            feature, threshold, gain, children = _split(p, f, max_features, (*seed, done), at, pairs)
            split = feature >= 0
            left = np.full(len(split), -1, np.int32)
            left[split] = done + width + 2 * (splits + np.arange(int(split.sum())))
            weight, ones = _both(p.sums)
            out.append([feature, threshold, left, ones / np.maximum(weight, 1e-300), gain, weight])
            at, splits = at + len(split), splits + int(split.sum())
            for c in children:
                if below and len(below[-1].row) + len(c.row) <= PART_ROWS:
                    below[-1] = _joined(below[-1], c)
                else:
                    below.append(c)
        done, level = done + width, below
    return Tree(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _joined(a: _Part, b: _Part) -> _Part:
    moved = [(a.codes, b.codes), (a.row, b.row + len(a.codes)), (a.pair, b.pair), (a.node, b.node + len(a.open)), (a.sums, b.sums), (a.open, b.open + len(a.sums))]
    return _Part(*map(np.concatenate, moved))


def _best_cuts(key: np.ndarray, bits: int, pairs: np.ndarray, sums: np.ndarray):
    """The best cut of each segment of sorted rows: segments, scores, the values on both sides and
    the weights to the left; the first one where several are best. A key is the segment, 32 bits of
    the value and ``bits`` of the pair of weights."""
    key.sort()
    value = key >> _U(bits)
    segment = value >> _U(32)
    # only the last row of a run of equal values can be a cut
    cut = np.flatnonzero((value[1:] != value[:-1]) & (segment[1:] == segment[:-1]))
    if not len(cut):
        return None
    segment = segment.view(np.int64).take(cut)
    left = np.cumsum(pairs.take((key & _U((1 << bits) - 1)).view(np.int64))).take(cut)
    left -= (np.cumsum(sums) - sums).take(segment)
    (wl, w1), (total, ones) = _both(left), (s.take(segment) for s in _both(sums))
    score = _purity(w1, wl) + _purity(ones - w1, total - wl)
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    top = np.maximum.reduceat(score, first)
    hit = np.flatnonzero(score == np.repeat(top, np.diff(np.r_[first, len(segment)])))
    at = segment[hit]
    hit = hit[np.r_[True, at[1:] != at[:-1]]]
    at = cut[hit]
    return segment[hit], score[hit], value[at].astype(np.uint32), value[at + 1].astype(np.uint32), left[hit]


def _split(p: _Part, f: int, max_features: int, seed: tuple[int, ...], at: int, pairs: np.ndarray):
    """Split the open nodes of a part whose nodes begin at place ``at`` of the level: feature,
    threshold and gain of all its nodes, and the parts of their children."""
    m, bits = len(p.open), max(1, (len(pairs) - 1).bit_length())
    feature, threshold, gain = np.full(len(p.sums), -1, np.int32), np.zeros(len(p.sums), np.float32), np.zeros(len(p.sums))
    if not m:
        return feature, threshold, gain, []
    sums = p.sums[p.open]
    drawn = np.argsort(_uniform(*seed, (at + p.open)[:, None], np.arange(f)[None, :]), axis=1)
    best, chosen = np.full(m, -1.0), np.full(m, -1)
    low, high, left = np.zeros(m, np.uint32), np.zeros(m, np.uint32), np.zeros(m, np.int64)
    most = max(1, min(max_features, (1 << 32 - bits) // m, (2 << 20) // len(p.row)))
    k = 0
    while k < f:
        if k < max_features:
            nodes, n_drawn, node, row, pair = np.arange(m), min(most, max_features - k, f - k), p.node, p.row, p.pair
        else:
            # further features only for nodes whose drawn ones are constant
            nodes, n_drawn = np.flatnonzero(chosen < 0), 1
            if not len(nodes):
                break
            rank = np.full(m, -1)
            rank[nodes] = np.arange(len(nodes))
            node = rank.take(p.node)
            rows = np.flatnonzero(node >= 0)
            node, row, pair = node.take(rows), p.row.take(rows), p.pair.take(rows)
        base = ((node * n_drawn).view(np.uint64) << _U(bits + 32)) | pair
        key = np.empty(n_drawn * len(row), np.uint64)
        for j in range(n_drawn):
            of = p.codes.take(row + drawn[nodes, k + j].take(node)).astype(np.uint64)
            of <<= _U(bits)
            of |= base
            np.add(of, _U(j) << _U(bits + 32), out=key[j * len(row) : (j + 1) * len(row)])
        found = _best_cuts(key, bits, pairs, np.repeat(sums[nodes], n_drawn))
        if found is not None:
            segment, score, a, b, weights = found
            scores, place = np.full(len(nodes) * n_drawn, -1.0), np.zeros(len(nodes) * n_drawn, np.int64)
            scores[segment], place[segment] = score, np.arange(len(segment))
            j = scores.reshape(-1, n_drawn).argmax(1)
            here = np.arange(len(nodes)) * n_drawn + j
            better = np.flatnonzero(scores[here] > best[nodes])
            spot, i = nodes[better], place[here[better]]
            best[spot], low[spot], high[spot], left[spot], chosen[spot] = score[i], a[i], b[i], weights[i], drawn[spot, k + j[better]]
        k += n_drawn
    split = np.flatnonzero(chosen >= 0)
    if not len(split):
        return feature, threshold, gain, []
    at = p.open[split]
    feature[at], threshold[at] = chosen[split], _midway(_decoded(low[split]), _decoded(high[split]))
    total, ones = _both(sums[split])
    gain[at] = np.maximum(best[split] - _purity(ones, total), 0.0)
    below = np.stack([left[split], sums[split] - left[split]], 1).ravel()
    # rows of nodes without a split go to one more child, which is dropped
    first = np.full(m, len(below))
    first[split] = 2 * np.arange(len(split))
    child = first.take(p.node)
    child += p.codes.take(p.row + np.maximum(chosen, 0).take(p.node)) > low.take(p.node)
    size = np.bincount(child, minlength=len(below) + 2)[: len(below)]
    opened = np.flatnonzero((size > 1) & (below >> _HALF > 0) & (below >> _HALF < (below & _LOW)))
    rank = np.full(len(below) + 2, -1)
    rank[opened] = np.arange(len(opened))
    node = rank.take(child)
    keep = np.flatnonzero(node >= 0)
    node, row, pair = node.take(keep), p.row.take(keep), p.pair.take(keep)
    if len(keep) > 2 * PART_ROWS and len(opened) > 1:
        return feature, threshold, gain, _cut_up(_Part(p.codes, row, pair, node, below, opened), size[opened], f)
    codes = p.codes
    if len(keep) * f < 0.6 * len(codes):
        codes, row = codes.reshape(-1, f).take(row // f, 0).ravel(), np.arange(len(keep)) * f
    return feature, threshold, gain, [_Part(codes, row, pair, node, below, opened)]


def _cut_up(p: _Part, size: np.ndarray, f: int) -> list[_Part]:
    """A part as several of about ``PART_ROWS`` rows, or one open node, each."""
    piece = (np.cumsum(size) - size) // PART_ROWS
    begin = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    number = np.cumsum(np.r_[False, piece[1:] != piece[:-1]])
    order = np.argsort(number.astype(np.uint16).take(p.node), kind="stable")
    ends = np.cumsum(np.add.reduceat(size, begin)).tolist()
    # all nodes up to the first open one of the next piece
    nodes = [0, *p.open[begin[1:]].tolist(), len(p.sums)]
    opened = [*begin.tolist(), len(p.open)]
    codes, out, start = p.codes.reshape(-1, f), [], 0
    for i, end in enumerate(ends):
        rows = order[start:end]
        out.append(_Part(
            codes.take(p.row.take(rows) // f, 0).ravel(), np.arange(end - start) * f, p.pair.take(rows), p.node.take(rows) - opened[i],
            p.sums[nodes[i] : nodes[i + 1]], p.open[opened[i] : opened[i + 1]] - nodes[i],
        ))
        start = end
    return out


def leaf_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row of ``x`` falls into."""
    out = np.zeros(len(x), np.int64)
    for start in range(0, len(x) if tree.feature[0] >= 0 else 0, PART_ROWS):
        values = np.ascontiguousarray(x[start : start + PART_ROWS])
        row, at = np.arange(len(values)), np.zeros(len(values), np.int64)
        values, width = values.ravel(), x.shape[1]
        while len(row):
            left = values.take(row * width + tree.feature.take(at)) <= tree.threshold.take(at)
            at = tree.left.take(at) + ~left
            ended = tree.feature.take(at) < 0
            out[start + row[ended]] = at[ended]
            row, at = row[~ended], at[~ended]
    return tree.value[out]


# -------------------------------------------------------------------- blocks
def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of equally long float arrays as a matrix; missing values are NaN."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.float32)


def _packed(x: np.ndarray, *columns: np.ndarray) -> bytes:
    """Rows as bytes: their number, then each column, then the matrix."""
    return b"".join([np.int64(len(x)).tobytes(), *(c.tobytes() for c in columns), x.tobytes()])


def _unpacked(blocks: Sequence, n_features: int, *types) -> list[np.ndarray]:
    """The columns of several packed blocks, the matrix last."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(types) + 1)]
    for b in blocks:
        n, at = int(np.frombuffer(b, np.int64, 1)[0]), 8
        for i, t in enumerate(types):
            out[i].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
        out[-1].append(np.frombuffer(b, np.float32, n * n_features, at).reshape(n, n_features))
    return [np.concatenate(c) for c in out]


def _key(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[np.ndarray]]:
    """The matrix ``x`` and whole-number columns of some thousands of rows at a time."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            held.append([_matrix(batch, "x"), *(_key(batch.column(c)) for c in columns)])
        if sum(len(h[0]) for h in held) >= BLOCK_ROWS:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(tree, root, rows) in batches of a bounded size, an empty one at the end."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["tree", "root", "rows"])


@dataclass
class Top:
    """Splits above the roots of every tree (none where all rows fit a task): per tree a small
    tree whose leaves are the roots. A leaf with a value is final, the others (NaN) grow on."""

    trees: dict[int, Tree] = field(default_factory=dict)

    def roots(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node of the tree's top that each row falls into."""
        t = self.trees.get(tree)
        if t is None:
            return np.zeros(len(x), np.int64)
        return leaf_values(Tree(t.feature, t.threshold, t.left, np.arange(len(t.feature)), t.gain, t.weight), x)

    def parted(self, tree: int, columns: np.ndarray, rows: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(root, those of ``rows`` that fall into it) of the tree, or of its ``wanted`` leaves only;
        ``columns`` are the values by feature and row."""
        t = self.trees.get(tree)
        if t is None:
            yield 0, rows
            return
        need = np.ones(len(t.feature), bool)
        if wanted is not None:
            need[:] = False
            need[wanted] = True
            for node in range(len(need) - 1, -1, -1):
                if t.feature[node] >= 0:
                    need[node] = need[t.left[node]] or need[t.left[node] + 1]
        todo = [(0, rows)]
        while todo:
            node, at = todo.pop()
            if not need[node] or not len(at):
                continue
            if t.feature[node] < 0:
                yield node, at
                continue
            left = columns[t.feature[node]].take(at) <= t.threshold[node]
            todo += [(int(t.left[node]), at[left]), (int(t.left[node]) + 1, at[~left])]

    def open(self, tree: int) -> np.ndarray | None:
        """The leaves of the tree's top that grow on."""
        t = self.trees.get(tree)
        return None if t is None else np.flatnonzero((t.feature < 0) & np.isnan(t.value))

    def final(self, tree: int, root: int) -> bool:
        return tree in self.trees and not np.isnan(self.trees[tree].value[root])

    def leaves(self) -> list[tuple]:
        """Final leaves as rows of the node table."""
        return [
            (t, i, 0, -1, 0.0, -1, float(tree.value[i]), 0.0, float(tree.weight[i]))
            for t, tree in self.trees.items() for i in np.flatnonzero((tree.feature < 0) & ~np.isnan(tree.value)).tolist()
        ]


def _dealt(top: Top, trees: Sequence[int], seed: int):
    """Training rows packed per (tree, root) with the number of times the tree draws them."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for x, y, key in _gathered(batches, "y", "key"):
            y, columns = y.astype(np.int8), np.ascontiguousarray(x.T)
            for t in trees:
                w = _poisson(seed, t, key)
                for r, i in top.parted(t, columns, np.flatnonzero(w), top.open(t)):
                    yield t, r, _packed(x.take(i, 0), y.take(i), w.take(i))

    return lambda batches: _batches(packed(batches))


def _node_table(tree: int, root: int, t: Tree) -> pa.Table:
    n = len(t.feature)
    return pa.table({
        "tree": pa.array(np.full(n, tree, np.int32)), "root": pa.array(np.full(n, root, np.int32)), "node": pa.array(np.arange(n, dtype=np.int32)),
        "feature": pa.array(t.feature), "threshold": pa.array(t.threshold), "left": pa.array(t.left.astype(np.int32)),
        "value": pa.array(t.value), "gain": pa.array(t.gain), "weight": pa.array(t.weight),
    })


def _grown_tree(key, table, n_features: int, max_features: int, seed: int) -> Tree:
    tree, root = key[0].as_py(), key[1].as_py()
    y, w, x = _unpacked([b.as_buffer() for b in table.column("rows").combine_chunks()], n_features, np.int8, np.uint8)
    return grow(x, y, w, max_features, (seed, tree, root))


def _grown(n_features: int, max_features: int, seed: int):
    def run(key, table):
        return _node_table(key[0].as_py(), key[1].as_py(), _grown_tree(key, table, n_features, max_features, seed))

    return run


def _grown_values(top: Top, n_features: int, max_features: int, seed: int, gains: bool, values: bool = True):
    """Of a grown tree its gains by feature (place: the feature), and the values that it gives to
    the test rows of its root (tree -1, place: the row's)."""

    def run(key, table, blocks=None):
        tree, root = key[0].as_py(), key[1].as_py()
        tested = values and blocks.num_rows > 0
        grown = _grown_tree(key, table, n_features, max_features, seed) if table.num_rows and (gains or tested) else None
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if gains and grown:
            split = grown.feature >= 0
            used = np.unique(grown.feature[split])
            out.append((np.full(len(used), tree), used, np.bincount(grown.feature[split], grown.gain[split], n_features)[used]))
        if tested and (grown or top.final(tree, root)):
            place, x = _unpacked([b.as_buffer() for b in blocks.column("rows").combine_chunks()], n_features, np.int64)
            value = np.full(len(place), top.trees[tree].value[root]) if top.final(tree, root) else leaf_values(grown, x)
            out.append((np.full(len(place), -1), place, value))
        of, place, value = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"tree": pa.array(of.astype(np.int32)), "place": pa.array(place.astype(np.int64)), "value": pa.array(value.astype(np.float64))})

    return run if values else lambda key, table: run(key, table)


# -------------------------------------------------------------- tops of trees
def _histograms(top: Top, open_nodes: dict[int, np.ndarray], edges: list[np.ndarray], seed: int):
    """Weights of both classes by (node, feature, bin) over a task's rows, one row per (tree, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = len(edges)
        sums = {t: np.zeros((len(nodes), f, BINS + 1, 2)) for t, nodes in open_nodes.items()}
        for x, y, key in _gathered(batches, "y", "key"):
            columns = np.ascontiguousarray(x.T)
            cells = [(np.where(np.isnan(v), BINS, np.searchsorted(e, v, "left")) * 2 + y).astype(np.uint8) for v, e in zip(columns, edges, strict=True)]
            for t, nodes in open_nodes.items():
                w = _poisson(seed, t, key)
                for r, i in top.parted(t, columns, np.flatnonzero(w), nodes):
                    of, weight = sums[t][np.searchsorted(nodes, r)], w.take(i).astype(np.float64)
                    for k in range(f):
                        of[k] += np.bincount(cells[k].take(i), weight, (BINS + 1) * 2).reshape(BINS + 1, 2)
        yield from _batches((t, int(nodes[i]), sums[t][i].tobytes()) for t, nodes in open_nodes.items() for i in range(len(nodes)) if sums[t][i].any())

    return run


_SPLIT = "tree int, root int, feature int, threshold float, gain double, n_left double, n_right double, ones_left double, ones_right double"


def _best_split(edges: list[np.ndarray], max_features: int, seed: int):
    def run(key, table):
        tree, root = key[0].as_py(), key[1].as_py()
        h = np.sum([np.frombuffer(b.as_buffer(), np.float64) for b in table.column("rows").combine_chunks()], axis=0).reshape(len(edges), BINS + 1, 2)
        n, ones = h[0].sum(), h[0, :, 1].sum()
        best = (-1, 0.0, 0.0, n, 0.0, ones, 0.0)
        if 0 < ones < n:
            top = -1.0
            for k, f in enumerate(np.argsort(_uniform(seed, tree, root, -1, np.arange(len(edges)))).tolist()):
                if k >= max_features and best[0] >= 0:
                    break
                w, w1 = np.cumsum(h[f].sum(1))[:-1], np.cumsum(h[f, :, 1])[:-1]
                cut = (w > 0) & (w < n)
                cut[len(edges[f]) :] = False
                if cut.any():
                    score = np.where(cut, _purity(w1, w) + _purity(ones - w1, n - w), -1.0)
                    i = int(score.argmax())
                    if score[i] > top:
                        top = score[i]
                        best = (f, edges[f][i], max(score[i] - _purity(np.array(ones), np.array(n)), 0.0), w[i], n - w[i], w1[i], ones - w1[i])
        values = (tree, root, *best)
        types = [pa.int32(), pa.int32(), pa.int32(), pa.float32()] + [pa.float64()] * 5
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in _SPLIT.split(", ")])

    return run


def _tops(rows: DataFrame, n_rows: int, n_features: int, n_trees: int, max_features: int, max_rows: int, seed: int) -> Top:
    """Split nodes of more than ``max_rows`` rows by histograms; the driver holds one line per
    split, about n_trees * n_rows / max_rows of them."""
    if n_rows <= max_rows:
        return Top()
    probs = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(F.when(~F.isnan(F.col("x")[k]), F.col("x")[k]), probs, 100 * BINS).alias(f"c{k}") for k in range(n_features)]).first()
    edges = [np.unique(np.array(c if c is not None else [], np.float32)) for c in cuts]
    # growing columns per tree: feature, threshold, left, value (NaN: open), gain, weight
    grown = {t: [[-1], [0.0], [-1], [math.nan], [0.0], [float(n_rows)]] for t in range(n_trees)}
    todo = {t: [0] for t in range(n_trees)}
    types = (np.int32, np.float32, np.int32, float, float, float)
    as_top = lambda: Top({t: Tree(*(np.array(c, d) for c, d in zip(g, types, strict=True))) for t, g in grown.items()})
    at_once = max(1, HISTOGRAM_BYTES // (n_features * (BINS + 1) * 16))
    while todo:
        top, groups, room = as_top(), [{}], at_once
        for t, nodes in todo.items():
            for i in range(0, len(nodes), at_once):
                part = nodes[i : i + at_once]
                if len(part) > room:
                    groups.append({})
                    room = at_once
                groups[-1][t] = np.array(sorted(part))
                room -= len(part)
        todo = {}
        for open_nodes in groups:
            partial = rows.mapInArrow(_histograms(top, open_nodes, edges, seed), _BLOCK)
            found = partial.groupBy("tree", "root").applyInArrow(_best_split(edges, max_features, seed), _SPLIT).collect()
            for r in sorted(found, key=lambda r: (r["tree"], r["root"])):
                g, at = grown[r["tree"]], r["root"]
                if r["feature"] < 0:
                    # one class, or no bin edge between its rows: a leaf
                    g[3][at], g[5][at] = r["ones_left"] / r["n_left"], r["n_left"]
                    continue
                left = len(g[0])
                g[0][at], g[1][at], g[2][at], g[4][at], g[5][at] = r["feature"], r["threshold"], left, r["gain"], r["n_left"] + r["n_right"]
                for side, (n, ones) in enumerate(((r["n_left"], r["ones_left"]), (r["n_right"], r["ones_right"]))):
                    pure = ones in (0, n)
                    for column, value in zip(g, (-1, 0.0, -1, ones / n if pure else math.nan, 0.0, n), strict=True):
                        column.append(value)
                    if n > max_rows and not pure:
                        todo.setdefault(r["tree"], []).append(left + side)
    return as_top()


# --------------------------------------------------------------------- model
@dataclass
class Growth:
    """What a forest of full depth grows from: training rows (key, y, x) and its parameters."""

    rows: DataFrame
    n_rows: int
    n_features: int
    max_features: int
    seed: int

    def batches(self, n_trees: int) -> list[list[int]]:
        """Trees grown at a time: their dealt rows are within ``DEALT_BYTES``, one tree at least."""
        a_tree = 0.64 * self.n_rows * (4 * self.n_features + 2)
        step = max(1, min(n_trees, int(DEALT_BYTES // max(a_tree, 1))))
        return [list(range(i, min(i + step, n_trees))) for i in range(0, n_trees, step)]

    def dealt(self, top: Top, trees: Sequence[int]) -> DataFrame:
        return self.spread(self.rows.mapInArrow(_dealt(top, trees, self.seed), _BLOCK), top, trees)

    def spread(self, blocks: DataFrame, top: Top, trees: Sequence[int]) -> DataFrame:
        """``blocks`` by (tree, root), in as many tasks as there is growing for."""
        roots = sum(1 if top.open(t) is None else len(top.open(t)) for t in trees)
        busy = max(cores(blocks.sparkSession), int(0.64 * self.n_rows * len(trees)) // TASK_ROWS)
        return blocks.repartition(max(1, min(roots, busy)), "tree", "root")

    @property
    def drawn(self) -> tuple[int, int, int]:
        return self.n_features, self.max_features, self.seed


@dataclass
class Forest:
    """A forest: its tops, and a table of nodes or what they grow from."""

    top: Top
    features: list[str]
    n_trees: int
    table: DataFrame | None = None  # small trees only
    growth: Growth | None = None
    gains: DataFrame | None = None  # kept by a score that was asked for them

    @property
    def nodes(self) -> DataFrame:
        """All nodes (``tree, root, node, ...``), written on first use."""
        if self.table is None:
            grown = self.growth.dealt(self.top, list(range(self.n_trees))).groupBy("tree", "root").applyInArrow(_grown(*self.growth.drawn), _NODE)
            if leaves := self.top.leaves():
                grown = grown.unionByName(grown.sparkSession.createDataFrame(leaves, _NODE))
            self.table = cut_lineage(grown)
        return self.table

    def _gains(self) -> DataFrame:
        if self.growth is None:
            return self.table.where("feature >= 0").select("tree", "feature", "gain")
        return self.gains if self.gains is not None else self._grown(None, True).select("tree", F.col("place").cast("int").alias("feature"), F.col("value").alias("gain"))

    def _grown(self, keyed: DataFrame | None, gains: bool) -> DataFrame:
        """(tree, place, value): the trees' gains by feature, and in tree -1 their values of every
        test row, added up over the trees grown at a time."""
        parts = []
        for trees in self.growth.batches(self.n_trees):
            dealt = self.growth.dealt(self.top, trees).groupBy("tree", "root")
            grow_ = _grown_values(self.top, *self.growth.drawn, gains, keyed is not None)
            if keyed is None:
                values = dealt.applyInArrow(grow_, _VALUE)
            else:
                blocks = self.growth.spread(keyed.mapInArrow(_spread(self.top, trees), _BLOCK), self.top, trees)
                values = dealt.cogroup(blocks.groupBy("tree", "root")).applyInArrow(grow_, _VALUE)
            parts.append(cut_lineage(values.groupBy("tree", "place").agg(F.sum("value").alias("value"))))
            release(self.growth.rows.sparkSession)
        return reduce(DataFrame.unionByName, parts)

    def importances(self) -> DataFrame:
        """T10 (feature, importance): impurity decreases by feature, as shares within each tree,
        averaged over the trees; features never split on have 0."""
        gains = self._gains()
        spark = gains.sparkSession
        above = [(t, int(f), float(g)) for t, tree in self.top.trees.items() for f, g in zip(tree.feature, tree.gain, strict=True) if f >= 0]
        if above:
            gains = gains.unionByName(spark.createDataFrame(above, "tree int, feature int, gain double"))
        per_tree = gains.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        share = F.try_divide(F.col("gain"), F.sum("gain").over(Window.partitionBy("tree")))
        total = per_tree.withColumn("share", share).groupBy("feature").agg((F.sum("share") / self.n_trees).alias("importance"))
        names = spark.createDataFrame(list(enumerate(self.features)), "i int, name string")
        return names.join(total, F.col("i") == F.col("feature"), "left").select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))

    def score(self, df: DataFrame, id_col: str, label: str, ranked: bool = False) -> DataFrame:
        """T9 (id, label, score, prediction): the mean class-1 share over all trees.

        A table of nodes is bounded by parameters and goes to every task; trees that grow with
        the data meet the rows by (tree, root) and leave their values only, and with ``ranked``
        their gains, so that :meth:`importances` need not grow them again."""
        rows = _rows(df, self.features, label, F.col(id_col))
        if self.growth is None:
            table = self.table.orderBy("tree", "node").toArrow()
            scored = rows.select("id", "y", _score_all(_trees(table))("x").alias("score"))
        else:
            keyed = cut_lineage(rows.withColumn("place", F.monotonically_increasing_id()))
            grown = self._grown(keyed, ranked)
            if ranked:
                self.gains = grown.where("tree >= 0").select("tree", F.col("place").cast("int").alias("feature"), F.col("value").alias("gain"))
            mean = grown.where("tree < 0").groupBy("place").agg((F.sum("value") / self.n_trees).alias("score"))
            scored = keyed.join(mean, "place").select("id", "y", "score")
        return scored.select("id", F.col("y").alias("label"), "score", (F.col("score") > F.lit(0.5)).cast("int").alias("prediction"))


def _trees(table: pa.Table) -> list[Tree]:
    tree = table.column("tree").to_numpy()
    cols = [table.column(c).to_numpy() for c in ("feature", "threshold", "left", "value", "gain", "weight")]
    cuts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]).tolist() + [len(tree)]
    return [Tree(*(c[a:b] for c in cols)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _score_all(trees: list[Tree]):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            x = _matrix(pa.RecordBatch.from_arrays([col], ["x"]), "x")
            total = np.zeros(len(x))
            for t in trees:
                total += leaf_values(t, x)
            yield pa.array(total / len(trees))

    return score


def _spread(top: Top, trees: Sequence[int]):
    """Test rows packed per (tree, root)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        for x, place in _gathered(batches, "place"):
            columns = np.ascontiguousarray(x.T)
            for t in trees:
                for r, i in top.parted(t, columns, np.arange(len(x))):
                    yield t, r, _packed(x.take(i, 0), place.take(i))

    return lambda batches: _batches(packed(batches))


def _rows(df: DataFrame, features: Sequence[str], label: str, id_col: Column) -> DataFrame:
    """(id, y, x) with 32-bit feature values, missing ones NaN."""
    return df.select(id_col.alias("id"), F.col(f"`{label}`").cast("int").alias("y"), _values(features).alias("x"))


def _values(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("float"), F.lit(float("nan")).cast("float")) for c in features])


def _n_drawn(n_features: int, max_features: int | str) -> int:
    return n_features if max_features == "all" else max(1, int(math.sqrt(n_features))) if max_features == "sqrt" else int(max_features)


# --------------------------------------------------------------------- forests
def random_forest(train: DataFrame, features: Sequence[str], label: str, key: Column, n_trees: int = 100,
                  max_features: int | str = "sqrt", max_rows: int = MAX_ROWS, seed: int = 0) -> Forest:
    """T5: ``n_trees`` trees of full depth, each on a bootstrap of all rows (Poisson draws by the
    hash of ``key``, a value per row). Rows with a missing label are left out."""
    ship(train.sparkSession)
    rows = _rows(train, features, label, F.xxhash64(key).cast("long")).withColumnRenamed("id", "key").where("y is not null")
    rows = cut_lineage(rows)
    n = rows.count()
    k = _n_drawn(len(features), max_features)
    top = _tops(rows, n, len(features), n_trees, k, max_rows, seed)
    return Forest(top, list(features), n_trees, growth=Growth(rows, n, len(features), k, seed))


def exact_bags(train: DataFrame, key: Sequence[str], n_estimators: int, rows_per_tree: int, seed: int = 0) -> DataFrame:
    """``train`` rows with the trees that draw them (columns ``tree``, ``draws``): every tree makes
    exactly ``rows_per_tree`` draws with replacement.

    Draw i of tree t takes the row at place md5(seed|t|i) mod n in the order of md5(key), key.
    The draws are a table of n_estimators * rows_per_tree rows, whatever the data; the rows are
    ranked by a distributed rank."""
    from ledgerline.operators.ranking import global_rank
    from ledgerline.operators.sampling import draw_place, key_hash

    ranked = global_rank(train, [key_hash(F.concat_ws("|", *key)), *key], "_place")
    n = train.count()
    draws = train.sparkSession.range(n_estimators * rows_per_tree).select(
        F.expr(f"cast(id div {rows_per_tree} as int)").alias("tree"), F.expr(f"id % {rows_per_tree}").alias("_i")
    )
    bags = draws.select("tree", draw_place(n, seed, F.col("tree"), F.col("_i")).alias("_place")).groupBy("tree", "_place").agg(F.count(F.lit(1)).alias("draws"))
    return ranked.join(bags, "_place").drop("_place")


def bagged_trees(train: DataFrame, features: Sequence[str], label: str, key: Sequence[str], n_estimators: int = 1000,
                 rows_per_tree: int = 120, seed: int = 123) -> Forest:
    """T4: trees of full depth over all features, each on its exact bag (:func:`exact_bags`); at
    most 2 * rows_per_tree - 1 nodes a tree. One job grows all trees."""
    ship(train.sparkSession)
    train = train.where(F.col(f"`{label}`").isNotNull()).select(*dict.fromkeys([*key, label, *features]))
    bags = exact_bags(train, key, n_estimators, rows_per_tree, seed)
    rows = bags.select("tree", "draws", F.col(f"`{label}`").cast("int").alias("y"), _values(features).alias("x"))
    nodes = rows.groupBy("tree").applyInArrow(_bag_grown(len(features), seed), _NODE)
    return Forest(Top(), list(features), n_estimators, table=cut_lineage(nodes))


def _bag_grown(n_features: int, seed: int):
    def run(key, table):
        tree = key[0].as_py()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, n_features)
        y, w = (table.column(c).to_numpy().astype(np.float64) for c in ("y", "draws"))
        return _node_table(tree, 0, grow(x, y, w, n_features, (seed, tree, 0)))

    return run
