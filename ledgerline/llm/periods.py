"""Periodic runs of words: stretches that repeat their own beginning over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``repeats`` * q and ``min_length`` words long, that no neighbouring
word extends keeping the period.

*Harmonic grid.* For every period q only the words at multiples of q are looked at. A run
of period q holds such a grid word within its first q words, and that word equals the
words q, 2q, ... (repeats - 1)q further; all grids together have n * (1 + 1/2 + 1/3 + ...)
words. How far the agreement of word x and word x + q reaches to both sides is one
longest-common-extension (LCE) query each, and gives the run.

*Difference-cover LCE.* Suffixes are sorted only at positions that lie in a difference
cover modulo V. For any two positions some shift below V brings both into the cover, so
an extension compares fewer than V words until it reaches synchronised samples; the rest
is the least common prefix between their ranks, read from a sparse table.

Documents are worked on in groups of about a megabyte (a longer one alone), joined by
symbols that occur once, so nothing extends from one into the next.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm import text as T
from ledgerline.llm.common import texts

MIN_LENGTH = 6
REPEATS = 4
#: a difference cover: every residue modulo V is a difference of two of its members
V = 21
COVER = (0, 1, 4, 14, 16)
#: grid words looked at together
BLOCK = 1 << 20


def _shifts(v: int, cover: tuple[int, ...]) -> np.ndarray:
    """shift[a, b]: the least d < v with a + d and b + d both in the cover modulo v."""
    inside = np.zeros(v, bool)
    inside[list(cover)] = True
    at = (np.arange(v)[:, None] + np.arange(v)[None, :]) % v  # residue, shift
    both = inside[at][:, None, :] & inside[at][None, :, :]
    assert both.any(2).all(), "not a difference cover"
    return both.argmax(2)


_SHIFT = _shifts(V, COVER)


class Extensions:
    """Longest common extensions to the right between positions of ``symbols`` (dense
    non-negative integers; the last symbol occurs once)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        top = int(symbols.max(initial=0)) + 1
        # symbols of their own behind the end, so that every sample has V words
        self.symbols = np.concatenate([symbols, np.arange(top, top + 2 * V)]).astype(np.int64)
        alphabet = top + 2 * V
        # samples of one residue are adjacent: the next V words are the next sample
        per = [np.arange(c, n + V, V) for c in COVER]
        self.first = np.zeros(V, np.int64)
        self.first[list(COVER)] = np.cumsum([0, *(len(p) for p in per)])[:-1]
        self.at = np.concatenate(per)
        ends = np.repeat(np.cumsum([len(p) for p in per]), [len(p) for p in per])
        self._sort(alphabet, ends)

    def _sort(self, alphabet: int, ends: np.ndarray) -> None:
        """Ranks of the sampled suffixes by prefix doubling over blocks of V words, the common
        prefixes of neighbours in rank order, and their minima over powers of two."""
        at, s = self.at, self.symbols
        m = len(at)
        bits = alphabet.bit_length()
        each = max(1, (62 - m.bit_length()) // bits)
        rank, d = np.zeros(m, np.int64), 0
        while d < V:
            key = rank
            for _ in range(min(each, V - d)):
                key = (key << bits) | s[at + d]
                d += 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels = [rank]
        index = np.arange(m)
        while int(levels[-1].max(initial=0)) + 1 < m:
            ahead = index + (1 << (len(levels) - 1))
            r = levels[-1]
            # beyond the last sample there is nothing to compare: such blocks differ already
            following = np.where(ahead < ends, r[np.minimum(ahead, m - 1)] + 1, 0)
            levels.append(np.unique(r * (m + 1) + following, return_inverse=True)[1].astype(np.int64))
        self.rank = levels[-1]
        order = np.empty(m, np.int64)
        order[self.rank] = index
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            same = levels[k][a] == levels[k][b]
            common[same] += V << k
            a[same] += 1 << k
            b[same] += 1 << k
        left = np.arange(len(common))
        x, y = at[a], at[b]
        for d in range(V):
            left = left[s[x[left] + d] == s[y[left] + d]]
            if not len(left):
                break
            common[left] += 1
        self.minima = [common]
        step = 1
        while 2 * step <= len(common):
            low = self.minima[-1]
            self.minima.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on (i, j different positions)."""
        s = self.symbols
        shift = _SHIFT[i % V, j % V]
        out = np.empty(len(i), np.int64)
        alive = np.arange(len(i))
        synced = []
        d = 0
        while len(alive):
            there = shift[alive] == d
            synced.append(alive[there])
            alive = alive[~there]
            same = s[i[alive] + d] == s[j[alive] + d]
            out[alive[~same]] = d
            alive = alive[same]
            d += 1
        k = np.concatenate(synced) if synced else alive
        if len(k):
            x, y = self._rank(i[k] + shift[k]), self._rank(j[k] + shift[k])
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for v in np.unique(level).tolist():
                of = level == v
                t = self.minima[v]
                out[k[of]] = shift[k[of]] + np.minimum(t[low[of]], t[high[of] - (1 << v)])
        return out

    def _rank(self, p: np.ndarray) -> np.ndarray:
        return self.rank[self.first[p % V] + p // V]


# -------------------------------------------------------------------- runs
@dataclass
class Runs:
    """Runs of a group of documents, ordered by document, start and period."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _grid(symbols: np.ndarray, offsets: np.ndarray, min_length: int, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of grid words that equal the words at 1 .. repeats - 1 periods."""
    sizes = np.diff(offsets)
    sizes = np.where(sizes >= min_length, sizes, 0)
    most = sizes // repeats
    doc = np.repeat(np.arange(len(sizes)), most)
    period = T.concat_ranges(np.ones(len(sizes), np.int64), most)
    # multiples k*q with k*q + (repeats - 1)*q inside the document
    points = (sizes[doc] - 1) // np.maximum(period, 1) - (repeats - 1) + 1
    bounds = np.cumsum(points)
    a = 0
    while a < len(doc):
        done = bounds[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(bounds, done + BLOCK, "right")))
        n = points[a:b]
        q = np.repeat(period[a:b], n)
        x = np.repeat(offsets[doc[a:b]], n) + q * T.concat_ranges(np.zeros(len(n), np.int64), n)
        for k in range(1, repeats):
            same = symbols[x] == symbols[x + k * q]
            x, q = x[same], q[same]
        if len(x):
            yield x, q
        a = b


def find_runs(symbols: np.ndarray, offsets: np.ndarray, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> Runs:
    """All runs of the documents symbols[offsets[d]:offsets[d+1]] (non-negative word numbers).

    ``repeats`` is at least 2; two periods of one stretch this long have a common divisor that
    is a period too, so the least period found for a stretch is its smallest."""
    offsets = offsets.astype(np.int64)
    hits = list(_grid(symbols, offsets, min_length, repeats))
    none = np.zeros(0, np.int64)
    if not hits:
        return Runs(none, none, none, none)
    # only documents with a hit are sorted, each between symbols that occur once
    owner = [np.searchsorted(offsets, x, "right") - 1 for x, _ in hits]
    used = np.unique(np.concatenate(owner))
    sizes = np.diff(offsets)[used]
    starts = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    joined = int(symbols.max()) + 1 + np.arange(int(sizes.sum()) + len(used) + 1, dtype=np.int64)
    joined[T.concat_ranges(starts, sizes)] = symbols[T.concat_ranges(offsets[used], sizes)]
    joined = np.unique(joined, return_inverse=True)[1]
    n = len(joined)
    right, left = Extensions(joined), Extensions(joined[::-1])
    found = []
    for (x, q), doc in zip(hits, owner, strict=True):
        d = np.searchsorted(used, doc)
        x = x - offsets[doc] + starts[d]
        before = left.common(n - x, n - x - q)  # from x - 1 and x + q - 1 backwards
        after = right.common(x, x + q)
        length = before + q + after
        keep = length >= np.maximum(min_length, repeats * q)
        found.append(np.stack([d[keep], (x - before)[keep], length[keep], q[keep]]))
        found[-1] = np.unique(found[-1], axis=1) if found[-1].shape[1] else found[-1]
    d, at, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, at))
    d, at, length, q = d[order], at[order], length[order], q[order]
    least = np.ones(len(at), bool)
    least[1:] = (at[1:] != at[:-1]) | (length[1:] != length[:-1])
    d, at, length, q = d[least], at[least], length[least], q[least]
    order = np.lexsort((q, at))
    d, at, length, q = d[order], at[order], length[order], q[order]
    return Runs(used[d], at - starts[d], length, q)


# ---------------------------------------------------------------- operator
def rotation(doc_id: int | None, n: int) -> np.ndarray | None:
    """Planted repetitions: for an id whose h = crc32(decimal id) is a multiple of 10, word i >= a
    is word a + (i - a) % p, where g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8).
    The numbers of the original words, or None where the text stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words inside a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)


def _report(plant: Callable[[int | None, int], np.ndarray | None] | None, min_length: int, repeats: int, with_text: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")] + (["collapsed"] if with_text else [])

    def group(ids: list[int | None], run: T.Run) -> pa.RecordBatch:
        number = defaultdict(count().__next__)
        data = run.data.tobytes()
        words, parts = [], []
        for k, i in enumerate(ids):
            # bytes.split() cuts at ASCII white space only
            w = data[run.offsets[k] : run.offsets[k + 1]].split()
            p = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
            at = plant(i, len(w)) if plant else None
            if at is not None:
                p = p[at]
                w = [w[j] for j in at.tolist()]
            words.append(w)
            parts.append(p)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        symbols = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        runs = find_runs(symbols, offsets, min_length, repeats)
        bounds = T.doc_bounds(runs.doc, len(ids))
        rows = []
        for k, i in enumerate(ids):
            a, b = bounds[k], bounds[k + 1]
            start, length, period = runs.start[a:b], runs.length[a:b], runs.period[a:b]
            w, gone, best = words[k], 0, (None, None, None, None)
            if b > a:
                drop = _dropped(len(w), start, length, period)
                gone = int(drop.sum())
                w = [w[j] for j in np.flatnonzero(~drop).tolist()]
                j = int(np.lexsort((period, start, -length))[0])
                best = (int(start[j]), int(length[j]), int(period[j]), 1000 * int(length[j]) // int(period[j]))
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
            kept = b" ".join(w)
            row = (i, int(b - a), *best, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest(), len(parts[k]), gone)
            rows.append((*row, kept.decode("utf-8", "replace")) if with_text else row)
        types = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()] * with_text
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for r in T.runs(batch.column(1)):
                yield group(ids[r.first : r.first + r.n], r)

    return run


def report(
    docs: DataFrame,
    plant: Callable[[int | None, int], np.ndarray | None] | None = None,
    min_length: int = MIN_LENGTH,
    repeats: int = REPEATS,
    with_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the longest run (start, length, period,
    exponent_milli; ties by start, then period; four nulls without a run), runs_sha256 over the
    lines ``start,length,period`` of all runs, collapsed_sha256 over the words that stay when
    every run keeps its first period, n_words, n_dropped; with ``with_text`` also the collapsed
    text. ``plant(doc_id, n)`` may name the original word to read at each of n places.

    A null text counts as empty (no words, no runs, the digests of nothing); rows with a null or
    repeated id are reported as they stand; an empty table gives no rows; other columns, whatever
    their names, are not read. Words are compared as bytes, case-sensitively. No text is cut: a
    very long one is worked on alone, in memory proportional to its words."""
    rows = texts(docs, id_col, text_col)
    schema = SCHEMA + (", collapsed string" if with_text else "")
    return rows.mapInArrow(_report(plant, min_length, repeats, with_text), schema)
