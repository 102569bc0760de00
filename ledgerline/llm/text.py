"""Vectorised text helpers that run inside tasks on Arrow batches.

A batch is cut into runs of documents of about ``CHUNK_BYTES`` bytes (a longer
document is a run of its own), so the numpy temporaries of a task stay bounded
whatever the batch size. Words are hashed on the bytes of the Arrow buffer with
a polynomial over random per-byte values modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U = np.uint64

_rng = np.random.default_rng(20240607)
_BYTE_VALUES = _rng.integers(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 2**64)

#: white space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: bytes of letters, digits and of any character beyond ASCII
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER_VALUES = _BYTE_VALUES[LOWER]

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        _powers = np.cumprod(np.concatenate([[U(1)], np.full(size, U(_BASE))]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[U(1)], np.full(size, U(_BASE_INVERSE))]), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection that spreads every input bit)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Run:
    """Consecutive documents of one batch: first row, byte buffer, document offsets in it."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def __post_init__(self) -> None:
        self.offsets = self.offsets.astype(np.int64)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary array without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def runs(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Run]:
    offsets, data = buffers(col)
    offsets = offsets.astype(np.int64)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield Run(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def spans(run: Run, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document of the maximal stretches of ``is_word`` bytes;
    a stretch never crosses a document."""
    if not len(run.data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_word[run.data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    bounds = run.offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(inside))]
    before[bounds] = False
    after[bounds - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(run.offsets, starts, "right") - 1
    return starts, ends, doc


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every byte span (A-Z read as a-z when ``lower``)."""
    _grow(len(data))
    values = (_LOWER_VALUES if lower else _BYTE_VALUES)[data]
    values *= _powers[: len(data)]
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(values, out=prefix[1:])
    out = (prefix[ends] - prefix[starts]) * _inverses[starts]
    return mix(out + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(run: Run, is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word ``[^\\x20\\x09-\\x0D]+`` (or of ``is_word`` stretches), A-Z lower-cased."""
    s, e, doc = spans(run, ~SPACE if is_word is None else is_word)
    return span_hashes(run.data, s, e), doc


def doc_bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each document's entries in arrays ordered by document."""
    return np.searchsorted(doc, np.arange(n + 1), "left")


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + c)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
