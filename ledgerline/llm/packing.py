"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

The packing decision depends only on the lengths, and a sequence of ``capacity``
tokens has at most ``capacity`` different lengths. Spark therefore counts the
pieces of every length (one aggregate, at most ``capacity`` rows whatever the
corpus size); best fit decreasing runs over those counts with a segment tree
over the remaining capacities, placing all equal bins and equal pieces in one
step; the resulting plan (a few rows per length) is applied on the executors to
every piece by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Workspace, texts

#: sequences hold this many tokens; documents end with this id
CAPACITY = 1024
END_ID = 2
#: pieces of one length are ranked in groups of about this many rows
RANK_GROUP = 50_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --------------------------------------------------------------- tokenising
class Encoder:
    """Token ids of whole texts by a tokenizer file, as little-endian unsigned 32-bit bytes.

    A byte-level BPE file, in which a merge's rank is its token's id, is encoded by
    tiktoken with the file's own vocabulary, which gives the ids of the tokenizers
    library several times faster; any other file is encoded by that library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = _byte_bpe(path)
        probe = ["It's 12,5  km.\n\n  Größe's\tend \u65e5\u672c <|endoftext|> x ", " a  b\r\nc's"]
        if self.fast and [self.fast(t).tolist() for t in probe] != [e.ids for e in self.tokenizer.encode_batch(probe, add_special_tokens=False)]:
            self.fast = None

    def encode(self, batch: list[str]) -> list[bytes]:
        if self.fast:
            return [self.fast(t).astype("<u4", copy=False).tobytes() for t in batch]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


def _byte_bpe(path: str):
    """A text -> ids function for a byte-level BPE tokenizer file; None for other kinds."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, split = spec["model"].get("vocab"), spec.get("pre_tokenizer") or {}
    if spec["model"].get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
        return None
    # byte-level files write each byte as one printable character
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    coding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: coding.encode_to_numpy(text, allowed_special="all")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, text = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < batch.num_rows:
                # about 4 MB of text at a time
                stop, size = at, 0
                while stop < batch.num_rows and (size < 4_000_000 or stop == at):
                    size += len(text[stop].as_buffer()) if text[stop].as_buffer() else 0
                    stop += 1
                docs = ids.slice(at, stop - at).to_pylist()
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, data in zip(docs, enc.encode(text.slice(at, stop - at).to_pylist()), strict=True):
                    data += end
                    n = len(data) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n % capacity or capacity) if piece == 0 else capacity
                        own = data[4 * start : 4 * (start + length)]
                        for c, v in zip(cols, (doc, piece, start, length, zlib.crc32(own), own), strict=True):
                            c.append(v)
                        start, piece = start + length, piece + 1
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
                at = stop

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut those longer than ``capacity`` tokens: the first
    piece takes the remainder, every further piece is full. ``with_ids`` adds the
    ids as little-endian unsigned 32-bit bytes.

    A null or empty text is the end id alone; repeated ids are separate documents."""
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "")
    return texts(docs).mapInArrow(_cut(path or tokenizer_path(), capacity, end_id, with_ids), schema)


# ------------------------------------------------------------ best fit plan
class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        i = remaining + self.size
        while i:
            self.open[i] += bins
            i //= 2

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity >= length that has an open bin."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass(frozen=True)
class Step:
    """Pieces of ``length`` with ranks [rank, rank + count): ``each`` per sequence, from
    sequence ``sequence`` on, the first at token ``offset`` of its sequence."""

    length: int
    rank: int
    count: int
    each: int
    sequence: int
    offset: int


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Best fit decreasing for ``counts`` pieces of each length.

    Equal open bins are runs of sequence numbers that share a remaining capacity.
    A piece goes to the tightest bin that holds it; that bin, now tighter, also
    takes the next equal pieces while they fit, so a run of bins is filled in one
    step with the same result as piece by piece."""
    tree = CapacityTree(capacity)
    groups: dict[int, list[tuple[int, int]]] = {}  # remaining -> runs (first sequence, bins)
    steps: list[Step] = []
    made = 0

    def put(remaining: int, first: int, bins: int) -> None:
        if bins and remaining:
            groups.setdefault(remaining, []).append((first, bins))
            tree.add(remaining, bins)

    def fill(length: int, rank: int, left: int, remaining: int, first: int, bins: int) -> int:
        each = remaining // length
        full = min(bins, left // each)
        placed = full * each
        if full:
            steps.append(Step(length, rank, placed, each, first, capacity - remaining))
            put(remaining - each * length, first, full)
        rest = min(left - placed, each) if full < bins else 0
        if rest:
            steps.append(Step(length, rank + placed, rest, rest, first + full, capacity - remaining))
            put(remaining - rest * length, first + full, 1)
        used = full + bool(rest)
        put(remaining, first + used, bins - used)
        return placed + rest

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                each = capacity // length
                bins = -(-left // each)
                placed = fill(length, rank, left, capacity, made, bins)
                made += bins
            else:
                first, bins = groups[remaining].pop()
                tree.add(remaining, -bins)
                placed = fill(length, rank, left, remaining, first, bins)
            rank, left = rank + placed, left - placed
    return steps


def _place(steps: list[Step], length_col: str, rank_col: str):
    table = np.array([(s.length, s.rank, s.count, s.each, s.sequence, s.offset) for s in sorted(steps, key=lambda s: (s.length, s.rank))], np.int64).reshape(-1, 6)
    span = np.int64(1) << np.int64(48)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length = batch.column(length_col).to_numpy(zero_copy_only=False)
            rank = batch.column(rank_col).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, length * span + rank, "right") - 1]
            within = rank - row[:, 1]
            sequence = row[:, 4] + within // row[:, 3]
            offset = row[:, 5] + (within % row[:, 3]) * length
            keep = [n for n in batch.schema.names if n != rank_col]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"]
            )

    return run


def ranked(rows: DataFrame, key: str, order: list[str], group_rows: int = RANK_GROUP) -> DataFrame:
    """``rank`` (from 0, gapless) of every row among the rows of its ``key``, without a
    task per key: rows are ranked inside hash groups of a key, and the groups' counts
    are summed before them."""
    total = rows.count()
    n = max(16, -(-total // group_rows))
    salted = rows.withColumn("_g", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = salted.groupBy(key, "_g").count()
    before = counts.select(
        F.col(key).alias("_k"), F.col("_g").alias("_h"),
        (F.sum("count").over(Window.partitionBy(key).orderBy("_g")) - F.col("count")).alias("_before"),
    )
    inner = salted.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_g").orderBy(*order)) - 1)
    return (
        inner.join(before, (F.col(key) == F.col("_k")) & (F.col("_g") == F.col("_h")))
        .withColumn("rank", (F.col("_r") + F.col("_before")).cast("long"))
        .drop("_g", "_k", "_h", "_r", "_before")
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset.

    Empty tables give no rows. Ties between pieces of one length are resolved by
    (doc_id, piece, start); repeated rows are packed as often as they occur."""
    spark: SparkSession = docs.sparkSession
    work = Workspace(spark, "pack")
    cut = work.save(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    # at most ``capacity`` rows, whatever the corpus
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    steps = best_fit_decreasing(counts, capacity)
    rows = ranked(cut, "length", ["doc_id", "piece", "ids_crc32"])
    schema = PIECE_SCHEMA + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    names = cut.columns + ["rank"]
    return rows.select(*names).mapInArrow(_place(steps, "length", "rank"), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences of ``pack(..., with_ids=True)``: sequence_id, length, input_ids
    (bytes of unsigned 32-bit ids, pieces in offset order)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    return packed.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("input_ids"),
    )
