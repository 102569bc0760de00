"""Repeated byte strings by longest-previous-factor arrays, distributed by anchors.

A string of ``length`` bytes that occurs twice has the same smallest 64-byte gram
(by hash) in both places. These anchors, about one per 170 bytes, carry a hash of
the bytes around them (all strings of ``length`` bytes that hold the anchor lie
there). Surroundings that occur twice are repeated as a whole. Where an anchor
has different surroundings, one copy of each is fetched and the anchor's group
is searched with a suffix array: in suffix order, the previous and the next
smaller text position give every position's longest earlier match.

An anchor with very many different surroundings is searched by cores instead:
ranges of its strings share a core, and only ranges whose cores repeat with
other borders are compared string by string, as equal hashes of all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import text as T
from ledgerline.llm.common import Workspace

U = np.uint64
LENGTH, GRAM = 400, 64
#: groups of more surroundings are searched by cores, of this many strings each
MAX_GROUP, CORE_STRINGS = 512, 24
#: bytes by which suffixes are ranked first
WORD = 8
#: surroundings in one suffix array, in bytes
ARRAY_BYTES = 1 << 20
_LAST = (1 << 63) - 1
_NONE = np.iinfo(np.uint64).max


class Hashes:
    """Hashes of byte ranges of a run."""

    def __init__(self, data: np.ndarray):
        T._grow(len(data))
        values = T._BYTE_VALUES[data] * T._powers[: len(data)]
        self.prefix = np.r_[U(0), np.cumsum(values, dtype=np.uint64)]

    def grams(self, n: int) -> np.ndarray:
        """:meth:`of` every ``n`` bytes in a row."""
        m = len(self.prefix) - n
        return T.mix((self.prefix[n:] - self.prefix[:m]) * T._inverses[:m] + U(n * 0xD6E8FEB86659FD93 % 2**64))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return T.mix((self.prefix[b] - self.prefix[a]) * T._inverses[a] + (b - a).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill) -> np.ndarray:
    """op over every window x[i : i + w] (block prefixes and suffixes)."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, fill, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = op.accumulate(grid, axis=1).reshape(-1)
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = n - w + 1
    return op(back[:m], ahead[w - 1 : w - 1 + m])


def anchors(run: T.Run, length: int = LENGTH, gram: int = GRAM, hashes: Hashes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the run, hash, bytes before, bytes behind, hash of the surroundings) of the anchors."""
    none = np.zeros(0, np.int64)
    size = np.diff(run.offsets)
    w = length - gram + 1
    if len(run.data) < length or not (size >= length).any():
        return none, none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    hashes = hashes or Hashes(run.data)
    m = len(run.data) - gram + 1
    h = hashes.grams(gram)
    # grams that cross a text's end
    inside = np.ones(m, bool)
    cross = np.minimum(size, gram - 1)
    late = T.concat_ranges(run.offsets[1:] - cross, cross)
    inside[late[late < m]] = False
    h[~inside] = _NONE
    least = _sliding(h, w, np.minimum, _NONE)
    # a gram is an anchor if it is the least of some window of grams that holds it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    place = np.flatnonzero((_sliding(padded, w, np.maximum, U(0)) == h) & inside)
    doc = np.searchsorted(run.offsets, place, "right") - 1
    keep = size[doc] >= length
    place, doc = place[keep], doc[keep]
    before = np.minimum(place - run.offsets[doc], length - gram)
    behind = np.minimum(run.offsets[doc + 1] - place - gram, length - gram)
    around = T.mix(hashes.of(place - before, place + gram + behind) + before.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return doc, place, h[place], before, behind, around


OCCURRENCE_SCHEMA = "around long, left long, right long, ord long, text_hash long, pos int"


def _occurrences(length: int):
    """Every anchor: its surroundings, and the two cores of which each string of ``length`` bytes
    that holds the anchor holds one (0 where a text's border leaves no such string)."""
    half = (length - GRAM) // 2

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("ord").to_numpy(), batch.column("text_hash").to_numpy()
            for run in T.runs(batch.column("text")):
                hashes = Hashes(run.data) if (np.diff(run.offsets) >= length).any() else None
                doc, place, _, before, behind, around = anchors(run, length, hashes=hashes)
                left, right = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)
                if len(doc):
                    ok = before >= half
                    left[ok] = T.mix(hashes.of(place[ok] - half, place[ok] + GRAM) + U(1)) | U(1)
                    ok = behind >= half
                    right[ok] = T.mix(hashes.of(place[ok], place[ok] + GRAM + half) + U(2)) | U(1)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (around, left, right)), pa.array(ids[run.first + doc]), pa.array(texts[run.first + doc]), pa.array((place - run.offsets[doc]).astype(np.int32))],
                    ["around", "left", "right", "ord", "text_hash", "pos"],
                )

    return run_


CONTEXT_SCHEMA = "h long, ord long, text_hash long, pos int, before int, bytes binary"


def _contexts(length: int):
    """The bytes around the wanted anchors of each document, and the anchor's hash."""
    schema = pa.schema([("h", pa.int64()), ("ord", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("bytes", pa.binary())])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, th, text, wanted in zip(batch.column("ord").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                at = np.array(wanted, np.int64)
                h = Hashes(np.frombuffer(raw, np.uint8)).of(at, at + GRAM).view(np.int64)
                reach = length - GRAM
                for i in range(0, len(at), 2000):
                    here = at[i : i + 2000]
                    columns = [
                        h[i : i + 2000], np.full(len(here), doc), np.full(len(here), th), here.astype(np.int32), np.minimum(here, reach).astype(np.int32),
                        [raw[max(0, p - reach) : p + length] for p in wanted[i : i + 2000]],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run_


# ------------------------------------------------------------ suffix arrays
def previous_factors(segments: list[bytes], groups: list[int], cap: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the segments, LPF, source) over the concatenated segments.

    LPF[i] is the length, up to ``cap``, of the longest match of the suffix at i with one
    that begins earlier in the same group (a match ends at its segment's end); source[i]
    is that earlier place, -1 without a match of a byte. A match of less than ``least`` bytes
    may count as none (it is not measured). Suffixes are ranked by their first
    eight bytes, then by prefix doubling; a suffix whose rank is its own is left alone. In
    suffix order the nearest smaller places on both sides are the best."""
    offsets = np.r_[0, np.cumsum([len(s) + 1 for s in segments])].astype(np.int64)
    n = int(offsets[-1])
    symbol = np.zeros(n + cap + 2 * WORD, np.int32)
    for i, s in enumerate(segments):
        symbol[offsets[i] : offsets[i + 1] - 1] = np.frombuffer(s, np.uint8).astype(np.int32) + 1
        symbol[offsets[i + 1] - 1] = 257 + i  # ends match nothing
    ranks, shared = _ranked(symbol, offsets, np.asarray(groups, np.int64), n, cap)
    # where only whole matches count, suffixes of a rank of their own have none
    some = np.sort(shared) if least >= cap else np.arange(n)
    place = some[np.argsort(ranks[-1][1][some], kind="stable")]
    best, source = np.zeros(n, np.int64), np.full(n, -1)
    owner = np.repeat(np.asarray(groups, np.int64), np.diff(offsets))
    for line in (place, place[::-1]):
        near = _nearest_smaller(line)
        has = near >= 0
        i, j = line[has], line[near[has]]
        same = owner[i] == owner[j]
        i, j = i[same], j[same]
        match = _common(ranks, symbol, i, j, n, cap, least)
        better = (match > best[i]) | ((match == best[i]) & (match > 0) & (j < source[i]))
        best[i[better]], source[i[better]] = match[better], j[better]
    return offsets, best, source


def _ranked(symbol: np.ndarray, offsets: np.ndarray, groups: np.ndarray, n: int, cap: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(length, rank of every place by its group and that many symbols) for the doubled lengths
    up to ``cap``, and the places that share their last rank. A rank is the number of places before its class, so classes are refined in
    place: only places that share their class are sorted again. Place n stands for the end."""
    word = min(WORD, cap)
    key = np.zeros(n, np.uint64)
    # an end counts as the largest byte; places whose word holds one are told apart below
    byte = np.clip(symbol[: n + word] - 1, 0, 255).astype(np.uint64)
    for d in range(word):
        key = (key << U(8)) | byte[d : d + n]
    ends = offsets[1:] - 1
    cross = np.zeros(n, bool)
    cross[T.concat_ranges(np.maximum(ends - word + 1, offsets[:-1]), np.minimum(word, np.diff(offsets)))] = True
    owner = np.repeat(groups, np.diff(offsets))
    order = np.argsort(key)
    if (symbol[:n] == 256).any():
        # a byte of that value is not an end: whole words go first among equal ones
        order = np.lexsort((cross, key))
    order = order[np.argsort(owner[order].astype(np.uint16 if groups.max(initial=0) < 1 << 16 else np.int64), kind="stable")]
    k, o, c = key[order], owner[order], cross[order]
    new = np.ones(n, bool)
    # a place whose word crosses an end equals no other
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1]) | c[1:] | c[:-1]
    start = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    rank[n] = -1
    ranks, size = [(word, rank)], word
    single = np.diff(np.r_[start, n]) == 1
    active = order[np.repeat(~single, np.diff(np.r_[start, n]))]
    while size < cap:
        move = min(size, cap - size)
        rank = rank.copy()
        if len(active):
            own, follow = rank[active], rank[np.minimum(active + move, n)]
            by = np.argsort(own * np.int64(n + 2) + follow + 1)
            at, own, follow = active[by], own[by], follow[by]
            first = np.r_[True, own[1:] != own[:-1]]
            new = first | np.r_[True, follow[1:] != follow[:-1]]
            start = np.flatnonzero(new)
            # members of a class lie in a row: its rank plus the members before
            head = np.flatnonzero(first)
            before = np.arange(len(at)) - np.repeat(head, np.diff(np.r_[head, len(at)]))
            count = np.diff(np.r_[start, len(at)])
            rank[at] = np.repeat(own[start] + before[start], count)
            active = at[np.repeat(count > 1, count)]
        size += move
        ranks.append((size, rank))
    return ranks, active


def _nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest element before each that is smaller, -1 without one (pointer jumping)."""
    near = np.arange(-1, len(x) - 1)
    open_ = np.flatnonzero(near >= 0)
    open_ = open_[x[near[open_]] > x[open_]]
    while len(open_):
        # what is not smaller than the pointer's target cannot be nearer than the target's own pointer
        near[open_] = near[near[open_]]
        open_ = open_[near[open_] >= 0]
        open_ = open_[x[near[open_]] > x[open_]]
    return near


def _common(ranks: list[tuple[int, np.ndarray]], symbol: np.ndarray, i: np.ndarray, j: np.ndarray, n: int, cap: int, least: int) -> np.ndarray:
    """Common prefix of the suffixes at i and j of one group, up to ``cap``: by the ranks of doubled
    prefixes, then symbol by symbol for what is shorter than the first of them."""
    out = np.zeros(len(i), np.int64)
    full = ranks[-1][1][i] == ranks[-1][1][j]
    out[full] = cap
    if least >= cap:
        return out
    at = np.flatnonzero(~full)
    for size, rank in reversed(ranks[:-1]):
        a, b = i[at] + out[at], j[at] + out[at]
        ok = (a < n) & (b < n)
        ok[ok] = rank[a[ok]] == rank[b[ok]]
        out[at[ok]] += size
    for _ in range(ranks[0][0]):
        at = at[symbol[i[at] + out[at]] == symbol[j[at] + out[at]]]
        if not len(at):
            break
        out[at] += 1
    return np.minimum(out, cap)


SPAN_SCHEMA = "ord long, text_hash long, start long, stop long"


def _spans_of(flag: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by strings of ``length`` bytes that begin at the flagged places."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.r_[True, at[1:] > at[:-1] + length]
    first = np.flatnonzero(new)
    return at[first], at[np.r_[first[1:] - 1, len(at) - 1]] + length


def _search(length: int, keep_first: bool):
    def run_(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("h", "ord", "text_hash", "pos", "before")]
        anchor, doc, text, pos, before = columns
        order = np.lexsort((pos, text, doc, anchor))
        # a repeated row brings its anchors again
        if len(order):
            again = np.r_[False, np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in (anchor, doc, text, pos)])]
            order = order[~again]
        anchor, doc, text, pos, before = (c[order].tolist() for c in columns)
        raw = table.column("bytes").combine_chunks().take(pa.array(order)).to_pylist() if len(order) else []
        # surroundings that overlap in a text are one segment: every place occurs once in a group
        segments: list[bytearray] = []
        origin: list[tuple[int, int, int]] = []
        groups: list[int] = []
        last = None
        for h, d, t, p, b, data in zip(anchor, doc, text, pos, before, raw, strict=True):
            key, start = (h, d, t), p - b
            if key == last and start <= origin[-1][2] + len(segments[-1]):
                have = origin[-1][2] + len(segments[-1]) - start
                segments[-1] += data[have:]
            else:
                groups.append(groups[-1] + (last[0] != h) if groups else 0)
                segments.append(bytearray(data))
                origin.append((d, t, start))
                last = key
        offsets, best, source = previous_factors([bytes(s) for s in segments], groups, length, length)
        flag = best >= length
        if not keep_first:
            flag[source[flag]] = True
        out: dict[str, list] = {"ord": [], "text_hash": [], "start": [], "stop": []}
        for (doc, th, start), a, b in zip(origin, offsets, offsets[1:], strict=False):
            for x, y in zip(*_spans_of(flag[a:b], length), strict=True):
                for k, v in zip(out, (doc, th, start + int(x), start + int(y)), strict=True):
                    out[k].append(v)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run_


def _context_run(batch: pa.RecordBatch) -> Iterator[tuple[T.Run, np.ndarray]]:
    for run in T.runs(batch.column("bytes")):
        yield run, np.arange(run.first, run.first + run.n)


STRING_SCHEMA = "key long, whole long, ord long, text_hash long, start long, stop long"


def _cores(length: int):
    """For hot anchors: per range of its strings, the hash of the core that all of them hold
    and of all the bytes that they cover."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = np.arange(0, length - GRAM + 1, CORE_STRINGS)
        for batch in batches:
            anchor, doc, th, pos, before = (batch.column(c).to_numpy() for c in ("h", "ord", "text_hash", "pos", "before"))
            for run, row in _context_run(batch):
                hashes = Hashes(run.data)
                size = np.diff(run.offsets)
                for r in ranges:
                    # strings that begin ``shift`` bytes before the anchor, shift in (low, high]
                    high, low = length - GRAM - r, max(length - GRAM - r - CORE_STRINGS, -1)
                    first = np.maximum(before[row] - high, 0)
                    final = np.minimum(before[row] - (low + 1), size - length)
                    ok = final >= first
                    a, f, z = run.offsets[:-1][ok], first[ok], final[ok]
                    # texts' borders shorten a range: it is named by its strings' shifts
                    name = (before[row][ok] - f).astype(np.uint64) * U(4096) + (before[row][ok] - z).astype(np.uint64)
                    # from the last string's start to the first one's end: in any text that has a string of the range
                    edge = a + before[row][ok]
                    core = T.mix(hashes.of(edge - (low + 1), edge - high + length) ^ T.mix(anchor[row][ok].view(np.uint64) + U(int(r))))
                    whole = T.mix(hashes.of(a + f, a + z + length) ^ T.mix(name + U(1)))
                    start = pos[row][ok] - before[row][ok]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc[row][ok]), pa.array(th[row][ok]), pa.array((start + f).astype(np.int64)), pa.array((start + z + length).astype(np.int64))],
                        ["key", "whole", "ord", "text_hash", "start", "stop"],
                    )

    return run_


def _strings(length: int):
    """Every string of the listed ranges of a text: its hash and place."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = batch.column("ord").to_numpy(), batch.column("text_hash").to_numpy()
            for text, d, t, wanted in zip(batch.column("text"), doc, th, batch.column("wanted").to_pylist(), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                hashes = Hashes(data)
                flag = np.zeros(len(data) + 1, np.int64)
                for x in wanted:
                    flag[x["start"]] += 1
                    flag[x["stop"] - length + 1] -= 1
                at = np.flatnonzero(np.cumsum(flag) > 0)
                for i in range(0, len(at), 100_000):
                    a = at[i : i + 100_000]
                    key = hashes.of(a, a + length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(a), d)), pa.array(np.full(len(a), t)), pa.array(a)], ["key", "ord", "text_hash", "start"]
                    )

    return run_


# ----------------------------------------------------------------- operator
def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _order(F.col("doc_id")).alias("ord"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def repeated_spans(rows: DataFrame, work: Workspace, length: int = LENGTH, keep_first: bool = True) -> DataFrame:
    """ord, text_hash, spans (start, stop) of the bytes to remove: those of strings of ``length``
    bytes that begin somewhere else too (``keep_first``: that begin earlier, in order of
    document and place). ``rows`` as of :func:`_rows`."""
    found = work.save(rows.select("ord", "text_hash", "text").mapInArrow(_occurrences(length), OCCURRENCE_SCHEMA), "occurrences")
    place = F.struct("ord", "text_hash", "pos")
    kinds = work.save(
        found.groupBy("around").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"), F.first("left").alias("left"), F.first("right").alias("right")), "kinds"
    )
    whole = found.select("around", "ord", "text_hash", "pos").join(kinds.filter("times > 1").select("around", "first"), "around")
    if keep_first:
        whole = whole.filter(place != F.col("first"))
    reach = length - GRAM
    # a span may end behind a short text; it is cut when it is applied
    whole = work.save(
        whole.select("ord", "text_hash", F.greatest(F.col("pos") - reach, F.lit(0)).cast("long").alias("start"), (F.col("pos") + length).cast("long").alias("stop")), "whole"
    )
    work.drop("occurrences")
    # surroundings that share a core with others, but not all: one copy of each
    cores = kinds.select("around", F.explode(F.array("left", "right")).alias("core")).filter("core <> 0")
    shared = cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    mixed = cores.join(shared, "core").select("around").distinct()
    wanted = kinds.join(mixed, "around").groupBy(F.col("first.ord").alias("ord"), F.col("first.text_hash").alias("text_hash")).agg(F.collect_set("first.pos").alias("wanted"))
    # rows that repeat have the same bytes: one of them
    contexts = work.save(
        rows.select("ord", "text_hash", "text").join(wanted, ["ord", "text_hash"]).mapInArrow(_contexts(length), CONTEXT_SCHEMA), "contexts"
    )
    work.drop("kinds")
    groups = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("bytes")).alias("size"))
    groups = work.save(groups, "groups")
    total = groups.filter(F.col("n") <= MAX_GROUP).agg(F.sum("size")).first()[0] or 0
    arrays = max(64, -(-total // ARRAY_BYTES))
    large = groups.filter(F.col("n") > MAX_GROUP).select("h")
    cold = contexts.join(large, "h", "left_anti").withColumn("array", F.pmod(F.xxhash64("h"), F.lit(arrays)))
    some = work.save(cold.groupBy("array").applyInArrow(_search(length, keep_first), SPAN_SCHEMA), "cold")
    hot = work.save(_hot_spans(contexts.join(large, "h"), rows, work, length, keep_first), "hot")
    for name in ("contexts", "cores", "core_kinds", "strings"):
        work.drop(name)
    spans = whole.unionByName(some).unionByName(hot)
    return work.save(spans.groupBy("ord", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")


def _hot_spans(contexts: DataFrame, rows: DataFrame, work: Workspace, length: int, keep_first: bool) -> DataFrame:
    cores = work.save(contexts.mapInArrow(_cores(length), STRING_SCHEMA).distinct(), "cores")
    place = F.struct("ord", "text_hash", "start", "stop")
    equal = cores.groupBy("key", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"))
    equal = work.save(equal, "core_kinds")
    whole = cores.join(equal.filter("times > 1").select("key", "whole", "first"), ["key", "whole"])
    if keep_first:
        whole = whole.filter(place != F.col("first"))
    whole = whole.select("ord", "text_hash", "start", "stop")
    mixed = equal.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("key")
    wanted = equal.join(mixed, "key").select("first.*").groupBy("ord", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("wanted"))
    # equal rows give equal strings: distinct places are counted
    strings = rows.select("ord", "text_hash", "text").join(wanted, ["ord", "text_hash"]).mapInArrow(_strings(length), "key long, ord long, text_hash long, start long")
    strings = work.save(strings, "strings")
    where = F.struct("ord", "text_hash", "start")
    twice = strings.groupBy("key").agg(F.min(where).alias("low"), F.max(where).alias("high")).filter("low <> high").select("key", "low")
    hit = strings.join(twice, "key")
    if keep_first:
        hit = hit.filter(where != F.col("low"))
    return whole.unionByName(hit.select("ord", "text_hash", "start", (F.col("start") + length).alias("stop")).distinct())


def _merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(spans or [], key=lambda s: s["start"]):
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out


def _digest(with_text: bool):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone = [(a, min(b, len(raw))) for a, b in _merge(spans)]
                at, kept = 0, []
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append({"doc_id": doc, "n_bytes": len(raw), "n_removed": len(raw) - len(rest), "n_spans": len(gone), "kept_sha256": hashlib.sha256(rest).hexdigest(), **({"kept": rest} if with_text else {})})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run_


def deduplicate(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept] of every document.

    ``keep_first``: later copies of strings of ``length`` bytes go, in order of document id
    and place; else all copies go. A null text is empty; documents without an id come
    last; rows that repeat keep the same bytes, those of the first place (``keep_first``)
    or none (else), because each row counts as a place of its own."""
    work = Workspace(docs.sparkSession, "suffixes")
    rows = _rows(docs)
    spans = repeated_spans(rows, work, length, keep_first)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return rows.join(spans, ["ord", "text_hash"], "left").select("doc_id", "text", "spans").mapInArrow(_digest(with_text), schema)
