"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are word sequences and an edit inserts, deletes or replaces one word. Two
lines are within one edit exactly if both are equal after the deletion of the
word at the same position (a replacement), or one is the other after the
deletion of one word. Every candidate line emits the hashed sequences without
each of its words, and its own; lines join where variants are equal, the deleted
positions verify the distance, and the earliest line of each join stays.

Equal lines are one class first, whatever their length: a line of any words that
equals an earlier one goes. Lines of at least ``MIN_WORDS`` words are compared
within the edit as well. Only classes that share their first or last half with
another class emit variants: one edit leaves a half untouched, so no pair is
lost. Joins keep minima per variant, never pairs of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import text as T
from ledgerline.llm.common import Workspace
from ledgerline.operators.ranking import global_rank

U = np.uint64
#: one edit in lines of at least five words is a similarity of 0.8 or more; shorter lines must be equal
MIN_WORDS = 5
_BASE = 0xD1342543DE82EF95
_INVERSE = U(pow(_BASE, -1, 2**64))
_LAST = (1 << 63) - 1


def split(run: T.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, line of each word, document of each line, number of each line in its document)."""
    start, end, _ = T.spans(run, ~T.SPACE)
    word = T.span_hashes(run.data, start, end)
    breaks = np.flatnonzero(run.data == 10) + 1
    # a line begins at a document's start and behind each of its line feeds
    owner = np.searchsorted(run.offsets, breaks - 1, "right") - 1
    places = np.concatenate([run.offsets[:-1] * 2, breaks * 2 - 1])
    docs = np.concatenate([np.arange(run.n), owner])
    order = np.lexsort((places, docs))
    docs, begins = docs[order], np.concatenate([run.offsets[:-1], breaks])[order]
    number = np.arange(len(docs)) - np.searchsorted(docs, docs, "left")
    # words of a document lie behind its lines' starts
    doc_of_word = np.searchsorted(run.offsets, start, "right") - 1
    span = np.int64(len(run.data) + 1)
    line = np.searchsorted(docs * span + begins, doc_of_word * span + start, "right") - 1
    return word, line, docs, number


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.r_[U(1), np.full(n, U(_BASE))], dtype=np.uint64)
    down = np.cumprod(np.r_[U(1), np.full(n, _INVERSE)], dtype=np.uint64)
    return up, down


class Sequences:
    """Hashes of word ranges of a run: every range is hashed as if it began at zero."""

    def __init__(self, word: np.ndarray):
        self.up, self.down = _powers(len(word))
        self.prefix = np.r_[U(0), np.cumsum(word * self.up[: len(word)], dtype=np.uint64)]

    def raw(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.prefix[b] - self.prefix[a]) * self.down[a]

    def hash(self, a: np.ndarray, b: np.ndarray, tag: int = 0) -> np.ndarray:
        return T.mix(self.raw(a, b) + (b - a + tag).astype(np.uint64) * U(0x9E3779B97F4A7C15))

    def without(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of the words a..b without the one at ``at``; equal to ``hash`` of the same words."""
        left, right = self.raw(a, at), self.raw(at + 1, b)
        return T.mix(left + right * self.up[at - a] + (b - a - 1).astype(np.uint64) * U(0x9E3779B97F4A7C15))


LINE_SCHEMA = "ord long, text_hash long, line int, h long, halves array<long>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = batch.column("ord").to_numpy(), batch.column("text_hash").to_numpy()
        for run in T.runs(batch.column("text")):
            word, line, docs, number = split(run)
            count = np.bincount(line, minlength=len(docs))
            first = np.cumsum(count) - count
            own = np.flatnonzero(count)
            a, n = first[own], count[own]
            long = n >= MIN_WORDS
            seq = Sequences(word)
            halves = np.empty((len(own), 4), np.uint64)
            # pairs whose longer line has n words, or n + 1: one of the halves around the edit is equal
            for i, size in enumerate((n, n + 1)):
                cut = np.minimum((size - 1) // 2, n)
                halves[:, 2 * i] = T.mix(seq.hash(a, a + cut, 101) + size.astype(np.uint64))
                halves[:, 2 * i + 1] = T.mix(seq.hash(a + n - (size - 1 - cut), a + n, 202) + size.astype(np.uint64))
            doc = docs[own] + run.first
            # short lines have no halves to share
            cut = pa.array(np.r_[0, np.cumsum(long)].astype(np.int32) * 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc]), pa.array(hashes[doc]), pa.array(number[own].astype(np.int32)), pa.array(seq.hash(a, a + n).view(np.int64)),
                 pa.ListArray.from_arrays(cut, pa.array(halves[long].reshape(-1).view(np.int64)))],
                ["ord", "text_hash", "line", "h", "halves"],
            )


VARIANT_SCHEMA = "key long, at int, place long"


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The variants of the lines that ``wanted`` lists per document."""
    for batch in batches:
        wanted = batch.column("wanted")
        for run in T.runs(batch.column("text")):
            word, line, docs, number = split(run)
            count = np.bincount(line, minlength=len(docs))
            first = np.cumsum(count) - count
            base = np.searchsorted(docs, np.arange(run.n), "left")
            here = wanted.slice(run.first, run.n)
            per = np.diff(np.array(here.offsets))
            flat = here.flatten()
            at_line, h, place = (flat.field(c).to_numpy() for c in ("line", "h", "place"))
            doc = np.repeat(np.arange(run.n), per)
            known = at_line < np.diff(np.r_[base, len(docs)])[doc]
            doc, at_line, h, place = doc[known], at_line[known], h[known], place[known]
            own = base[doc] + at_line
            a, n = first[own], count[own]
            seq = Sequences(word)
            # a row with the same id and another text
            same = seq.hash(a, a + n).view(np.int64) == h
            place, a, n = place[same], a[same], n[same]
            step = 200_000
            bounds = np.cumsum(n + 1)
            i = 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(bounds, (bounds[i - 1] if i else 0) + step, "right")))
                s = slice(i, j)
                at = T.concat_ranges(np.zeros(j - i, np.int64), n[s])
                rep = np.repeat(np.arange(i, j), n[s])
                gone = seq.without(a[rep], a[rep] + n[rep], a[rep] + at)
                key = np.r_[seq.hash(a[s], a[s] + n[s]), gone].view(np.int64)
                row = np.r_[np.arange(i, j), rep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.r_[np.full(j - i, -1), at].astype(np.int32)), pa.array(place[row])], ["key", "at", "place"],
                )
                i = j


def _order(doc_id: Column) -> Column:
    """Documents without an id come last."""
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def repeated_lines(docs: DataFrame, work: Workspace) -> DataFrame:
    """ord, text_hash, lines: for every document (by id and text) the numbers of its lines, from 0,
    that equal an earlier line or are within one edit of one, in (doc_id, line) order."""
    rows = docs.select(_order(F.col("doc_id")).alias("ord"), _text().alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    place = F.struct("ord", "line")
    classes = work.save(rows.mapInArrow(_lines, LINE_SCHEMA).groupBy("h").agg(F.min(place).alias("own"), F.first("halves").alias("halves")), "classes")
    halves = classes.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    candidates = classes.join(halves.join(shared, "half").select("h").distinct(), "h").select("h", F.col("own.ord").alias("ord"), F.col("own.line").alias("line"))
    # one number per candidate, in the order of first places: variants carry it alone
    candidates = work.save(global_rank(candidates, ["ord", "line", "h"], "place"), "candidates")
    wanted = candidates.groupBy("ord").agg(F.collect_list(F.struct("line", "h", "place")).alias("wanted"))
    variants = work.save(rows.join(wanted, "ord").select("text", "wanted").mapInArrow(_variants, VARIANT_SCHEMA), "variants")
    whole, less = F.col("at") < 0, F.col("at") >= 0
    # by variant: the earliest line that is it, and the earliest that becomes it
    by_key = variants.groupBy("key").agg(F.min(F.when(whole, F.col("place"))).alias("line_is"), F.min(F.when(less, F.col("place"))).alias("becomes")).filter("line_is is not null and becomes is not null")
    indel = variants.join(by_key, "key").select("place", F.when(F.col("at") < 0, F.col("becomes")).otherwise(F.col("line_is")).alias("near"))
    # by variant and position: lines that differ in the word there
    by_place = variants.filter(less).groupBy("key", "at").agg(F.min("place").alias("near"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "at", "near")
    swap = variants.join(by_place, ["key", "at"]).select("place", "near")
    earliest = indel.unionByName(swap).filter("near < place").groupBy("place").agg(F.min("near").alias("near"))
    # numbers of one place (rows that share an id) are not earlier than each other
    other = candidates.select(F.col("place").alias("near"), F.struct("ord", "line").alias("near_own"))
    late = earliest.join(candidates, "place").join(other, "near").filter(F.col("near_own") < F.struct("ord", "line")).select("h", F.lit(True).alias("late"))
    near = classes.select("h", "own").join(late, "h", "left")
    # hashed again rather than kept: a second scan takes less than a table of all lines
    lines = rows.mapInArrow(_lines, LINE_SCHEMA).select("ord", "text_hash", "line", "h")
    marked = lines.join(near, "h").filter(F.coalesce("late", F.lit(False)) | (F.struct("ord", "line") > F.col("own")))
    found = work.save(marked.groupBy("ord", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("lines")), "repeated")
    for name in ("classes", "candidates", "variants"):
        work.drop(name)
    return found


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0, comma-separated) of every document.

    A null text is one empty line. Repeated rows of a document have the same place, so
    the same lines stay in all of them."""
    slim = docs.select("doc_id", _text().alias("text"))
    work = Workspace(docs.sparkSession, "lines")
    found = repeated_lines(slim, work)
    rows = slim.select(F.col("doc_id").cast("long").alias("doc_id"), _order(F.col("doc_id")).alias("ord"), F.xxhash64("text").alias("text_hash"), (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"))
    return rows.join(found, ["ord", "text_hash"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("lines").cast("array<string>"), ","), F.lit("")).alias("removed")
    )


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines whose numbers ``gone`` lists."""
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(gone, i))
    return F.array_join(kept, "\n")


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines, with all its columns, whatever their names (``n_chars``
    follows the text).

    A document that loses all its words is a copy of earlier lines and goes; texts that lose no
    line stay as they are, null and empty ones included. Documents without an id come last in the
    order of lines; rows that repeat id and text have the same place, so the same lines stay in
    all of them; an empty table stays empty."""
    work = Workspace(docs.sparkSession, "lines")
    found = repeated_lines(docs, work).withColumnsRenamed({"ord": "o", "text_hash": "t", "lines": "gone"})
    # the rows travel as one struct, so no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _order(F.col("doc_id")).alias("ord"), F.xxhash64(_text()).alias("text_hash"), _text().alias("text"))
    joined = rows.join(found, (F.col("ord") == F.col("o")) & (F.col("text_hash") == F.col("t")), "left")
    changed = F.col("gone").isNotNull()
    left = joined.withColumn("text", F.when(changed, _without(F.col("text"), F.col("gone"))).otherwise(F.col("text")))
    left = left.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    own = lambda c: F.col("row").getField(c)
    new = {"text": F.when(changed, F.col("text")).otherwise(own("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return left.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])


#: DuckDB SQL for :func:`report` over ``documents``
SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(doc_id, {_LAST}) AS ord, coalesce(text, '') AS text FROM documents),
     cut AS (SELECT DISTINCT ord, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM docs),
     seqs AS (SELECT ord, text, no, list_filter(regexp_split_to_array(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM cut),
     line AS (SELECT * FROM seqs WHERE len(w) >= 1),
     class AS (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w, min((ord, no)) AS own FROM line GROUP BY 1),
     long AS (SELECT * FROM class WHERE len(w) >= {MIN_WORDS}),
     gone AS (SELECT s, own, unnest(range(1, len(w) + 1)) AS i, w FROM long),
     less AS (SELECT s, own, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') AS v FROM gone),
     near AS (SELECT a.s, min(b.own) AS own FROM less a JOIN less b ON a.v = b.v AND a.i = b.i GROUP BY 1
              UNION ALL SELECT a.s, min(b.own) FROM less a JOIN long b ON a.v = b.s GROUP BY 1
              UNION ALL SELECT b.s, min(a.own) FROM less a JOIN long b ON a.v = b.s GROUP BY 1),
     late AS (SELECT c.s, min(least(c.own, n.own)) AS own, min(n.own) < any_value(c.own) AS near FROM class c LEFT JOIN near n USING (s) GROUP BY 1),
     marked AS (SELECT DISTINCT l.ord, l.text, l.no FROM line l JOIN late x ON array_to_string(l.w, ' ') = x.s WHERE x.near OR (l.ord, l.no) > x.own),
     found AS (SELECT ord, text, count(*) AS n, string_agg(no::VARCHAR, ',' ORDER BY no) AS removed FROM marked GROUP BY ALL)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines, coalesce(f.n, 0) AS n_removed, coalesce(f.removed, '') AS removed
FROM docs d LEFT JOIN found f ON d.ord = f.ord AND d.text = f.text
"""
