"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

SuperMinHash gives every shingle one random permutation of the signature's
positions; in round j each shingle writes its random value plus j to the
position that its permutation has at j. Signatures are complete as soon as all
positions hold a value below the next round, usually after one or two rounds.

Documents with equal shingle sets form a class first, so a group of copies is
one node. Classes that share a band go to a bucket; every member of a bucket is
verified on the full sets against the bucket's first class (a star, not all
pairs). Members that are then in another group than their star's centre are
compared with the star's other members, in blocks and through what sets each
apart from the centre, so no link that could join two groups goes unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import graph
from ledgerline.llm import text as T
from ledgerline.llm.common import Workspace, texts

U = np.uint64
#: signature positions: BANDS bands of ROWS; a pair of similarity 0.8 is missed with probability 4e-6
BANDS, ROWS = 24, 4
SIGNATURE = BANDS * ROWS
#: pairs of one document that are verified together at most before its set is copied to another task
STAR_BLOCK = 64
#: members of a star that are compared in one task: by number and by bytes of what sets them apart
BLOCK_MEMBERS, BLOCK_BYTES = 2048, 16 << 20

_WORD_FACTORS = (np.random.default_rng(77).integers(1, 2**62, 64, dtype=np.int64).astype(np.uint64) << U(1)) | U(1)
_ROUND_SEEDS = np.random.default_rng(78).integers(1, 2**62, SIGNATURE, dtype=np.int64).astype(np.uint64)
_ROW_FACTORS = (np.random.default_rng(79).integers(1, 2**62, ROWS, dtype=np.int64).astype(np.uint64) << U(1)) | U(1)


def shingle_sets(run: T.Run, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, document) by document. A text of fewer than ``k``
    words has its whole word sequence as its one shingle, a text without words none."""
    word, doc = T.words(run)
    n = len(word)
    size = np.bincount(doc, minlength=run.n)
    first = np.cumsum(size) - size
    full = max(n - k + 1, 0)
    h = np.zeros(full, np.uint64)
    for j in range(k):
        h += word[j : j + full] * _WORD_FACTORS[j]
    whole = doc[:full] == doc[k - 1 : k - 1 + full] if full else np.zeros(0, bool)
    keys, docs = T.mix(h[whole]), doc[:full][whole]
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = size[short] > j
            own[has] += word[first[short[has]] + j] * _WORD_FACTORS[j]
        keys = np.concatenate([keys, T.mix(own + size[short].astype(np.uint64))])
        docs = np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    if len(keys):
        new = np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]
        keys, docs = keys[new], docs[new]
    return keys, docs


def superminhash(keys: np.ndarray, docs: np.ndarray, n: int, m: int = SIGNATURE) -> np.ndarray:
    """(n, m) signatures; a document without elements has infinite values."""
    out = np.full(n * m, np.inf)
    permutation = None
    for j in range(m):
        if not len(keys):
            break
        bits = T.mix(keys ^ _ROUND_SEEDS[j])
        value = (bits >> U(11)) * 2.0**-53 + j
        pick = j + (T.mix(bits) % U(m - j)).astype(np.int64)
        if permutation is None:
            place = pick
        else:
            rows = np.arange(len(keys))
            place = permutation[rows, pick].astype(np.int64)
            permutation[rows, pick] = permutation[rows, j]
            permutation[rows, j] = place
        np.minimum.at(out, docs * m + place, value)
        # complete: no later round can write less
        go = (out.reshape(n, m).max(axis=1) >= j + 1)[docs]
        if permutation is None:
            if go.any():
                permutation = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (int(go.sum()), 1))
                rows = np.arange(len(permutation))
                permutation[rows, pick[go]] = 0
                permutation[rows, 0] = pick[go]
        elif not go.all():
            permutation = permutation[go]
        if not go.all():
            keys, docs = keys[go], docs[go]
    return out.reshape(n, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; equal keys mean an equal band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    return T.mix((bits * _ROW_FACTORS).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


SIGNED_SCHEMA = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def _sign(k: int):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for run in T.runs(batch.column("text")):
                keys, docs = shingle_sets(run, k)
                size = np.bincount(docs, minlength=run.n)
                some = np.flatnonzero(size)
                digest = np.zeros((2, run.n), np.uint64)
                if len(some):
                    first = (np.cumsum(size) - size)[some]
                    digest[0, some] = np.add.reduceat(T.mix(keys ^ U(0xA5A5A5A5)), first)
                    digest[1, some] = np.add.reduceat(T.mix(keys ^ U(0x5C5C5C5C5C5C5C5C)), first)
                bands = band_keys(superminhash(keys, docs, run.n)[some])
                ends = np.zeros(run.n + 1, np.int32)
                ends[some + 1] = BANDS
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(run.first, run.n), pa.array(size.astype(np.int64)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(bands.reshape(-1).view(np.int64)))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run_


def _sets(k: int):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for run in T.runs(batch.column("text")):
                keys, docs = shingle_sets(run, k)
                cut = (T.doc_bounds(docs, run.n) * 8).astype(np.int64)
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), run.n, [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(keys.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.slice(run.first, run.n), blob.cast(pa.binary())], ["doc_id", "keys"])

    return run_


STAR_SCHEMA = "a long, b long, size_a long, size_b long, linked boolean, delta binary"


def _compare(threshold: int):
    """Per pair: whether it is linked on the full sets, and the elements that only one of both has."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, linked, delta = [], [], []
            for x, y in zip(batch.column("ka"), batch.column("kb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                one = np.setxor1d(x, y, assume_unique=True)
                common, union = (len(x) + len(y) - len(one)) // 2, (len(x) + len(y) + len(one)) // 2
                sizes.append((len(x), len(y)))
                linked.append(100 * common >= threshold * union)
                delta.append(one.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array([s[0] for s in sizes], pa.int64()), pa.array([s[1] for s in sizes], pa.int64()), pa.array(linked, pa.bool_()), pa.array(delta, pa.binary())],
                ["a", "b", "size_a", "size_b", "linked", "delta"],
            )

    return run_


def _compared(pairs: DataFrame, docs: DataFrame, k: int, threshold: int, work: Workspace) -> DataFrame:
    """STAR_SCHEMA rows of the pairs (a, b): their full shingle sets compared."""
    pairs = work.save(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # the joins with texts and sets shuffle at every size: how many documents have a partner is not known to be small
    sets = work.save(docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, keys binary"), "sets")
    # the set of a star's centre goes to as many tasks as its pairs need
    spread = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / STAR_BLOCK) + 1).cast("int").alias("copies"))
    left = pairs.join(spread, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).select("a", "b", "copy")
    centre = (
        sets.join(spread, F.col("doc_id") == F.col("a")).select(F.col("doc_id").alias("a"), F.col("keys").alias("ka"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    )
    member = sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("kb"))
    return left.join(member.hint("merge"), "b").join(centre.hint("merge"), ["a", "copy"]).select("a", "b", "ka", "kb").mapInArrow(_compare(threshold), STAR_SCHEMA)


def _straggler_links(threshold: int):
    """Links of members that are apart from their star's centre, inside one block or between two.

    With D the elements that only one of a member and the centre has, the sets of two
    members differ in |Dx| + |Dy| - 2 |Dx and Dy| elements, so the test is exact without
    the full sets. A pivot that joins the centre's group needs no further test."""

    def run_(table: pa.Table) -> pa.Table:
        node, group, main = (table.column(c).to_numpy() for c in ("node", "group", "main"))
        size, side = table.column("size").to_numpy(), table.column("side").to_numpy()
        first, last = table.column("first").to_numpy()[0], table.column("second").to_numpy()[0]
        offsets, data = T.buffers(table.column("delta").combine_chunks())
        length = np.diff(offsets) // 8
        flat = data[offsets[0] : offsets[-1]].view(np.uint64) if offsets[-1] > offsets[0] else np.zeros(0, np.uint64)
        _, ids = np.unique(flat, return_inverse=True)
        at = np.r_[0, np.cumsum(length)]
        marked = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        parent = {int(g): int(g) for g in group}
        parent[int(main[0])] = int(main[0])

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found: tuple[list[int], list[int]] = ([], [])
        current = group.copy()
        for x in np.flatnonzero(group != main):
            if root(int(group[x])) == root(int(main[0])):
                continue
            other = np.flatnonzero(current != current[x]) if first == last else np.flatnonzero((side != side[x]) & (current != current[x]))
            own = ids[at[x] : at[x + 1]]
            if not len(other) or not len(own):
                continue
            marked[own] = True
            entries = T.concat_ranges(at[other], length[other])
            hit = np.r_[0, np.cumsum(marked[ids[entries]])]
            ends = np.r_[0, np.cumsum(length[other])]
            common = hit[ends[1:]] - hit[ends[:-1]]
            marked[own] = False
            differ = length[x] + length[other] - 2 * common
            total = size[x] + size[other]
            for y in other[100 * (total - differ) >= threshold * (total + differ)]:
                a, b = root(int(group[x])), root(int(group[y]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found[0].append(int(node[x]))
                    found[1].append(int(node[y]))
                    current[(current == a) | (current == b)] = min(a, b)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run_


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Links need 100 * |intersection| >= ``threshold`` * |union| of the sets of distinct
    ``k``-word shingles. Null, empty and blank texts have no shingles and link with
    nothing; a row without an id is its own class; repeated rows share a component."""
    work = Workspace(docs.sparkSession, "minhash")
    docs = texts(docs)
    signed = work.save(docs.mapInArrow(_sign(k), SIGNED_SCHEMA), "signed")
    classes = work.save(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands")),
        "classes",
    )
    member = classes.select(F.explode("bands").alias("key"), "node")
    bucket = member.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", "centre")
    star = member.join(bucket, "key").filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    stars = work.save(_compared(star, docs, k, threshold, work), "stars")
    links = stars.filter("linked").select("a", "b")
    joined = work.save(graph.components(links, work, "first"), "joined")
    # stars with members that are in another group than the centre: those members against all others
    main = joined.select(F.col("node").alias("a"), F.col("component").alias("main"))
    group = joined.select(F.col("node").alias("b"), F.col("component").alias("group"))
    placed = stars.join(main, "a", "left").join(group, "b", "left").select(
        "a", F.col("b").alias("node"), F.coalesce("group", "b").alias("group"), F.coalesce("main", "a").alias("main"), F.col("size_b").alias("size"), "delta"
    )
    open_ = placed.groupBy("a").agg(
        F.max((F.col("group") != F.col("main")).cast("int")).alias("apart"), F.count(F.lit(1)).alias("members"), F.sum(F.octet_length("delta")).alias("bytes")
    ).filter("apart = 1 and members > 1")
    open_ = open_.select("a", F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = placed.join(open_, "a").withColumn("side", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("first", F.least("side", "other")).withColumn("second", F.greatest("side", "other"))
    more = work.save(rows.drop("blocks", "other").groupBy("a", "first", "second").applyInArrow(_straggler_links(threshold), "a long, b long"), "more")
    final = graph.components(links.union(more), work, "final")
    component = classes.select("set_a", "set_b", "n_shingles", "node").join(final, "node", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component"))
    return signed.join(component, ["set_a", "set_b", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document with the
    smallest id stays, once, with all its columns as they are, whatever their names. Documents
    without words (null, empty and blank texts) and rows without an id all stay; of rows that
    repeat id and text one stays; an empty table stays empty."""
    found = near_duplicates(docs, k, threshold).filter("doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg(
        F.max((~F.col("kept")).cast("int")).alias("gone"), F.max("n_shingles").alias("n")
    )
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # the rows travel as one struct, so no name of theirs meets one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("t"))
    joined = rows.join(found.hint("merge"), F.col("id") == F.col("d"), "left").filter(F.coalesce("gone", F.lit(0)) == 0)
    copy = F.row_number().over(Window.partitionBy("id", "t").orderBy("t"))
    kept = joined.withColumn("copy", copy).filter((F.col("copy") == 1) | F.col("id").isNull() | F.coalesce(F.col("n") == 0, F.lit(True)))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
