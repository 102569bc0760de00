"""Katz backoff language model over the corpus' own n-grams (words and word pairs).

The corpus is cut into blocks: a block is a table row that holds the token codes
of some documents and its own vocabulary. Counts live in tables partitioned by
key range: every block asks each partition for the counts of its own distinct
tokens and pairs, and the same rows carry its training counts there. So each
distinct n-gram of a block travels once, whatever its frequency, and a frequent
word or pair is one entry per block.

Counts are Good-Turing discounted. The mass that discounting leaves after a word
is spread over the words not seen after it in proportion to their unigram
probability, by a backoff weight that normalises exactly; the unigram level
leaves its mass to one unknown word. A token is scored recursively: by its pair
if that was seen, else by the backoff weight and the unigram level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import text as T
from ledgerline.llm.common import Workspace, fold

U = np.uint64
#: text of a block, and entries of a count partition, at most about
BLOCK_BYTES, PARTITION_ENTRIES, MIN_PARTITIONS = 8 << 20, 500_000, 64
#: counts up to this one are discounted by Good-Turing, larger ones by the same amount as it
MAX_DISCOUNTED = 5
END, START = U(0xE4D0E4D0E4D0E4D1), U(0x57A2757A2757A273)
_LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: keys have 56 bits, which saves a byte of each in the shuffle
KEY_BITS = 56


# ------------------------------------------------------------ packed arrays
def pack(x: np.ndarray) -> bytes:
    """An integer array, byte planes apart, compressed."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return x.dtype.char.encode() + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes, dtype: type = np.int64) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype)
    kind, n = np.dtype(raw[:1].decode()), int.from_bytes(raw[1:9], "little")
    planes = pa.decompress(raw[9:], n * kind.itemsize, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds ``x``."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def token_keys(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U(64 - KEY_BITS)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return T.mix(left * _LEFT + T.mix(right * _RIGHT)) >> U(64 - KEY_BITS)


# ------------------------------------------------------------------- blocks
BLOCK_SCHEMA = "block long, entries long, docs array<long>, held array<boolean>, sizes binary, vocabulary binary, codes binary"


def _blocks(block_bytes: int):
    schema = pa.schema([("block", pa.int64()), ("entries", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("vocabulary", pa.binary()), ("codes", pa.binary())])

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list = []
        held: list = []
        sizes: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal docs, held, sizes, hashes, size
            vocabulary, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            row = {
                "block": uuid.uuid4().int >> 66, "entries": len(vocabulary), "docs": docs, "held": held, "sizes": pack(narrow(np.concatenate(sizes))),
                "vocabulary": pack_sorted(vocabulary), "codes": pack(narrow(codes)),
            }
            docs, held, sizes, hashes, size = [], [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for run in T.runs(batch.column("text")):
                word, doc = T.words(run)
                n = np.bincount(doc, minlength=run.n)
                # every document's words, then its end
                own = np.full(len(word) + run.n, END, np.uint64)
                own[np.arange(len(word)) + doc] = word
                hashes.append(own)
                sizes.append(n + 1)
                docs += batch.column("doc_id").slice(run.first, run.n).to_pylist()
                held += batch.column("held_out").slice(run.first, run.n).to_pylist()
                size += len(run.data)
                if size >= block_bytes:
                    yield close()
        if docs:
            yield close()

    return run_


@dataclass
class Block:
    vocabulary: np.ndarray
    codes: np.ndarray
    sizes: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, held: list[bool], sizes: bytes, vocabulary: bytes, codes: bytes) -> Block:
        return cls(unpack_sorted(vocabulary), unpack(codes).astype(np.int64), unpack(sizes).astype(np.int64), np.array(held, bool))

    @property
    def training(self) -> np.ndarray:
        """Whether each token trains."""
        return np.repeat(~self.held, self.sizes)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, left code, right code) of the distinct pairs, by key; and each token's pair.
        The left code of a document's first token is the one behind the vocabulary."""
        start = len(self.vocabulary)
        left = np.empty_like(self.codes)
        left[1:] = self.codes[:-1]
        left[np.cumsum(self.sizes) - self.sizes] = start
        pair, at = np.unique(left * (start + 1) + self.codes, return_inverse=True)
        left, right = pair // (start + 1), pair % (start + 1)
        key = pair_keys(np.r_[self.vocabulary, START][left], self.vocabulary[right])
        order = np.argsort(key, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return key[order], left[order], right[order], place[at]


def _requests(keys: np.ndarray, columns: list[np.ndarray], parts: int, block: int) -> Iterator[dict]:
    """Rows (part, block, keys, columns...) of a block's sorted keys, by key range."""
    edges = (np.arange(parts + 1, dtype=object) * (1 << KEY_BITS) // parts).tolist()
    cut = np.searchsorted(keys, np.array(edges[:-1], np.uint64))
    cut = np.r_[cut, len(keys)]
    for part, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        if a < b:
            yield {"part": part, "block": block, "keys": pack_sorted(keys[a:b]), **{f"v{i}": pack(c[a:b]) for i, c in enumerate(columns)}}


def _each_block(rows_of, schema: pa.Schema):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(rows_of(row["block"], Block.of(row["held"], row["sizes"], row["vocabulary"], row["codes"])))
                for i in range(0, len(found), 64):
                    yield pa.RecordBatch.from_pylist(found[i : i + 64], schema=schema)

    return run_


REQUEST = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("v0", pa.binary())])
REQUEST_SCHEMA = "part int, block long, keys binary, v0 binary"


def token_requests(parts: int):
    def rows(block: int, b: Block) -> Iterator[dict]:
        count = np.bincount(b.codes[b.training], minlength=len(b.vocabulary))
        return _requests(token_keys(b.vocabulary), [narrow(count)], parts, block)

    return _each_block(rows, REQUEST)


def pair_requests(parts: int):
    def rows(block: int, b: Block) -> Iterator[dict]:
        key, _, _, at = b.pairs()
        return _requests(key, [narrow(np.bincount(at[b.training], minlength=len(key)))], parts, block)

    return _each_block(rows, REQUEST)


# ------------------------------------------------------------------- counts
ANSWER_SCHEMA = "block long, part int, total binary, owner binary, tokens long, distinct long, n array<long>"
_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("total", pa.binary()), ("owner", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("n", pa.list_(pa.int64()))])


def _total(table: pa.Table) -> pa.Table:
    """One key range: the blocks' counts summed, the sums back to every block, and in the first
    row the range's sums. The owner of a key is one of the blocks that has it."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys = [unpack_sorted(r["keys"]) for r in rows]
    size = [len(k) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, np.concatenate([unpack(r["v0"]).astype(np.int64) for r in rows]))
    owner = np.zeros(len(at), np.uint8)
    owner[np.unique(at, return_index=True)[1]] = 1
    n = np.bincount(np.minimum(total, MAX_DISCOUNTED + 2), minlength=MAX_DISCOUNTED + 3)
    out, a = [], 0
    for i, (r, s) in enumerate(zip(rows, size, strict=True)):
        out.append({
            "block": r["block"], "part": r["part"], "total": pack(narrow(total[at[a : a + s]])), "owner": pack(owner[a : a + s]),
            "tokens": int(total.sum()) if i == 0 else 0, "distinct": int((total > 0).sum()) if i == 0 else 0, "n": n.tolist() if i == 0 else [0] * len(n),
        })
        a += s
    return pa.Table.from_pylist(out, schema=_ANSWER)


@dataclass(frozen=True)
class Discounts:
    """Good-Turing counts: r* = (r + 1) n(r+1) / n(r) up to MAX_DISCOUNTED, beyond it r less the
    last discount. Where the counts of counts give no discount, r - 1/2."""

    star: tuple[float, ...]
    tail: float

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        star = [0.0]
        for r in range(1, MAX_DISCOUNTED + 1):
            value = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
            star.append(value if 0 < value < r else r - 0.5)
        return cls(tuple(star), MAX_DISCOUNTED - star[-1])

    def __call__(self, count: np.ndarray) -> np.ndarray:
        return np.where(count <= MAX_DISCOUNTED, np.array(self.star)[np.minimum(count, MAX_DISCOUNTED)], count - self.tail)


@dataclass(frozen=True)
class Model:
    tokens: int  # training tokens
    distinct: int
    texts: int  # training documents
    words: Discounts
    pairs: Discounts
    unknown: float  # probability of the unknown word

    def word(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.words(count) / max(self.tokens, 1), self.unknown)


def _sums(answers: DataFrame) -> tuple[int, int, list[int]]:
    """Training tokens, distinct n-grams and counts of counts: one row, whatever the corpus."""
    n = [F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(MAX_DISCOUNTED + 3)]
    tokens, distinct, *counts = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), *n).first()
    return tokens, distinct, counts


def fit(answers1: DataFrame, answers2: DataFrame, blocks: DataFrame) -> Model:
    tokens, distinct, n1 = _sums(answers1)
    _, _, n2 = _sums(answers2)
    held = blocks.select(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0]
    words, pairs = Discounts.of(n1), Discounts.of(n2)
    small = sum(n1[r] * (r - words.star[r]) for r in range(1, MAX_DISCOUNTED + 1))
    many = distinct - sum(n1[1 : MAX_DISCOUNTED + 1])
    unknown = (small + many * words.tail) / tokens if tokens else 1.0
    return Model(tokens, distinct, held or 0, words, pairs, unknown)


# ------------------------------------------------------------------ scoring
DRAFT_SCHEMA = (
    "block long, part int, docs array<long>, held array<boolean>, n_tokens binary, n_known binary, base array<double>, draft array<double>, "
    "keys binary, seen array<double>, lower array<double>, need_keys binary, need_doc binary, need_at binary, need_count binary"
)
_DRAFT = pa.schema([
    ("block", pa.int64()), ("part", pa.int32()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.binary()), ("n_known", pa.binary()),
    ("base", pa.list_(pa.float64())), ("draft", pa.list_(pa.float64())), ("keys", pa.binary()), ("seen", pa.list_(pa.float64())), ("lower", pa.list_(pa.float64())),
    ("need_keys", pa.binary()), ("need_doc", pa.binary()), ("need_at", pa.binary()), ("need_count", pa.binary()),
])


def _draft(model: Model, parts: int):
    """One block: scores without the backoff weights; by key range, what the block knows of
    the weights of its contexts and which weights it needs."""

    def run_(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["kind"] == 0)
        b = Block.of(own["held"], own["x"], own["y"], own["z"])
        answer = lambda kind, field: np.concatenate([unpack(r[field]) for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["part"])]).astype(np.int64)
        count = answer(1, "x")
        key, left, right, at = b.pairs()
        both, owner = answer(2, "x"), answer(2, "y") == 1
        context = np.r_[count, model.texts]
        p1 = model.word(count)
        seen = both > 0
        p2 = np.zeros(len(key))
        p2[seen] = model.pairs(both[seen]) / context[left[seen]]
        first = np.cumsum(b.sizes) - b.sizes
        total = lambda x: np.add.reduceat(x, first)
        base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.distinct + 1)))
        log_pair = np.log10(np.where(seen, np.where(seen, p2, 1.0), p1[right]))
        draft = total(log_pair[at])
        # contexts whose pairs this block owns: probability seen after them, and its share of the unigram level
        mine = seen & owner
        heads = np.unique(left[mine])
        s_seen = np.bincount(left[mine], p2[mine], len(context))[heads]
        s_low = np.bincount(left[mine], p1[right[mine]], len(context))[heads]
        names = token_keys(np.r_[b.vocabulary, START])
        # weights needed: unseen pairs after a known context
        open_ = ~seen & (context[left] > 0)
        tokens = np.flatnonzero(open_[at])
        doc = np.repeat(np.arange(len(b.sizes)), b.sizes)[tokens]
        need, times = np.unique(doc * (len(context) + 1) + left[at[tokens]], return_counts=True)
        need_doc, need_left = need // (len(context) + 1), need % (len(context) + 1)
        need_heads, need_at = np.unique(need_left, return_inverse=True)
        head_order, need_order = np.argsort(names[heads], kind="stable"), np.argsort(names[need_heads], kind="stable")
        place = np.empty_like(need_order)
        place[need_order] = np.arange(len(need_order))
        out = [{
            "block": own["block"], "part": -1, "docs": own["docs"], "held": own["held"], "n_tokens": pack(b.sizes), "n_known": pack(total((count > 0)[b.codes].astype(np.int64))),
            "base": total(base[b.codes]).tolist(), "draft": draft.tolist(), "need_doc": pack(narrow(need_doc)), "need_at": pack(narrow(place[need_at])), "need_count": pack(narrow(times)),
        }]
        edges = np.array([(i << KEY_BITS) // parts for i in range(parts)], np.uint64)
        hk, nk = names[heads][head_order], names[need_heads][need_order]
        hc, nc = np.r_[np.searchsorted(hk, edges), len(hk)], np.r_[np.searchsorted(nk, edges), len(nk)]
        s_seen, s_low = s_seen[head_order], s_low[head_order]
        for i in range(parts):
            h, n = slice(hc[i], hc[i + 1]), slice(nc[i], nc[i + 1])
            if h.start < h.stop or n.start < n.stop:
                out.append({"block": own["block"], "part": i, "keys": pack_sorted(hk[h]), "seen": s_seen[h].tolist(), "lower": s_low[h].tolist(), "need_keys": pack_sorted(nk[n])})
        return pa.Table.from_pylist(out, schema=_DRAFT)

    return run_


def _weights(table: pa.Table) -> pa.Table:
    """One key range of contexts: the backoff weights that the blocks need, as logarithms."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys = np.concatenate([unpack_sorted(r["keys"]) for r in rows])
    heads, at = np.unique(keys, return_inverse=True)
    seen = np.bincount(at, np.concatenate([r["seen"] for r in rows]), len(heads)) if len(heads) else np.zeros(0)
    low = np.bincount(at, np.concatenate([r["lower"] for r in rows]), len(heads)) if len(heads) else np.zeros(0)
    left, rest = 1 - seen, 1 - low
    good = (left > 0) & (rest > 0)
    log = np.where(good, np.log10(np.where(good, left, 1) / np.where(good, rest, 1)), 0.0)
    out = []
    for r in rows:
        need = unpack_sorted(r["need_keys"])
        if len(need):
            out.append({"block": r["block"], "part": r["part"], "log": log[np.searchsorted(heads, need)].tolist()})
    return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("part", pa.int32()), ("log", pa.list_(pa.float64()))]))


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(model: Model):
    def run_(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["part"] == -1)
        weights = sorted((r for r in rows if r["part"] >= 0), key=lambda r: r["part"])
        log = np.concatenate([r["log"] for r in weights]) if weights else np.zeros(0)
        score = np.array(own["draft"])
        doc, at, count = unpack(own["need_doc"]).astype(np.int64), unpack(own["need_at"]).astype(np.int64), unpack(own["need_count"])
        if len(doc):
            score = score + np.bincount(doc, log[at] * count, len(score))
        return pa.table({
            "doc_id": pa.array(own["docs"], pa.int64()), "held_out": pa.array(own["held"], pa.bool_()), "n_tokens": unpack(own["n_tokens"]).astype(np.int64),
            "n_known": unpack(own["n_known"]).astype(np.int64), "train_tokens": np.full(len(score), model.tokens, np.int64), "base_score": np.array(own["base"]), "score": score,
        })

    return run_


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    A null text is empty (its end alone is scored); a row without an id does not train and
    counts as held out; repeated rows train as often as they occur. Without training
    documents every token is the unknown word with probability 1."""
    work = Workspace(docs.sparkSession, "katz")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(fold("doc_id", 10) == 0, F.lit(True)).alias("held_out"),
    )
    blocks = work.save(rows.mapInArrow(_blocks(block_bytes), BLOCK_SCHEMA), "blocks")
    entries = blocks.agg(F.sum("entries")).first()[0] or 0
    tokens = blocks.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    few = max(MIN_PARTITIONS, entries // PARTITION_ENTRIES)
    # a token's code takes about two bytes, and most pairs of a block are distinct
    many = max(MIN_PARTITIONS, tokens // 2 // PARTITION_ENTRIES)
    answers1 = work.save(blocks.mapInArrow(token_requests(few), REQUEST_SCHEMA).groupBy("part").applyInArrow(_total, ANSWER_SCHEMA), "words")
    answers2 = work.save(blocks.mapInArrow(pair_requests(many), REQUEST_SCHEMA).groupBy("part").applyInArrow(_total, ANSWER_SCHEMA), "pairs")
    model = fit(answers1, answers2, blocks)
    none = F.lit(None)
    gathered = blocks.select("block", F.lit(0).alias("kind"), F.lit(0).alias("part"), "docs", "held", F.col("sizes").alias("x"), F.col("vocabulary").alias("y"), F.col("codes").alias("z"))
    for kind, answers in ((1, answers1), (2, answers2)):
        gathered = gathered.unionByName(answers.select(
            "block", F.lit(kind).alias("kind"), "part", none.cast("array<long>").alias("docs"), none.cast("array<boolean>").alias("held"),
            F.col("total").alias("x"), F.col("owner").alias("y"), none.cast("binary").alias("z"),
        ))
    drafts = work.save(gathered.groupBy("block").applyInArrow(_draft(model, few), DRAFT_SCHEMA), "drafts")
    weights = drafts.filter("part >= 0").groupBy("part").applyInArrow(_weights, "block long, part int, log array<double>")
    last = drafts.filter("part < 0").select("block", "part", "docs", "held", "n_tokens", "n_known", "base", "draft", "need_doc", "need_at", "need_count")
    last = last.unionByName(weights, allowMissingColumns=True)
    return last.groupBy("block").applyInArrow(_finish(model), SCORE_SCHEMA)
