"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words, and every text has one term of its own. A bounded, documented sample of
labelled documents gives the examples, and all their terms count: a term's weight grows
smoothly with the chi-square of its tie to the label and never reaches zero. Document
frequencies cover the whole corpus.

The examples lie in blocks of a block-max inverted index: for every term and block it knows
the largest weight there. A text's cosines with a block are at most the sum of its own
weights times these maxima, so blocks are visited in the order of their bounds until the
last wanted cosine beats the bounds that are left; the cosines of visited blocks are exact.
Squared cosines weight the neighbours' votes, and a logistic curve fitted on leave-one-out
votes turns them into probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm import text as T
from ledgerline.llm.common import fold, texts

U = np.uint64
#: labelled examples of each label that a model is fitted on at most, and bytes of their texts;
#: vocabulary and index hold at most one entry for each word of these texts
MAX_EXAMPLES = {1: 512, 0: 1536}
MAX_BYTES = {1: 8 << 20, 0: 24 << 20}
#: chi-square value at which a term has about half of its full weight
HALF_CHI2 = 30.0
NEIGHBOURS = 15
#: examples of one index block
BLOCK = 32
#: blocks are visited in groups of this many, in the order of their bounds
VISITS = (2, 4, 8, 16, 1 << 20)
#: share of the examples from which a term is a row of a dense matrix, and such rows at most
DENSE_SHARE, MAX_DENSE = 0.1, 1024
#: texts and index entries that are scored together at most
TEXTS, ENTRIES = 64, 500_000
SCORE_SCHEMA = "struct<score:double,evidence:array<struct<doc_id:long,toxic:int,cosine:double>>>"


def terms(run: T.Run) -> tuple[np.ndarray, np.ndarray]:
    """(term, document) of every word (stretch of letters, digits and non-ASCII bytes, A-Z lower-cased)."""
    return T.words(run, T.ALNUM)


def _distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) in document order, with their counts."""
    if not len(keys):
        return keys, docs, np.zeros(0, np.int64)
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
    return keys[first], docs[first], np.diff(np.r_[first, len(keys)])


class Lookup:
    """Positions of 64-bit keys in a sorted vocabulary, by a table of where the keys of each prefix begin."""

    def __init__(self, vocabulary: np.ndarray):
        self.keys = vocabulary
        bits = min(24, max(8, len(vocabulary).bit_length()))
        self.shift = U(64 - bits)
        count = np.bincount((vocabulary >> self.shift).astype(np.int64), minlength=1 << bits)
        self.begin = np.r_[0, np.cumsum(count)].astype(np.int32)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into keys, their vocabulary positions)."""
        prefix = (keys >> self.shift).astype(np.int64)
        at, stop = self.begin[prefix], self.begin[prefix + 1]
        found = np.zeros(len(keys), bool)
        rest = np.flatnonzero(at < stop)
        while len(rest):
            hit = self.keys[at[rest]] == keys[rest]
            found[rest[hit]] = True
            rest = rest[~hit]
            at[rest] += 1
            rest = rest[at[rest] < stop[rest]]
        hit = np.flatnonzero(found)
        return hit, at[hit].astype(np.int64)


def _counted(docs: np.ndarray, at: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, term) by document, with their counts."""
    bits = n_terms.bit_length()
    pairs, count = np.unique(docs << bits | at, return_counts=True)
    return pairs >> bits, pairs & ((1 << bits) - 1), count


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray  # times the tie to the label
    index: Index | None = None  # of the examples
    label_weight: tuple[float, float] = (1.0, 1.0)
    prior: float = 0.0  # of texts without any term
    curve: tuple[float, float] = (1.0, 0.0)
    _lookup: Lookup | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_lookup": None}

    @property
    def lookup(self) -> Lookup:
        if self._lookup is None:
            self._lookup = Lookup(self.vocabulary)
        return self._lookup


class Index:
    """Block-max inverted index of the examples' unit vectors.

    Examples lie in blocks of ``BLOCK``, toxic ones first and those of one heaviest term
    together, so that a block's maxima are high for few terms. Terms of many examples are
    rows of a dense matrix, whose products are exact bounds of themselves; the others have
    an entry for each block that holds them: its largest weight, and its postings."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]], n_terms: int):
        parts = [np.concatenate([r[i] for r in rows]) for i in (2, 3)]
        self._fill(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([len(r[2]) for r in rows]), *parts, n_terms)

    @classmethod
    def of(cls, *columns) -> Index:
        """From columns: ids, labels, number of terms, terms and weights one after the other."""
        index = cls.__new__(cls)
        index._fill(*columns)
        return index

    def _fill(self, ids: np.ndarray, labels: np.ndarray, size: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> None:
        owner = np.repeat(np.arange(len(ids)), size)
        heaviest = term[np.lexsort((weight, owner))][np.cumsum(size) - 1]
        order = np.lexsort((ids, heaviest, -labels))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.labels = ids[order], labels[order]
        self.blocks = -(-len(ids) // BLOCK)
        example = place[owner]
        by = np.lexsort((example, term))
        term, example, weight = term[by].astype(np.int64), example[by].astype(np.int32), weight[by]
        count = np.bincount(term, minlength=n_terms)
        frequent = np.argsort(-count, kind="stable")[:MAX_DENSE]
        frequent = np.sort(frequent[count[frequent] > DENSE_SHARE * len(ids)])
        self.frequent = frequent
        often = np.isin(term, frequent)
        self.dense_entries = np.searchsorted(frequent, term[often]).astype(np.int32), example[often], weight[often]
        term, self.example, self.weight = term[~often], example[~often], weight[~often]
        # one entry per (term, block): largest weight, postings from .. to
        key = term * self.blocks + self.example // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.block = (key[first] % self.blocks).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.from_ = np.r_[first, len(key)].astype(np.int32)
        entries = np.bincount(key[first] // self.blocks, minlength=n_terms)
        self.entries = entries.astype(np.int32)
        self.entry = (np.cumsum(entries) - entries).astype(np.int32)
        self.n_terms = n_terms
        self._dense = None

    def __getstate__(self):
        return {**self.__dict__, "_dense": None}

    @property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of each term or -1, matrix of frequent terms by examples in full blocks)."""
        if self._dense is None:
            row = np.full(self.n_terms, -1, np.int32)
            row[self.frequent] = np.arange(len(self.frequent))
            matrix = np.zeros((len(self.frequent), self.blocks * BLOCK))
            matrix[self.dense_entries[0], self.dense_entries[1]] = self.dense_entries[2]
            self._dense = row, matrix
        return self._dense

    def nearest(self, term: np.ndarray, weight: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For query vectors in CSR form (``bounds``: no empty ones): the k largest cosines and
        their examples, 0 and -1 where there are fewer."""
        n = len(bounds) - 1
        best, who = np.zeros((n, k)), np.full((n, k), -1)
        row, _ = self.dense
        listed = np.where(row[term] >= 0, 0, self.entries[term])
        ends = np.r_[0, np.cumsum(listed)][bounds]
        i = 0
        while i < n:
            j = min(n, i + TEXTS, max(i + 1, int(np.searchsorted(ends, ends[i] + ENTRIES, "right")) - 1))
            s = slice(bounds[i], bounds[j])
            own = np.repeat(np.arange(j - i), np.diff(bounds[i : j + 1]))
            value, top = self._search(own, term[s], weight[s], listed[s], j - i, k)
            best[i:j], who[i:j] = value, np.where(value > 0, top, -1)
            i = j
        return best, who

    def _search(self, own: np.ndarray, term: np.ndarray, weight: np.ndarray, listed: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        row, matrix = self.dense
        b, width = self.blocks, self.blocks * BLOCK
        often = row[term] >= 0
        query = np.zeros((n, len(matrix)))
        query[own[often], row[term[often]]] = weight[often]
        score = query @ matrix
        # bounds of all blocks: the dense part is exact, the rest at most weight times maximum
        at = T.concat_ranges(self.entry[term].astype(np.int64), listed)
        text, q = np.repeat(own, listed), np.repeat(weight, listed)
        cell = text * b + self.block[at]
        bound = score.reshape(n, b, BLOCK).max(2) + np.bincount(cell, q * self.top[at], n * b).reshape(n, b)
        order = np.argsort(-bound, axis=1, kind="stable")
        ranked = np.empty_like(order)
        np.put_along_axis(ranked, order, np.arange(b)[None].repeat(n, 0), 1)
        known = np.full((n, width), -1.0)
        least = np.full(n, -1.0)
        done = 0
        for step in VISITS:
            # a hair of slack: sums in another order may differ in their last digits
            visit = (ranked >= done) & (ranked < done + step) & (bound > least[:, None] - 1e-9)
            done += step
            if not visit.any():
                break
            hit = visit.ravel()[cell]
            e = at[hit]
            size = self.from_[e + 1] - self.from_[e]
            p = T.concat_ranges(self.from_[e].astype(np.int64), size)
            sparse = np.bincount(np.repeat(text[hit], size) * width + self.example[p], np.repeat(q[hit], size) * self.weight[p], n * width).reshape(n, b, BLOCK)
            exact = np.where(visit[:, :, None], score.reshape(n, b, BLOCK) + sparse, known.reshape(n, b, BLOCK))
            known = exact.reshape(n, width)
            if done >= b:
                break
            if k <= width:
                least = -np.partition(-known, k - 1, axis=1)[:, k - 1]
        # columns past the last example have cosine 0 and lose every tie against -1 places below
        known[:, len(self.ids) :] = -1.0
        top = np.argpartition(-known, k - 1, axis=1)[:, :k] if k < width else np.arange(width)[None].repeat(n, 0)
        value = np.take_along_axis(known, top, 1)
        by = np.lexsort((top, -value), axis=1)
        top, value = np.take_along_axis(top, by, 1), np.maximum(np.take_along_axis(value, by, 1), 0.0)
        if value.shape[1] < k:
            more = ((0, 0), (0, k - value.shape[1]))
            top, value = np.pad(top, more, constant_values=-1), np.pad(value, more)
        return value, top


def vectors(run: T.Run, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, unit TF-IDF weight) of a run's texts, by document."""
    if not len(model.vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys, docs = terms(run)
    hit, at = model.lookup(keys)
    docs, at, tf = _counted(docs[hit], at, len(model.vocabulary))
    weight = (1 + np.log(tf)) * model.idf[at]
    # a term of the text's own, of mean weight: texts that share one weak term are not alike
    norm = np.sqrt(np.bincount(docs, weight**2, run.n) + model.idf.mean() ** 2)
    return docs, at, weight / norm[docs] if len(docs) else weight


def votes(best: np.ndarray, who: np.ndarray, model: Model) -> np.ndarray:
    """Label-weighted share of toxic votes; a squared cosine is a neighbour's weight."""
    label = np.where(who >= 0, model.index.labels[np.maximum(who, 0)], 0)
    weight = best**2 * np.where(label == 1, model.label_weight[1], model.label_weight[0])
    toxic = (weight * label).sum(1)
    return (toxic + 0.01) / (weight.sum(1) + 0.02)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def score_run(run: T.Run, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores of all texts; rows with neighbours, their cosines, their examples)."""
    docs, term, weight = vectors(run, model)
    out = np.full(run.n, model.prior)
    if not len(docs) or model.index is None:
        return out, np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 1), np.int64)
    some, first = np.unique(docs, return_index=True)
    best, who = model.index.nearest(term, weight, np.r_[first, len(docs)], NEIGHBOURS)
    a, b = model.curve
    out[some] = 1 / (1 + np.exp(-(a * _logit(votes(best, who, model)) + b)))
    return out, some, best, who


def score_udf(model: Model):
    """Arrow UDF over a text column: its score and the nearest examples as evidence."""

    @F.arrow_udf(SCORE_SCHEMA)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        item = pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])
        for col in batches:
            scores, sizes, ids, labels, cosines = [], [], [], [], []
            for run in T.runs(col.fill_null("") if col.null_count else col):
                value, some, best, who = score_run(run, model)
                scores.append(value)
                size = np.zeros(run.n, np.int64)
                good = who >= 0
                size[some] = good.sum(1)
                sizes.append(size)
                ids.append(model.index.ids[who[good]] if len(some) else np.zeros(0, np.int64))
                labels.append(model.index.labels[who[good]] if len(some) else np.zeros(0, np.int64))
                cosines.append(best[good])
            if not scores:
                yield pa.array([], pa.struct([("score", pa.float64()), ("evidence", pa.list_(item))]))
                continue
            evidence = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))], pa.int32()),
                pa.StructArray.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(labels), pa.int32()), pa.array(np.concatenate(cosines), pa.float64())], fields=list(item)),
            )
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores), pa.float64()), evidence], names=["score", "evidence"])

    return score


# ------------------------------------------------------------------ fitting
def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents of each label that have a term."""
    keys: list[np.ndarray] = []
    flags: list[np.ndarray] = []
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        for run in T.runs(batch.column("text")):
            k, d, _ = _distinct(*terms(run))
            keys.append(k)
            flags.append(label[run.first + d])
    if keys:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        toxic = np.concatenate(flags) == 1
        n1, n = np.bincount(at, toxic, len(found)), np.bincount(at, minlength=len(found))
        for i in range(0, len(found), 50_000):
            s = slice(i, i + 50_000)
            yield pa.RecordBatch.from_pydict({"term": found[s].view(np.int64), "n1": n1[s].astype(np.int64), "n0": (n - n1)[s].astype(np.int64)})


def _frequencies(vocabulary: np.ndarray):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, df, n = Lookup(vocabulary), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for run in T.runs(batch.column("text")):
                keys, docs = terms(run)
                hit, at = find(keys)
                df += np.bincount(_counted(docs[hit], at, len(df))[1], minlength=len(df))
                n += run.n
        some = np.flatnonzero(df)
        for i in range(0, len(some) + 1, 50_000):
            part = some[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"at": np.r_[part, [-1] * (i == 0)].astype(np.int64), "df": np.r_[df[part], [n] * (i == 0)].astype(np.int64)})

    return run_


def _vectors(model: Model):
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column("doc_id"), batch.column("toxic")
            for run in T.runs(batch.column("text")):
                docs, term, weight = vectors(run, model)
                cut = pa.array(T.doc_bounds(docs, run.n).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(run.first, run.n), label.slice(run.first, run.n), pa.ListArray.from_arrays(cut, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(weight))],
                    ["doc_id", "toxic", "terms", "weights"],
                )

    return run_


def training_sample(
    docs: DataFrame, labels: DataFrame, max_examples: dict[int, int] = MAX_EXAMPLES, max_bytes: dict[int, int] = MAX_BYTES
) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of at most ``max_examples`` labelled training documents of each
    label, those with the smallest id hash, while their whole texts add up to at most
    ``max_bytes``; and how many there are of each label.

    Rows of the held-out fold, without an id or without a 0/1 label never train; of several
    labels of one document the largest holds, of several texts the smallest."""
    named = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    totals = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    chosen = None
    for label, most in sorted(max_examples.items()):
        part = named.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # bounded by max_examples
    sample = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # at most max_examples rows per label; their texts move once
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    most = F.when(F.col("toxic") == 1, F.lit(max_bytes.get(1, 0))).otherwise(F.lit(max_bytes.get(0, 0)))
    sized = sample.withColumn("so_far", F.sum(F.octet_length("text")).over(before)).filter(F.col("so_far") <= most)
    return sized.select("doc_id", "text", "toxic"), totals


def fit(docs: DataFrame, labels: DataFrame, max_examples: dict[int, int] = MAX_EXAMPLES) -> Model:
    """Fit on the bounded training sample; document frequencies come from all of ``docs``.

    Without examples of both labels the model scores every text with the smoothed rate of toxic ones."""
    from ledgerline.llm.common import Workspace

    sample, totals = training_sample(docs, labels, max_examples)
    work = Workspace(docs.sparkSession, "toxicity")
    sample = work.save(sample, "sample")
    have = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = have.get(1, 0), have.get(0, 0)
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1) if totals else 0.0
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), prior=min(prior, 1.0))
    if not n1 or not n0:
        return empty
    # one row per term of the bounded sample
    counts = sample.mapInArrow(_term_counts, "term long, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toArrow()
    vocabulary = counts.column("term").to_numpy().view(np.uint64)
    if not len(vocabulary):
        return empty
    order = np.argsort(vocabulary)
    vocabulary = vocabulary[order]
    a, b = (counts.column(c).to_numpy()[order].astype(float) for c in ("n1", "n0"))
    c, d = n1 - a, n0 - b
    chi2 = (n1 + n0) * (a * d - b * c) ** 2 / np.maximum(1.0, (a + b) * (c + d) * n1 * n0)
    found = texts(docs).mapInArrow(_frequencies(vocabulary), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    at, n = found.column("at").to_numpy(), found.column("df").to_numpy()
    df = np.zeros(len(vocabulary))
    df[at[at >= 0]] = n[at >= 0]
    idf = np.log((1 + n[at < 0].sum()) / (1 + df)) + 1
    model = Model(vocabulary, idf * (1 + chi2) / (HALF_CHI2 + chi2))
    # the driver keeps the model alone
    del counts, found, order, a, b, c, d, chi2, at, n, df, idf
    own = sample.mapInArrow(_vectors(model), "doc_id long, toxic int, terms array<int>, weights array<double>").toArrow().sort_by("doc_id").combine_chunks()
    label, size = own.column("toxic").to_numpy().astype(np.int64), pc.list_value_length(own.column("terms")).to_numpy().astype(np.int64)
    model.index = Index.of(
        own.column("doc_id").to_numpy()[size > 0], label[size > 0], size[size > 0], *(pc.list_flatten(own.column(c)).to_numpy() for c in ("terms", "weights")), len(vocabulary)
    )
    del own
    model.label_weight = (totals[0] / n0, totals[1] / n1)
    blank = label[size == 0]
    w1, w0 = (blank == 1).sum() * model.label_weight[1], (blank == 0).sum() * model.label_weight[0]
    model.prior = (w1 + prior) / (w1 + w0 + 1)
    model.curve = _calibrate(model, sample)
    return model


def _left_out(model: Model):
    """Logits of the votes of every example's neighbours without itself."""

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.index
        by = np.argsort(index.ids)
        for batch in batches:
            for run in T.runs(batch.column("text")):
                docs, term, weight = vectors(run, model)
                some, first = np.unique(docs, return_index=True)
                if not len(some):
                    continue
                best, who = index.nearest(term, weight, np.r_[first, len(docs)], NEIGHBOURS + 1)
                own = by[np.searchsorted(index.ids, batch.column("doc_id").to_numpy()[run.first + some], sorter=by)]
                miss = who != own[:, None]
                # exactly one column goes: the document itself, or the last if more than k equal it
                miss[miss.all(1), -1] = False
                best, who = best[miss].reshape(len(own), NEIGHBOURS), who[miss].reshape(len(own), NEIGHBOURS)
                yield pa.RecordBatch.from_pydict({"label": index.labels[own], "logit": _logit(votes(best, who, model))})

    return run_


def _calibrate(model: Model, sample: DataFrame) -> tuple[float, float]:
    """Logistic curve over leave-one-out votes of the examples (weighted to the corpus' label rates)."""
    own = sample.mapInArrow(_left_out(model), "label long, logit double").sort("logit", "label").toArrow()
    x, y = own.column("logit").to_numpy(), own.column("label").to_numpy()
    w = np.where(y == 1, model.label_weight[1], model.label_weight[0])
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (y - p) * x).sum() - (a - 1), (w * (y - p)).sum() - b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if math.isfinite(a) and math.isfinite(b) and a > 0 else (1.0, 0.0)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (score and evidence) in place of a column of that name; a null
    text counts as empty."""
    return docs.withColumn("toxicity", score_udf(model)(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row of ``docs``.

    Whole texts are scored, a null text as an empty one; texts without words get the rate of
    toxic ones among such examples. Rows that repeat an id are scored as they stand (of several
    texts of a training id the smallest one trains). A row without an id never trains and is not
    held out. Equal cosines take the example of the smaller place in the index. Without labels
    of both kinds every text gets the smoothed rate of toxic labels. An empty table gives no
    rows; other columns, whatever their names, are not read."""
    rows = score(texts(docs), fit(docs, labels))
    return rows.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("toxicity.evidence").alias("evidence"),
    )


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns as they are.

    Null and empty texts, repeated rows and ids, and rows without an id are judged by their text
    as in :func:`classify`; an empty table stays empty."""
    model = fit(docs, labels)
    value = score_udf(model)(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.filter(value["score"] < 0.5)
