"""Language identification as mixture inference over n-gram likelihoods.

Every language is a distribution over hashed byte trigrams, counted on all
training documents. A text is a mixture of languages: expectation maximisation
finds the proportions that make its trigrams likeliest, and the number of
languages is the one with the best likelihood less a penalty per language: the
set grows, by the proportions over all learned languages, until that stops
improving. The prediction is the language with the largest proportion of the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import text as T
from ledgerline.llm.common import fold

U = np.uint64
BINS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 10
#: a first estimate beyond this proportion is taken as a text of one language
CLEAR = 0.98
#: sets of up to this many languages are always tried; larger ones while each is better than the one before
PATIENCE = 4
#: neighbouring trigrams overlap; so many count as one observation
OVERLAP = 3.0
UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
for _lo, _hi in ((65, 91), (97, 123), (128, 256)):
    _LETTER[_lo:_hi] = True
_CLASS = np.where(_LETTER, T.LOWER, 0x20).astype(np.uint8)
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[128:] = False


def trigrams(run: T.Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bin, count) of a run's trigrams around a letter, by document; other
    bytes and a text's borders count as spaces."""
    n, size = run.n, np.diff(run.offsets)
    start = run.offsets[:-1] + 2 * np.arange(n) + 1
    padded = np.full(len(run.data) + 2 * n, 0x20, np.uint8)
    padded[np.arange(len(run.data)) + np.repeat(2 * np.arange(n) + 1, size)] = _CLASS[run.data]
    middle = np.flatnonzero(padded != 0x20)
    code = (padded[middle - 1].astype(np.uint32) << 16) | (padded[middle].astype(np.uint32) << 8) | padded[middle + 1]
    bins = (code * np.uint32(2654435761)) >> np.uint32(16)
    doc = np.searchsorted(start, middle, "right") - 1
    keys, count = np.unique((doc << 16) | bins.astype(np.int64), return_counts=True)
    return keys >> 16, keys & (BINS - 1), count


def has_letter(run: T.Run) -> np.ndarray:
    seen = np.r_[0, np.cumsum(_ASCII_LETTER[run.data])]
    found = seen[run.offsets[1:]] > seen[run.offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(run.offsets) > 0)):
        own = run.data[run.offsets[i] : run.offsets[i + 1]]
        if (own >= 128).any():
            found[i] = any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (BINS, languages)


def mixture(p: np.ndarray, count: np.ndarray, bounds: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation of every document's proportions over ``allowed`` components.

    ``p``: (entries, components) likelihoods, documents as slices ``bounds``. Returns the
    proportions and the log likelihood (up to each entry's scale in ``p``)."""
    size = np.diff(bounds)
    total = np.add.reduceat(count, bounds[:-1]).astype(float)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        joint = p * np.repeat(share, size, axis=0)
        joint *= (count / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, bounds[:-1], axis=0) / total[:, None]
    likely = np.log((p * np.repeat(share, size, axis=0)).sum(axis=1))
    return share, np.add.reduceat(count * likely, bounds[:-1])


def infer(run: T.Run, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language position or -1, score, proportions of all languages) of every text of a run.

    Proportions are those of the chosen set, 0 for languages outside it."""
    k = len(model.languages)
    best, score, proportions = np.full(run.n, -1), np.zeros(run.n), np.zeros((run.n, k))
    doc, gram, count = trigrams(run)
    if not len(doc) or not k:
        return best, score, proportions
    some, first = np.unique(doc, return_index=True)
    bounds = np.r_[first, len(doc)]
    log_p = model.log_p[gram]
    alone = np.add.reduceat(log_p * count[:, None], first, axis=0)
    pick = np.argsort(-alone, axis=1, kind="stable")
    own = np.take_along_axis(log_p, np.repeat(pick, np.diff(bounds), axis=0), 1)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    share, _ = mixture(p, count, bounds, np.ones((len(some), k)))
    top = np.argmax(share, axis=1)
    # one language: how far it leads the others
    single = np.take_along_axis(alone, pick, 1) / OVERLAP
    lead = np.exp(single - single.max(axis=1, keepdims=True))
    value = lead.max(axis=1) / lead.sum(axis=1)
    winner = np.zeros(len(some), np.int64)
    chosen = (np.arange(k) == 0)[None].repeat(len(some), 0).astype(float)
    open_ = np.flatnonzero(share[np.arange(len(some)), top] < CLEAR)
    if len(open_):
        size = np.diff(bounds)[open_]
        at = T.concat_ranges(first[open_], size)
        cut = np.r_[0, np.cumsum(size)]
        total = np.add.reduceat(count[at], cut[:-1]) / OVERLAP
        gain = np.full(len(open_), -np.inf)
        rank = np.argsort(np.argsort(-share[open_], axis=1, kind="stable"), axis=1)
        # texts whose set may still grow; two languages can be worth it where a step to the likeliest one is not
        grow = np.arange(len(open_))
        for m in range(1, k + 1):
            # the m largest proportions; one language is the likeliest by itself
            allowed = (rank[grow] < m).astype(float) if m > 1 else (np.arange(k) == 0)[None].repeat(len(grow), 0).astype(float)
            own = T.concat_ranges(cut[grow], size[grow])
            part, likely = mixture(p[at][own], count[at][own], np.r_[0, np.cumsum(size[grow])], allowed)
            worth = likely / OVERLAP - 0.5 * (m - 1) * np.log(np.maximum(total[grow], 2.0)) - (m - 1)
            better = worth > gain[grow]
            which = grow[better]
            gain[which] = worth[better]
            winner[open_[which]] = np.argmax(part[better], axis=1)
            chosen[open_[which]] = part[better]
            if m > 1:
                value[open_[which]] = part[better].max(axis=1)
            if m >= PATIENCE:
                grow = which
            if not len(grow):
                break
    best[some] = pick[np.arange(len(some)), winner]
    score[some] = np.clip(value, 0.0, 1.0)
    spread = np.zeros((len(some), k))
    np.put_along_axis(spread, pick, chosen, 1)
    proportions[some] = spread
    return best, score, proportions


def _predict(model: Model):
    names = np.array([*model.languages, UNDETERMINED], object)
    # likelihoods of a run's trigrams in every language are held at once
    limit = max(1 << 14, 4 * T.CHUNK_BYTES // max(4, len(model.languages)))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in T.runs(batch.column("text"), limit):
                best, score, share = infer(run, model)
                blank = ~has_letter(run)
                best[blank], score[blank], share[blank] = -1, 0.0, 0.0
                # largest proportions first, names in order among equal ones
                by = np.argsort(-share, axis=1, kind="stable")
                ordered = np.take_along_axis(share, by, 1)
                real = ordered > 0
                cut = pa.array(np.r_[0, np.cumsum(real.sum(1))].astype(np.int32))
                mix = pa.StructArray.from_arrays([pa.array(names[by[real]].tolist(), pa.string()), pa.array(ordered[real])], ["lang", "share"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(run.first, run.n), batch.column("held_out").slice(run.first, run.n), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.ListArray.from_arrays(cut, mix)],
                    ["doc_id", "held_out", "lang_pred", "score", "mixture"],
                )

    return run_


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language: the counts of its trigram bins."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for run in T.runs(batch.column("text")):
            doc, gram, count = trigrams(run)
            own = langs[run.first + doc]
            for lang in set(langs[run.first : run.first + run.n]):
                m = own == lang
                counts[lang] = counts.get(lang, np.zeros(BINS, np.int64)) + np.bincount(gram[m], count[m], BINS).astype(np.int64)
    for lang, c in counts.items():
        some = np.flatnonzero(c)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(some) + 1), "bin": np.r_[-1, some], "count": np.r_[0, c[some]]}, schema=pa.schema([("lang", pa.string()), ("bin", pa.int64()), ("count", pa.int64())]))


def fit(rows: DataFrame) -> Model:
    """Trigram distributions of all rows (text, lang) with a language. What comes back to the
    driver is one row per language and bin, whatever the number of documents."""
    known = rows.filter(F.col("lang").isNotNull()).select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    counts = known.mapInArrow(_count, "lang string, bin long, count long").groupBy("lang", "bin").agg(F.sum("count").alias("count")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    where = {x: i for i, x in enumerate(langs)}
    table = np.full((BINS, len(langs)), SMOOTHING)
    at, bins = np.array([where[x] for x in counts.column("lang").to_pylist()], np.int64), counts.column("bin").to_numpy()
    real = bins >= 0
    table[bins[real], at[real]] += counts.column("count").to_numpy()[real]
    return Model(langs, np.log(table / table.sum(axis=0)) if langs else table)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture of every row of ``docs``; ``mixture`` lists the
    chosen set of languages with their proportions, the largest first.

    Trained on the rows with an id whose fold is not 2 and whose lang is not null; a row without
    an id is not held out and does not train. A text without a letter (null and empty ones too)
    is ``und`` with score 0 and an empty mixture, and so is every text if no language was
    learned. Equal likelihoods go to the language first in name order. Rows that repeat an id
    are rows of their own; an empty table gives no rows; other columns are not read."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
    )
    model = fit(rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, mixture array<struct<lang:string,share:double>>"
    return rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "held_out").mapInArrow(_predict(model), schema)
