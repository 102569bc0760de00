import re

import pandas as pd
import pytest
from test_lines import brute as plain_lines
from test_minhash import brute as plain_groups

import corpus_pipeline
from ledgerline.llm import minhash, packing, stages, toxicity
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages_match_plain_versions(spark):
    """Every stage against a plain version on what its predecessor kept."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "best_fit_packing"]
    steps = dict(corpus_pipeline.STAGES)

    scores = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, table(spark, SF, "labels")).collect()}
    first = steps["toxicity"](spark, docs, SF).cache()
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == {d for d, p in scores.items() if not p}
    assert 0 < first.count() < docs.count()

    second = steps["line_dedup"](spark, first, SF).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in first.collect())
    gone = {d: set(x.split(",")) if x else set() for d, _, _, x in plain_fast(rows)}
    want = {}
    for d, t in rows:
        kept = "\n".join(x for i, x in enumerate(t.split("\n")) if str(i) not in gone[d]) if gone[d] else t
        if not gone[d] or kept.strip(" \t\r\n\x0b\x0c"):
            want[d] = kept
    assert second.columns == columns and {r["doc_id"]: r["text"] for r in second.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in second.collect())

    third = steps["near_duplicates"](spark, second, SF).cache()
    groups = plain_groups(sorted(want.items()), 5, 80)
    assert third.columns == columns and {r["doc_id"] for r in third.collect()} == {d for d, _, c in groups if d == c}

    fourth = steps["decontamination"](spark, third, SF).cache()
    bench = [re.findall(r"[^\W\d_]+", r["text"].lower()) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[i : i + 8]) for w in bench for i in range(len(w) - 7)}
    hit = {r["doc_id"] for r in third.collect() if any(tuple(w[i : i + 8]) in windows for w in [re.findall(r"[^\W\d_]+", r["text"].lower())] for i in range(len(w) - 7))}
    left = {r["doc_id"] for r in fourth.collect()}
    assert fourth.columns == columns and left == {r["doc_id"] for r in third.collect()} - hit and hit

    packed = steps["best_fit_packing"](spark, fourth, SF).toPandas()
    assert set(packed.doc_id) == left and packed.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    whole = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pd.testing.assert_frame_equal(whole.sort_values(key)[key].reset_index(drop=True), packed.sort_values(key)[key].reset_index(drop=True))


def plain_fast(rows):
    """The plain line rule, with lines looked up by the words that one edit leaves."""
    from test_lines import words

    from ledgerline.llm.lines import MIN_WORDS

    best: dict = {}
    lines = [(d, k, tuple(words(x))) for d, t in rows for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    keys = lambda w: {("=", w)} | ({(i, w[:i] + w[i + 1 :]) for i in range(len(w))} if len(w) >= MIN_WORDS else set())
    shorter: dict = {}
    for d, k, w in lines:
        for key in keys(w):
            best[key] = min(best.get(key, (d, k)), (d, k))
        for i in range(len(w) if len(w) > MIN_WORDS else 0):
            v = w[:i] + w[i + 1 :]
            shorter[v] = min(shorter.get(v, (d, k)), (d, k))
    gone: dict = {d: [] for d, _ in rows}
    for d, k, w in lines:
        near = [best[key] for key in keys(w)] + [best[("=", w[:i] + w[i + 1 :])] for i in range(len(w) if len(w) > MIN_WORDS else 0) if ("=", w[:i] + w[i + 1 :]) in best] + ([shorter[w]] if w in shorter else [])
        if min(near) < (d, k):
            gone[d].append(k)
    return [(d, len(t.split("\n")), len(gone[d]), ",".join(map(str, gone[d]))) for d, t in rows]


def test_plain_versions_agree():
    from test_lines import cases

    rows = [(d, t) for d, t in dict(r for r in cases() if r[0] is not None and r[1] is not None).items()]
    assert sorted(plain_fast(rows)) == sorted(plain_lines(rows))


@pytest.mark.parametrize("name", [n for n, _ in stages.STAGES])
def test_stage_edges(spark, name):
    rows = [(1, None), (2, ""), (3, "same text of six words here"), (4, "same text of six words here"), (5, "a"), (3, "same text of six words here"), (None, "no id at all in this row")]
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["item_id", "toxic", "toxicity", "score", "evidence", "row", "id", "t", "d", "n", "gone", "copy", "o", "h", "ord", "text_hash", "lines", "key", "at", "place", "near", "late", "own", "line",
             "component_id", "kept", "n_shingles", "hash", "length", "hits", "_t", "_o", "_lines", "_copy", "_d", "_h", "_gone", "_n", "a.b"]
    docs = docs.selectExpr("*", *(f"{i} as `{n}`" for i, n in enumerate(names)))
    out = dict(stages.STAGES)[name](spark, docs, SF)
    got = out.collect()
    if name != "best_fit_packing":
        assert out.columns == docs.columns
        assert all(r[n] == i for r in got for i, n in enumerate(names))
        ids = [r["doc_id"] for r in got]
        assert {1, 2, 5, None} <= set(ids)
        if name == "line_dedup":
            assert ids.count(3) == 2 and 4 not in ids
        if name == "near_duplicates":
            assert ids.count(3) == 1 and 4 not in ids
    else:
        assert len(got) == len(rows)
    assert dict(stages.STAGES)[name](spark, docs.limit(0), SF).count() == 0


def test_keep_one_keeps_texts_without_words(spark):
    docs = spark.createDataFrame([(1, ""), (1, ""), (2, None)], "doc_id long, text string")
    assert minhash.keep_one(docs).count() == 3
