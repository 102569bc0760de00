import random
import re

import numpy as np
import pandas as pd
import pytest

from ledgerline.llm import graph, minhash
from ledgerline.llm.common import Workspace, table

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, k, threshold):
    """Sets, and components by comparing each pair that shares a shingle."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    a, b = [], []
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in where[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= threshold * (len(s) + len(sets[j]) - c):
                a.append(rows[i][0])
                b.append(rows[j][0])
    roots = dict(zip(*graph.forest(a, b), strict=True))
    return [(d, len(s), roots.get(d, d)) for (d, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize("k,threshold", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, threshold):
    docs = table(spark, SF, "documents")
    got = minhash.near_duplicates(docs, k, threshold).toPandas().sort_values("doc_id")
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], k, threshold)
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].to_numpy().tolist())) == sorted(want)
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_chains_and_edges(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    rows = [(100, None), (101, ""), (102, " \t "), (103, "one"), (104, "ONE "), (105, "one two"), (106, "two one"), (107, "one  two"), (5, "one")]
    at = 1000
    for _ in range(6):  # chains: each a small edit of the one before
        w = [rnd.choice(vocab) for _ in range(120)]
        for _ in range(12):
            rows.append((at, " ".join(w)))
            at += 1
            w = list(w)
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
    rows += [(at + 1, "long " + " ".join(rnd.choice(vocab) for _ in range(50_000)))]
    rows += rows[-3:]
    rnd.shuffle(rows)
    frame = pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "component": "clash", "key": 1})
    docs = spark.createDataFrame(frame.where(frame.notna(), None))
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 3, 85))
    assert minhash.near_duplicates(docs.limit(0), 3, 85).count() == 0


def test_signature_estimates():
    rng = np.random.default_rng(5)
    for n, share in ((1, 1.0), (5, 0.6), (300, 0.8), (3000, 0.3)):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 2**62, int(n * share) or 1, dtype=np.int64).astype(np.uint64)
            x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**62, n - len(both), dtype=np.int64).astype(np.uint64)])) for _ in range(2))
            s = minhash.superminhash(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2)
            assert np.isfinite(s).all()
            j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append((s[0] == s[1]).mean() - j)
        assert abs(np.mean(errors)) < 0.05 and np.std(errors) <= np.sqrt(0.25 / minhash.SIGNATURE) + 0.02
    # every position is filled by its own round's element at most once: a set of one fills all in turn
    one = minhash.superminhash(np.array([7], np.uint64), np.array([0]), 1)[0]
    assert sorted(np.floor(one).astype(int)) == list(range(minhash.SIGNATURE))


def test_components(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(3000), rnd.randrange(3000)) for _ in range(1800)] + [(i, i + 1) for i in range(5000, 5400)] + [(9000, i) for i in range(9001, 9500)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in graph.components(frame, Workspace(spark, "graph-test"), "x").collect()}
    want = dict(zip(*graph.forest(*map(list, zip(*links, strict=True))), strict=True))
    assert {n: c for n, c in got.items() if n != c} == {n: c for n, c in want.items() if n != c}
    assert set(got) == {x for p in links for x in p if p[0] != p[1]}
