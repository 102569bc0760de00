import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import text as T
from ledgerline.llm import toxicity as X
from ledgerline.llm.common import table


def brute(term, weight, bounds, rows, k):
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        q = dict(zip(term[a:b].tolist(), weight[a:b].tolist(), strict=True))
        cos = sorted((sum(q.get(int(t), 0.0) * w for t, w in zip(r[2], r[3], strict=True)) for r in rows), reverse=True)[:k]
        out.append([max(c, 0.0) for c in cos] + [0.0] * (k - len(cos)))
    return np.array(out)


@pytest.mark.parametrize("seed", range(12))
def test_nearest_is_exact(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(X, "BLOCK", int(rng.choice([1, 4, 32])))
    monkeypatch.setattr(X, "VISITS", (1, 1, 2, 1 << 20))
    monkeypatch.setattr(X, "DENSE_SHARE", float(rng.choice([0.05, 0.1, 2.0])))
    n_terms = 60

    def vector():
        t = np.sort(rng.choice(n_terms, rng.integers(1, 8), replace=False))
        w = rng.random(len(t))
        return t, w / np.linalg.norm(w)

    rows = [(i, int(rng.integers(2)), *vector()) for i in range(int(rng.integers(1, 400)))]
    queries = [vector() for _ in range(50)]
    bounds = np.r_[0, np.cumsum([len(t) for t, _ in queries])]
    term, weight = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
    index = X.Index(rows, n_terms)
    best, who = index.nearest(term, weight, bounds, 9)
    assert np.allclose(best, brute(term, weight, bounds, rows, 9))
    for q, (b, w) in enumerate(zip(best, who, strict=True)):
        for value, i in zip(b, w, strict=True):
            if i >= 0:
                own = dict(zip(*[x.tolist() for x in next(r for r in rows if r[0] == index.ids[i])[2:]], strict=True))
                assert np.isclose(value, sum(own.get(int(t), 0) * v for t, v in zip(*queries[q], strict=True)))


def test_terms():
    run = next(T.runs(pa.array(["Ab abcde", "", "ABCDE"])))
    keys, docs = X.terms(run)
    by = [set(keys[docs == d].tolist()) for d in range(3)]
    assert by[1] == set() and by[2] < by[0] and len(by[2]) == 1


def test_learns_and_rejects(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = " ".join(rng.choice(base, 60)) + (" nasty awful" if toxic else "")
        rows.append((i, text, "a"))
        labels.append((i, int(toxic), "clash"))
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "Nasty AWFUL " * 50_000, "x"), (1002, "Nasty AWFUL", "x"), (None, "nasty awful", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([*labels, (None, 1, "c"), (0, 0, "c"), (2000, 1, "c"), (5, None, "c")], "doc_id long, toxic int, text string")
    got = X.classify(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] is (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            if r["doc_id"] < 600:
                assert r["predicted"] == int(r["doc_id"] % 4 == 0)
            if r["predicted"]:
                assert all(e["toxic"] == 1 for e in r["evidence"][:3]) and r["evidence"]
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    kept = X.reject(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(600) if i % 4} | {1000, 1001}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r["score"], r["predicted"]) for r in X.classify(docs, none).collect()] == [(0.0, 0)] * 2
    assert X.classify(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(i, 0) for i in range(50)], "doc_id long, toxic int")
    assert X.reject(docs, one).count() == 2


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels")
    rows = X.classify(table(spark, d, "documents"), labels).join(labels, "doc_id").filter("held_out").select("score", "toxic").toPandas()
    p, n = rows.score[rows.toxic == 1].to_numpy(), rows.score[rows.toxic == 0].to_numpy()
    auc = (p[:, None] > n).mean() + 0.5 * (p[:, None] == n).mean()
    assert auc > 0.93 and ((rows.score >= 0.5) == (rows.toxic == 1)).mean() > 0.95


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_small_inputs_find_toxic_texts(spark, sf):
    d = f"/root/testdata/{sf}"
    labels = table(spark, d, "labels")
    rows = X.classify(table(spark, d, "documents"), labels).join(labels, "doc_id").select("held_out", "predicted", "toxic").toPandas()
    assert (rows.predicted == rows.toxic).mean() > 0.95
    assert rows.predicted[rows.toxic == 1].mean() > 0.9 and rows.predicted[(rows.toxic == 1) & rows.held_out].sum() > 0


def test_rare_terms_count(spark):
    """Toxic words that occur in no more than five examples each."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, 7))
    base = [word() for _ in range(60)]
    groups = [[word() for _ in range(6)] for _ in range(12)]
    rows, labels = [], []
    for i in range(360):
        toxic = i % 6 == 0
        rows.append((i, " ".join([*rng.choice(base, 20), *(groups[i // 6 % 12] if toxic else [])])))
        labels.append((i, int(toxic)))
    got = X.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["doc_id"] % 6 == 0 for r in held) > 5
    assert all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held)


def test_bounds_skip_blocks(monkeypatch):
    """With a strong shared term most blocks are never scored."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        t = np.unique(rng.integers(20, 2000, 12))
        w = np.full(len(t), 0.05)
        if i < 60:
            t, w = np.r_[i % 4, t], np.r_[1.0, w]
        rows.append((i, int(i < 60), t, w / np.linalg.norm(w)))
    index = X.Index(rows, 2000)
    scored = []
    plain = T.concat_ranges
    monkeypatch.setattr(X.T, "concat_ranges", lambda s, c: (scored.append(int(np.sum(c))), plain(s, c))[1])
    term = np.r_[2, np.arange(20, 400)]
    weight = np.r_[1.0, np.full(380, 0.02)]
    weight /= np.linalg.norm(weight)
    best, who = index.nearest(term, weight, np.array([0, len(term)]), 10)
    assert np.allclose(best, brute(term, weight, [0, len(term)], rows, 10))
    # the block entries are read once; the postings of few blocks
    assert sum(scored[1:]) < scored[0] / 4


def test_whole_query_equals_brute_force(spark):
    """Every score of sf0.001 from plain dictionaries, all pairs of texts and examples."""
    import re
    from collections import Counter

    from ledgerline.llm.queries import op2_toxicity

    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, d, "documents").collect()}
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, d, "labels").collect() if r["toxic"] in (0, 1)}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in docs}
    train = {i: marks[i] for i in marks if fold.get(i, 0)}
    bags = {i: Counter(re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower() if t.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))) for i, t in docs.items()}
    n1, n0 = sum(train.values()), sum(1 - v for v in train.values())
    df, a, c = Counter(), Counter(), Counter()
    for i, bag in bags.items():
        df.update(bag.keys())
        if i in train:
            (a if train[i] else c).update(bag.keys())
    tie = {}
    for t in set(a) | set(c):
        p, q = a[t], c[t]
        chi = (n1 + n0) * (p * (n0 - q) - q * (n1 - p)) ** 2 / max(1.0, (p + q) * (n1 + n0 - p - q) * n1 * n0)
        tie[t] = (np.log((1 + len(docs)) / (1 + df[t])) + 1) * (1 + chi) / (30 + chi)
    mean = np.mean(list(tie.values()))

    def unit(bag):
        w = {t: (1 + np.log(n)) * tie[t] for t, n in bag.items() if t in tie}
        norm = np.sqrt(sum(v * v for v in w.values()) + mean**2)
        return {t: v / norm for t, v in w.items()}

    vec = {i: unit(b) for i, b in bags.items()}
    examples = [i for i in train if vec[i]]

    def vote(i, others):
        cos = sorted(((sum(v * vec[j].get(t, 0.0) for t, v in vec[i].items()), train[j]) for j in others), reverse=True)[:15]
        w = [(x * x, y) for x, y in cos if x > 0]
        p = (sum(x for x, y in w if y) + 0.01) / (sum(x for x, _ in w) + 0.02)
        return np.log(p / (1 - p))

    x = np.array([vote(i, [j for j in examples if j != i]) for i in examples])
    y = np.array([train[i] for i in examples])
    k, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(k * x + b)))
        g = np.array([((y - p) * x).sum() - (k - 1), (y - p).sum() - b])
        v = p * (1 - p)
        step = np.linalg.solve([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]], g)
        k, b = k + step[0], b + step[1]
    got = {r["doc_id"]: r for r in op2_toxicity(spark, d).collect()}
    assert set(got) == set(docs)
    for i in docs:
        assert got[i]["held_out"] is (fold[i] == 0)
        if vec[i]:
            want = 1 / (1 + np.exp(-(k * vote(i, examples) + b)))
            assert abs(got[i]["score"] - want) < 1e-6, i
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    sample, totals = X.training_sample(docs, marks, {1: 1000, 0: 1000}, {1: 1000, 0: 2000})
    got = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert got == {1: 10, 0: 20} and sum(totals.values()) > 100
