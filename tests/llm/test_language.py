import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerline.llm import language as L
from ledgerline.llm import text as T
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.01"


def plain_bins(text):
    data = b" " + bytes(c if (65 <= c < 91 or 97 <= c < 123 or c >= 128) else 32 for c in text.encode()).lower() + b" "
    out = Counter()
    for i in range(1, len(data) - 1):
        if data[i] != 32:
            code = data[i - 1] << 16 | data[i] << 8 | data[i + 1]
            out[(code * 2654435761 % 2**32) >> 16] += 1
    return out


def test_trigrams():
    texts = ["", "a", "Ab é12 zz", "x" * 5, " ", "Straße und"]
    run = next(T.runs(pa.array(texts)))
    doc, gram, count = L.trigrams(run)
    for i, t in enumerate(texts):
        assert dict(zip(gram[doc == i].tolist(), count[doc == i].tolist(), strict=True)) == dict(plain_bins(t))
    assert L.has_letter(next(T.runs(pa.array(["", "12 .", "。", "é", "x", "日"])))).tolist() == [False, False, False, True, True, True]


def test_mixture_is_plain_em():
    rng = np.random.default_rng(2)
    p, count = rng.random((40, 3)) + 0.01, rng.integers(1, 9, 40)
    bounds = np.array([0, 15, 16, 40])
    share, likely = L.mixture(p, count, bounds, np.ones((3, 3)), rounds=7)
    for d, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        pi = [1 / 3] * 3
        for _ in range(7):
            new = [0.0] * 3
            for i in range(a, b):
                z = sum(pi[k] * p[i, k] for k in range(3))
                for k in range(3):
                    new[k] += count[i] * pi[k] * p[i, k] / z
            pi = [x / count[a:b].sum() for x in new]
        assert np.allclose(pi, share[d])
        assert math.isclose(likely[d], sum(count[i] * math.log(sum(pi[k] * p[i, k] for k in range(3))) for i in range(a, b)))


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_mixtures(spark):
    docs = table(spark, SF, "documents").toPandas()
    train = [(i, t, g) for i, t, g in zip(docs.doc_id, docs.text, docs.lang, strict=True)]
    model = L.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    de, fr = (" ".join(docs.text[docs.lang == g].head(3))[:3000] for g in ("de", "fr"))
    best, score, share = L.infer(next(T.runs(pa.array([de + " " + fr[:1000], de]))), model)
    assert [model.languages[b] for b in best] == ["de", "de"]
    assert 0.6 < score[0] < 0.9 and score[1] > 0.95
    assert np.allclose(share.sum(1), 1) and share[0, model.languages.index("de")] == score[0] and share[0, model.languages.index("fr")] > 0.1


def test_mixture_of_more_languages_than_four():
    """Seven languages of their own letters, six of them in one text."""
    names = list("abcdefg")
    table_ = np.full((L.BINS, 7), 0.5)
    texts = {n: " ".join(f"{n}{x}{n}" for x in "hijklmnop") for n in names}
    for i, n in enumerate(names):
        for gram, c in plain_bins(texts[n] * 50).items():
            table_[gram, i] += c
    model = L.Model(names, np.log(table_ / table_.sum(0)))
    mixed = " ".join(texts[n] * 20 for n in "abcdef")
    best, score, share = L.infer(next(T.runs(pa.array([mixed, texts["g"]]))), model)
    assert (share[0] > 0.1).tolist() == [True] * 6 + [False] and abs(share[0].sum() - 1) < 1e-9
    assert names[best[1]] == "g" and 0.1 < score[0] < 0.3


def test_whole_query_equals_brute_force(spark):
    from ledgerline.llm.queries import op5_language

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: (r["text"] or "", r["lang"]) for r in table(spark, sf, "documents").collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i in docs}
    langs = sorted({g for i, (_, g) in docs.items() if g is not None and fold[i] != 2})
    counts = np.full((L.BINS, len(langs)), 0.5)
    bins = {i: plain_bins(t) for i, (t, _) in docs.items()}
    for i, (_, g) in docs.items():
        if g is not None and fold[i] != 2:
            for b, c in bins[i].items():
                counts[b, langs.index(g)] += c
    log_p = np.log(counts / counts.sum(0))

    def em(p, c, allowed):
        pi = np.array(allowed, float) / sum(allowed)
        for _ in range(10):
            r = p * pi
            pi = (r * (c / r.sum(1))[:, None]).sum(0) / c.sum()
        return pi, (c * np.log((p * pi).sum(1))).sum()

    def plain(i):
        if not any(ch.isalpha() for ch in docs[i][0]):
            return "und", 0.0
        c = np.array(list(bins[i].values()), float)
        own = log_p[list(bins[i])]
        alone = (own * c[:, None]).sum(0)
        order = sorted(range(len(langs)), key=lambda k: (-alone[k], k))
        p = np.exp(own - own.max(1, keepdims=True))[:, order]
        pi, _ = em(p, c, [1] * len(langs))
        lead = np.exp((alone[order] - alone.max()) / 3)
        answer = (order[0], lead.max() / lead.sum())
        if pi.max() >= 0.98:
            return langs[answer[0]], answer[1]
        by, best = sorted(range(len(langs)), key=lambda k: -pi[k]), -np.inf
        for m in range(1, len(langs) + 1):
            part, likely = em(p, c, [int(k in by[:m]) if m > 1 else int(k == 0) for k in range(len(langs))])
            worth = likely / 3 - 0.5 * (m - 1) * np.log(max(c.sum() / 3, 2.0)) - (m - 1)
            if worth > best:
                best, answer = worth, (order[int(part.argmax())], part.max() if m > 1 else answer[1])
        return langs[answer[0]], answer[1]

    got = {r["doc_id"]: r for r in op5_language(spark, sf).collect()}
    assert set(got) == set(docs)
    for i in docs:
        name, value = plain(i)
        assert got[i]["held_out"] is (fold[i] == 2) and got[i]["lang_pred"] == name
        assert abs(got[i]["score"] - min(max(value, 0.0), 1.0)) < 1e-6


def test_edges(spark):
    rows = [(i, "der die und das ist" if i % 2 else "the of and that is", "de" if i % 2 else "en") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 ! 3", "en"), (103, "的", None), (104, "a", "en"), (None, "the and", None), (106, "the of " * 100_000, None), (1, rows[1][1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as held_out", "0 as score", "1 as bin")
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert [by[i] for i in (100, 101, 102)] == ["und"] * 3 and by[106] == by[None] == "en" and by[1] == "de" and by[103] in ("de", "en")
    assert L.identify(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in L.identify(blank).collect()] == [("und", 0.0)]
