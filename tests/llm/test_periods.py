import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest

from ledgerline.llm import periods as P
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_runs(w, min_length=6, repeats=4):
    """Every maximal stretch of every period, straight from the definition."""
    n, out = len(w), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_length, repeats * q):
                out.setdefault((i, j + q), q)  # the smallest period comes first
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def words_of(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def expected(i, text):
    w = words_of(i, text)
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    keep = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *top, sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), sha256(" ".join(keep).encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_cover():
    assert {(a - b) % P.V for a in P.COVER for b in P.COVER} == set(range(P.V))


@pytest.mark.parametrize("seed", range(12))
def test_extensions(seed):
    rnd = np.random.default_rng(seed)
    n = int(rnd.integers(2, 400))
    s = rnd.integers(0, int(rnd.integers(1, 4)), n)
    if seed % 3 == 0:
        s = np.tile(s[: max(1, n // 7)], 8)[:n]
    s = np.append(s, s.max() + 1)
    e = P.Extensions(s)
    i, j = rnd.integers(0, len(s), (2, 3000))
    i, j = i[i != j], j[i != j]
    for a, b, k in zip(i, j, e.common(i, j), strict=True):
        x, y = s[a : a + k], s[b : b + k]
        assert len(x) == len(y) == k and (x == y).all()
        assert max(a, b) + k >= len(s) or s[a + k] != s[b + k]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed, monkeypatch):
    rnd = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(P, "BLOCK", 50)
    docs = []
    for _ in range(rnd.randint(1, 6)):
        w = []
        while len(w) < rnd.randint(0, 200):
            piece = [rnd.randint(0, rnd.choice([1, 2, 30])) for _ in range(rnd.randint(1, 12))]
            w += piece * rnd.choice([1, 1, 2, 4, 5, 9]) + piece[: rnd.randint(0, len(piece))]
        docs.append(w)
    offsets = np.cumsum([0, *map(len, docs)])
    min_length, repeats = rnd.choice([(6, 4), (6, 4), (2, 2), (5, 3)])
    got = P.find_runs(np.array(sum(docs, []), np.int64), offsets, min_length, repeats)
    for d, w in enumerate(docs):
        mine = got.doc == d
        assert list(zip(got.start[mine], got.length[mine], got.period[mine], strict=True)) == brute_runs(w, min_length, repeats)


def test_long_runs():
    w = np.zeros(60_000, np.int64)
    r = P.find_runs(w, np.array([0, len(w)]))
    assert (r.start.tolist(), r.length.tolist(), r.period.tolist()) == ([0], [60_000], [1])
    w = np.tile(np.arange(7_000), 5)
    r = P.find_runs(w, np.array([0, len(w)]))
    assert (r.start.tolist(), r.length.tolist(), r.period.tolist()) == ([0], [35_000], [7_000])


def test_whole_query(spark):
    from ledgerline.llm.queries import op13_periodic_runs

    docs = table(spark, SF, "documents").collect()
    got = result(op13_periodic_runs(spark, SF))
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in docs), key=str)
    assert sum(r[1] > 0 for r in got) >= 10


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (2, " \t\n"), (2, "a a a a a a"), (2, "a a a a a a"), (None, "x y x y x y x y z"),
        (5, "é\x1c é\x1c é\x1c é\x1c é\x1c é\x1c é\x1c"), (6, "A a A a A a a a a a a a"), (7, "w " * 30000),
        *((i, "one two three four five six seven eight") for i in range(100, 160)),
    ]
    docs = spark.createDataFrame([(*r, 9, "y") for r in rows], "doc_id long, text string, start int, n_words string")
    want = sorted((expected(i, t if i != 7 else t[:0]) for i, t in rows), key=str)
    got = [r for r in result(P.report(docs, plant=P.rotation)) if r[0] != 7]
    assert got == [r for r in want if r[0] != 7]
    long = P.report(docs.filter("doc_id = 7")).first()
    assert (long["n_runs"], long["length"], long["period"], long["n_dropped"]) == (1, 30000, 1, 29999)
    assert P.report(docs.limit(0)).count() == 0
    assert P.report(docs.filter("doc_id is null"), with_text=True).first()["collapsed"] == "x y z"
