import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import suffixes as S
from ledgerline.llm import text as T
from ledgerline.llm.common import table


def brute(rows, length, keep_first):
    texts = [(t or "").encode() for _, t in rows]
    where = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0])):
        for a in range(len(texts[i]) - length + 1):
            where.setdefault(texts[i][a : a + length], []).append((i, a))
    gone = [np.zeros(len(t) + 1, np.int64) for t in texts]
    for places in where.values():
        for i, a in places[1 if keep_first else 0 :] if len(places) > 1 else []:
            gone[i][a] += 1
            gone[i][a + length] -= 1
    out = []
    for (d, _), t, g in zip(rows, texts, gone, strict=True):
        mask = np.cumsum(g)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        out.append((d, len(t), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def plain_lpf(segments, groups, cap):
    out = []
    for i, s in enumerate(segments):
        for a in range(len(s)):
            best = 0
            for j in range(i + 1):
                if groups[j] == groups[i]:
                    t = segments[j]
                    for b in range(len(t) if j < i else a):
                        n = 0
                        while n < cap and a + n < len(s) and b + n < len(t) and s[a + n] == t[b + n]:
                            n += 1
                        best = max(best, n)
            out.append(best)
        out.append(0)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_previous_factors(seed):
    rnd = random.Random(seed)
    segments = [bytes(rnd.choice(b"ab" if seed % 2 else b"abcd") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
    groups = sorted(rnd.randint(0, 1) for _ in segments)
    cap = rnd.choice([1, 3, 5, 8, 13])
    offsets, lpf, source = S.previous_factors(segments, groups, cap)
    assert lpf.tolist() == plain_lpf(segments, groups, cap)
    whole = S.previous_factors(segments, groups, cap, cap)[1]
    assert (whole >= cap).tolist() == (lpf >= cap).tolist()
    text = b"".join(s + b"\0" for s in segments)
    for i, (n, j) in enumerate(zip(lpf.tolist(), source.tolist(), strict=True)):
        assert (j == -1) == (n == 0) and (not n or (j < i and text[i : i + n] == text[j : j + n]))


def test_every_string_has_an_anchor_of_its_own_bytes():
    rnd = random.Random(1)
    base = "".join(rnd.choice("abc de") for _ in range(3000))
    texts = [base, "x" * 399, "y" * 1000, "tail" + base[500:1500] + "other", "ab" * 700, ""]
    run = next(T.runs(pa.array(texts)))
    doc, place, h, before, behind, around = S.anchors(run)
    at = {}
    for i, t in enumerate(texts):
        own = place[doc == i] - run.offsets[i]
        for a in range(len(t) - S.LENGTH + 1):
            inside = own[(own >= a) & (own + S.GRAM <= a + S.LENGTH)]
            assert len(inside)
            at.setdefault(t[a : a + S.LENGTH], []).append(set((inside - a).tolist()))
    assert all(set.intersection(*x) for x in at.values())


def cases():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [text(90) for _ in range(4)]
    rows = [(i, text(rnd.randint(5, 60)) + rnd.choice(passage)[rnd.randint(0, 60) : 400 + rnd.randint(0, 200)] + text(rnd.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, rows[i][1][: 300 + 40 * i] + text(80) + rows[i + 1][1][100:]) for i in range(15)]
    rows += [(200, None), (201, ""), (202, "z" * 399), (203, "z" * 5000), (204, "ab" * 900), (205, rows[3][1]), (None, rows[4][1]), (206, "é" * 350), (207, text(40) + "é" * 350), rows[5], (208, passage[0] + " mid " + passage[0])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [S.MAX_GROUP, 1, 6])
def test_equals_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(S, "MAX_GROUP", most)
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ord", "'x' as text_hash", "2 as pos")
    got = S.deduplicate(docs, keep_first=False).collect()
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 400, False), key=key)
    alone = [r for r in rows if r != (5, next(t for d, t in rows if d == 5))] + [(5, next(t for d, t in rows if d == 5))]
    docs = spark.createDataFrame(alone, "doc_id long, text string")
    got = S.deduplicate(docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(brute(alone, 400, True), key=key)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.deduplicate(docs, keep_first=False).collect())) == sorted(brute(rows, 400, False))
    assert S.deduplicate(docs.limit(0)).count() == 0
