import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import katz
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def star(n, r):
    if r > katz.MAX_DISCOUNTED:
        return r - (katz.MAX_DISCOUNTED - star(n, katz.MAX_DISCOUNTED))
    value = (r + 1) * n[r + 1] / n[r] if n[r] else 0
    return value if 0 < value < r else r - 0.5


class Plain:
    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c1.update(w)
            self.c2.update(zip(["<s>", *w], w, strict=False))
        self.n1, self.n2 = Counter(self.c1.values()), Counter(self.c2.values())
        self.total, self.texts = sum(self.c1.values()), len(texts)
        self.after = defaultdict(list)
        for (h, w), c in self.c2.items():
            self.after[h].append((w, c))
        self.unknown = 1 - sum(star(self.n1, c) for c in self.c1.values()) / self.total if self.total else 1.0

    def p1(self, w):
        return star(self.n1, self.c1[w]) / self.total if self.c1[w] else self.unknown

    def p2(self, h, w):
        context = self.texts if h == "<s>" else self.c1[h]
        if self.c2[h, w]:
            return star(self.n2, self.c2[h, w]) / context
        if not context:
            return self.p1(w)
        seen = sum(star(self.n2, c) / context for _, c in self.after[h])
        return (1 - seen) / (1 - sum(self.p1(v) for v, _ in self.after[h])) * self.p1(w)


def check(spark, rows, docs, block_bytes):
    model = Plain([t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10])
    got = katz.score(docs, block_bytes).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d, t in rows:
        w = tokens(t)
        known = sum(model.c1[x] > 0 for x in w)
        base = sum(math.log10((model.c1[x] + 0.1) / (model.total + 0.1 * (len(model.c1) + 1))) for x in w)
        score = sum(math.log10(model.p2(h, x)) for h, x in zip(["<s>", *w], w, strict=False))
        assert any(
            (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), known, model.total) and math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
            and math.isclose(r["score"], score, rel_tol=1e-7, abs_tol=1e-7) and r["held_out"] == (d is None or zlib.crc32(str(d).encode()) % 10 == 0)
            for r in by[d]
        ), (d, score, by[d])
    return model, got


@pytest.mark.parametrize("block_bytes", [20_000, 1 << 23])
def test_equals_plain_model(spark, block_bytes):
    docs = table(spark, SF, "documents")
    model, got = check(spark, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], docs, block_bytes)
    # every context is a distribution over the vocabulary and the unknown word
    for h in ["<s>", *list(model.c1)[:40]]:
        if h is not None:
            assert math.isclose(sum(model.p2(h, w) for w in model.c1) + model.p2(h, "\0unknown"), 1, rel_tol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark):
    rows = [(i, "a b c a b d" if i % 2 else "B c  a\tb e") for i in range(30)]
    rows += [(100, None), (101, ""), (102, " \n"), (None, "a b"), (3, rows[3][1]), (104, "long words " * 60_000), (105, "new unseen"), (110, "a zz b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as held_out", "2 as part")
    check(spark, rows, docs, 1000)
    assert katz.score(docs.limit(0)).count() == 0
    alone = [d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0][:2]
    got = katz.score(spark.createDataFrame([(d, "a b") for d in alone], "doc_id long, text string")).collect()
    assert [(r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(0, 0.0, 0.0)] * 2


def test_packed_arrays():
    rng = np.random.default_rng(1)
    for x in (np.zeros(0, np.uint64), rng.integers(0, 200, 50).astype(np.uint8), rng.integers(0, 2**62, 9, dtype=np.int64)):
        assert (katz.unpack(katz.pack(x)) == x).all()
    s = np.sort(rng.integers(0, 2**62, 1000, dtype=np.int64).astype(np.uint64))
    assert (katz.unpack_sorted(katz.pack_sorted(s)) == s).all()
