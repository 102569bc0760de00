import random

import pandas as pd
from oracle import duck, same

from ledgerline.llm import lines as L
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.001"


def words(line):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def within(x, y):
    """Edit distance of at most one word."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) == len(y)) :] == y[i + 1 :]


def brute(rows):
    own = [(d if d is not None else L._LAST, k, words(t)) for d, text in rows for k, t in enumerate((text or "").split("\n"))]
    own = [r for r in own if r[2]]
    near = lambda v, w: v == w or (min(len(v), len(w)) >= L.MIN_WORDS and within(v, w))
    out = []
    for d, text in rows:
        cut = (text or "").split("\n")
        gone = [k for k, t in enumerate(cut) if (w := words(t)) and any((e, j) < (d if d is not None else L._LAST, k) and near(v, w) for e, j, v in own)]
        out.append((d, len(cut), len(gone), ",".join(map(str, gone))))
    return out


def cases():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(30)]
    base = [[rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 8, 12]))] for _ in range(40)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rnd.randint(0, 8)):
            w = list(rnd.choice(base))
            for _ in range(rnd.randint(0, 2)):
                kind, at = rnd.randint(0, 2), rnd.randrange(len(w) + 1)
                if kind == 0:
                    w.insert(at, rnd.choice(vocab))
                elif at < len(w):
                    w[at : at + 1] = [rnd.choice(vocab)] if kind == 1 else []
            text.append((" " if rnd.random() < 0.8 else "\t ").join(w) if rnd.random() < 0.9 else " ".join(w).upper())
        rows.append((d * 3, "\n".join(text) + ("\n" if rnd.random() < 0.2 else "")))
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, " ".join(base[0])), (None, "a b c d e f"), rows[5], (6, "another text under a used id"), (503, "a b c d e f\r\na b c d e"), (504, "x " * 3000)]
    rnd.shuffle(rows)
    return rows


def test_equals_brute_force_and_sql(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "'x' as h", "2 as ord", "length(text) as n_chars")
    key = lambda t: tuple((x is None, x) for x in t)
    got = sorted((tuple(r) for r in L.report(docs).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    same(L.report(docs), duck(L.SQL, documents=pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})))
    kept = L.remove(docs).collect()
    want = []
    for d, text in rows:
        gone = next(r[3] for r in brute(rows) if r[0] == d and r[1] == len((text or "").split("\n")) and (d != 6 or True))
        gone = [g for e, t in zip(brute(rows), rows, strict=True) if t == (d, text) for g in [e[3]]][0]
        if gone:
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if str(i) not in gone.split(","))
            if not words(text.replace("\n", " ")):
                continue
        want.append((d, text, None if text is None else len(text)))
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in kept), key=key) == sorted(want, key=key)


def test_documents(spark):
    docs = table(spark, SF, "documents")
    got = same(L.report(docs), duck(L.SQL, documents=f"{SF}/documents.parquet"))
    assert sum(r[2] for r in got) > 0
    assert L.remove(docs).columns == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.report(docs).count() == 0 and L.remove(docs).count() == 0


def test_short_lines_must_be_equal(spark):
    docs = spark.createDataFrame([(1, "Yes it is\none two three four\n"), (2, "yes  IT is\none two three\nyes it was"), (3, "}\n}")], "doc_id long, text string")
    assert {r["doc_id"]: r["removed"] for r in L.report(docs).collect()} == {1: "", 2: "0", 3: "1"}
