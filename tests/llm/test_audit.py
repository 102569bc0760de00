import random
import re
from collections import Counter
from itertools import permutations

from ledgerline.llm import audit as A
from ledgerline.llm.common import table
from tests.llm.oracle import duck, same

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Apply all 120 orders to every document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    described = []
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(w) < 50:
            fails.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            fails.add("E")
        described.append((source or "", fails, i in good, i in toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for step in range(1, 6):
            f, before = order[step - 1], set(order[: step - 1])
            for part in {p for p, *_ in described}:
                mine = [x for x in described if x[0] == part]
                gone = [x for x in mine if f in x[1] and not x[1] & before]
                out[part, order, step] = [
                    sum(not x[1] & (before | {f}) for x in mine), len(gone),
                    sum(f in x[1] and bool(x[1] & before) for x in mine), sum(x[1] == {f} for x in mine),
                    sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def result(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, source string, mask int")
    x = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    return sorted(tuple(r[c] for c in COLUMNS) for r in A.audit(d, x).collect())


def test_ranks_and_intervals():
    orders = list(map("".join, permutations("ABCDE")))
    assert [A.lehmer_rank(o) for o in orders] == list(range(120))
    removed = Counter()
    for mask, step, a, b in A.intervals():
        for r in range(a, b):
            assert removed[mask, r] == 0
            removed[mask, r] = step
    for mask in range(1, 32):
        for r, o in enumerate(orders):
            assert removed[mask, r] == 1 + min(k for k, c in enumerate(o) if mask >> "ABCDE".index(c) & 1)


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    parts = ["good words here", "A B C", "x # y", "one two three four", "", "Ab\tcd\x0bef\x1cgh", "é ü"]
    docs = []
    for i in range(160):
        t = None if rnd.random() < 0.1 else " ".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 1, 2, 30])))
        if rnd.random() < 0.3:
            t = " ".join(f"w{k}" for k in range(rnd.choice([49, 50, 60])))
        docs.append((rnd.choice([None, i, i, i, i % 20]), t, rnd.choice([None, "", "s1", "s2", "s2"])))
    labels = [(rnd.choice([None, i]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 170, 2)]
    labels += labels[:10]
    assert result(spark, docs, labels) == brute(docs, labels)


def test_edges(spark):
    assert result(spark, [], [(1, 1, 1)]) == []
    one = result(spark, [(7, None, None)], [])
    assert len(one) == 600 and one == brute([(7, None, None)], [])
    # a long text and many copies of one text without ids
    docs = [(1, "word " * 40000, "a")] + [(None, "copy", "a")] * 50 + [(9, "copy", "b"), (4, "copy", "a")]
    assert result(spark, docs, [(9, 1, 1)]) == brute(docs, [(9, 1, 1)])


def test_query_equals_sql(spark):
    from ledgerline.llm.queries import op12_filter_audit

    rows = same(op12_filter_audit(spark, SF), duck(A.SQL, documents=f"{SF}/documents.parquet", labels=f"{SF}/labels.parquet"))
    sources = {r["source"] or "" for r in table(spark, SF, "documents").select("source").distinct().collect()}
    assert len(rows) == 600 * len(sources)
