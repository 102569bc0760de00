import numpy as np

from ledgerline.llm import graph, vectors
from ledgerline.llm.common import table


def brute(rows, threshold=0.98):
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = {i: np.array(rows[i][1], np.float64) for i in good}
    links, a, b = dict.fromkeys(range(len(rows)), 0), [], []
    for n, i in enumerate(good):
        for j in good[:n]:
            if rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                a.append(rows[i][0])
                b.append(rows[j][0])
    root = dict(zip(*graph.forest(a, b), strict=True))
    return sorted((r[0], links[i], root.get(r[0], r[0]), root.get(r[0], r[0]) == r[0]) for i, r in enumerate(rows))


def test_equals_brute_force(spark):
    emb = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in emb.collect()]
    assert sorted(map(tuple, vectors.near_duplicates(emb).collect())) == brute(rows)


def test_groups_and_edges(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLAB", 40)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):  # groups around a centre, links from none to all
        centre = rng.standard_normal(32)
        label = int(rng.integers(2))
        for _ in range(25):
            rows.append((len(rows), (centre + rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.14, 0.18])).tolist(), label))
    rows += [(len(rows) + i, [float(c) for c in v], 1) for i, v in enumerate([rows[3][1], rows[3][1], (np.array(rows[3][1]) * 7).tolist(), [0.0] * 32, [1.0, 2.0], [2.0, 4.0], [-1.0, -2.0]])]
    rows += [(len(rows) + i, v, label) for i, (v, label) in enumerate([(None, 1), ([], 1), ([None] * 32, 1), ([float("nan")] * 32, 1), ([float("inf")] * 32, 0), (rows[0][1], None), (rows[0][1], 1 - rows[0][2])])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as slab", "'x' as first", "2 as node")
    assert sorted(map(tuple, vectors.near_duplicates(frame).collect())) == brute(rows)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_recall_of_collision_counting():
    rng = np.random.default_rng(8)
    for dim in (8, 16, 64, 256):
        window, need, _ = vectors.calibration(dim, 0.98)
        x = rng.standard_normal((400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        turn = rng.standard_normal((400, dim))
        turn -= (turn * x).sum(1, keepdims=True) * x
        turn /= np.linalg.norm(turn, axis=1, keepdims=True)
        y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * turn
        i, j = vectors.candidates(x @ vectors.directions_of(dim), y @ vectors.directions_of(dim), window, need)
        assert (i == j).sum() == 400
        if dim >= 64:
            assert len(i) < 1000


def test_invalid_rows_that_repeat_an_id_stay(spark):
    v, w = [1.0, 2.0, 3.0], [-1.0, 2.0, 0.0]
    rows = [(1, v, 1), (1, None, 1), (1, [0.0] * 3, 1), (2, v, 1), (2, [float("nan")] * 3, 1), (2, None, None), (3, w, 1), (3, [], 1), (4, None, 1), (4, None, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, vectors.near_duplicates(frame).collect())) == brute(rows)
