import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import packing as P
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_best_fit(lengths, capacity):
    """Best fit decreasing, one piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            i = min(fit, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_piece_by_piece(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 16, 50, 100])
    lengths = [rnd.randint(1, capacity) if rnd.random() < 0.5 else rnd.choice([1, 2, 3, capacity // 2]) or 1 for _ in range(rnd.randint(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    steps = P.best_fit_decreasing(counts, capacity)
    filled: dict[int, list] = {}
    for s in steps:
        for i in range(s.count):
            filled.setdefault(s.sequence + i // s.each, []).append((s.offset + i % s.each * s.length, s.length))
    assert sum(map(len, filled.values())) == len(lengths)
    for items in filled.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    want = sorted(plain_best_fit(lengths, capacity))
    assert sorted(capacity - sum(n for _, n in x) for x in filled.values()) == want
    assert sorted(filled) == list(range(len(want)))


def test_encoder_equals_tokenizer():
    tok = Tokenizer.from_file(P.tokenizer_path())
    texts = ["", " ", "a b", "a  b", "a \nb", "a\n b", "a\n\n  b c ", "it's 12  3 ' s", "x<|endoftext|>y z", "é ü ß  x", "\ta b\r\n c", "'s 's", "tail ", "a b  c", "日本 語 1,5 km."]
    rnd = random.Random(1)
    texts += ["".join(rnd.choice("ab é\n\t '1s.,  ") for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += [r["text"] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").df().to_dict("records")]
    enc = P.Encoder(P.tokenizer_path())
    assert enc.fast
    got = enc.encode(texts)
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_packs_documents(spark):
    tok = Tokenizer.from_file(P.tokenizer_path())
    docs = table(spark, SF, "documents")
    rows = P.pack(docs).toPandas()
    want, lengths = {}, []
    for r in docs.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r["doc_id"], k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            lengths.append(b - a)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows.itertuples()} == want
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum().to_numpy()[:-1]])).all()
        assert g.length.sum() <= 1024
    assert rows.sequence_id.nunique() == len(plain_best_fit(lengths, 1024))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", "z"), (5, "word " * 5000, "w")], "doc_id long, text string, length string")
    rows = P.pack(docs, with_ids=True)
    got = rows.toPandas()
    assert len(got[got.length == 1]) >= 3 and set(got.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    seq = P.sequences(rows).collect()
    assert sum(r["length"] for r in seq) == got.length.sum() and all(len(r["input_ids"]) == 4 * r["length"] for r in seq)
    assert P.pack(docs.limit(0)).count() == 0


def test_other_tokenizers():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    enc = P.Encoder(path)
    assert enc.fast is None
    assert np.frombuffer(enc.encode(["Some words"])[0], "<u4").tolist() == Tokenizer.from_file(path).encode("Some words", add_special_tokens=False).ids
