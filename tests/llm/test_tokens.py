import random

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import tokens as K
from ledgerline.llm.common import table

SF = "/root/testdata/sf0.001"


def library(path):
    tok = Tokenizer.from_file(path)
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    letters = list("abestABST'’ 12½²٣éÉßİΣσςǅﬁ́̈  ​\x1c\x85\t\n\r\x0b\x0c.,!?<|>_-日本語😀👍🏽") + [
        "'s", "'LL", "'re", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "the ", " and", "1,234.5", "naïve ", "ĿŁ", "ﬁ", "﻿", "\x00",
    ]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_proved_strings_encode_alone_as_one_token():
    path = K.tokenizer_path()
    tok = Tokenizer.from_file(path)
    whole = K.whole_tokens(path)
    assert 30_000 < len(whole) <= tok.get_vocab_size()
    ascii_words = [w for w in whole if w.isascii() and w.isalpha()]
    for w in ascii_words[:4000]:
        assert len(tok.encode(w, add_special_tokens=False).ids) == 1, w
    # vocabulary entries that only stand inside words are not proved
    assert all(len(tok.model.tokenize(v)) != 1 for v in ("thr", "wh") if v not in whole)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_equal_the_library(name):
    path = public_tokenizers.path(name)
    want, c = library(path), K.Counter(path)
    texts = odd_texts(4000) + ["", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "x" * 5000, "'" * 300, "don't we'll I'M", "ＦＵＬＬ wide"]
    texts += [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null").fetchall()][: None if "word" in name else 60]
    for t in texts:
        assert c.count(t.encode())[0] == want(t), repr(t)


def test_sentencepiece_file():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    c = K.Counter(path)
    for t in ["", " a  b", "<s> it's", *odd_texts(100)]:
        assert c.count(t.encode())[0] == len(sp.encode(t))


def test_memory_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(K, "REMEMBERED", 3)
    c, want = K.Counter(K.tokenizer_path()), library(K.tokenizer_path())
    t = " ".join(f"word{i} the {'z' * i}" for i in range(90))
    assert c.count(t.encode())[0] == want(t) and len(c.known) <= 3


def test_whole_query(spark):
    from ledgerline.llm.queries import op11_token_counts

    want = library(K.tokenizer_path())
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}
    got = op11_token_counts(spark, SF).collect()
    assert len(got) == len(docs) and {r["doc_id"] for r in got} == set(docs)
    for r in got:
        t = docs[r["doc_id"]]
        assert r["n_bytes"] == len(t.encode()) and r["n_tokens"] == want(t) and r["over_limit"] == (r["n_tokens"] > 2048)
        assert 0 <= r["n_whole"] <= r["n_tokens"]


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "y"), (2, "a b", "y"), (2, "a b", "y"), (None, "Don't <|endoftext|>", "z"), (5, "word " * 30000, "w")],
        "doc_id long, text string, n_tokens string",
    )
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in K.token_counts(docs).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (2, 3, 2, False), (2, 3, 2, False), (None, 19, 3, False), (5, 150000, 30000, True)], key=str)
    assert K.token_counts(docs.limit(0)).count() == 0
    total = K.totals(K.token_counts(docs)).first()
    assert (total["n_docs"], total["n_tokens"], total["n_over_limit"]) == (6, 30007, 1)
    assert K.totals(K.token_counts(docs.limit(0))).first()["n_tokens"] == 0
