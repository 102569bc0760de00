"""Token counts of whole texts by the whole-token shortcut.

Many pre-tokens (words after the tokenizer's own normalisation and splitting) are
entries of the vocabulary, and the merges of most of these end in that one entry.
:func:`whole_tokens` proves this once per tokenizer file: it runs the merges on every
vocabulary string by itself and keeps those that end as one token. A pre-token is
merged without regard to its neighbours, so the proof holds wherever it occurs.
Counting then looks every pre-token up: members of the proved set count one token,
only the rest is merged. The proved set is bounded by the vocabulary.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import text as T
from ledgerline.llm.common import texts

#: documents above this many tokens are marked
LIMIT = 2048
#: a task remembers the counts of this many different words, then starts anew
REMEMBERED = 1 << 18
#: longer words are counted each time
REMEMBERED_BYTES = 64

#: fixed value: this split drops all white space, so that words apart by ASCII white
#: space are normalised, split and merged independently of each other
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: what the split above finds in lower-cased ASCII words
_ASCII_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def whole_tokens(path: str) -> frozenset[str]:
    """The pre-tokens (in the tokenizer's own alphabet) whose merges end in one token.

    Every vocabulary string, without the tokenizer's word-end mark, is merged alone;
    it is kept if one token comes out. Strings that the merges do not reach (parts of
    the vocabulary that stand only inside words, entries shadowed by an earlier merge)
    fail the test and are left to the merges."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    tokenizer = Tokenizer.from_file(path)
    end = model.get("end_of_word_suffix") or ""
    names = (v[: len(v) - len(end)] for v in model["vocab"] if v.endswith(end))
    return frozenset(v for v in names if v and len(tokenizer.model.tokenize(v)) == 1)


class Counter:
    """Token counts of texts by one tokenizer file. ``count`` gives (tokens, tokens counted
    by the shortcut): .json files through the proved set, .model files by their library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[bytes, int] = {}
        self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.shortcut = spec["model"].get("type") == "BPE"
        self.whole = whole_tokens(path) if self.shortcut else frozenset()
        added = spec.get("added_tokens") or []
        # an added token takes part in the split only if it is found before normalisation
        # and takes no white space or word boundary into account
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        self.marks = sorted((t["content"] for t in added), key=len, reverse=True) if plain else None
        self.at_marks = re.compile("|".join(map(re.escape, self.marks))) if self.marks else None
        self.by_word = self.shortcut and plain and _splits_words(spec)
        self.post = spec.get("post_processor") is not None

    def _merged(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize(piece))

    def _pieces(self, pieces) -> int:
        """Packed count of pre-tokens: all tokens, and above bit 40 those of the shortcut."""
        whole = self.whole
        total = 0
        for p in pieces:
            total += (1 << 40) + 1 if p in whole else self._merged(p)
        return total

    def _plain(self, text: str) -> int:
        """A text without added tokens, through the library's own normaliser and splitter."""
        if not text:
            return 0
        t = self.tokenizer
        if t.normalizer is not None:
            text = t.normalizer.normalize_str(text)
        pieces = t.pre_tokenizer.pre_tokenize_str(text) if t.pre_tokenizer is not None else [(text, None)]
        return self._pieces(p for p, _ in pieces)

    def _any(self, text: str) -> int:
        if self.at_marks is None:
            return self._plain(text)
        return sum(map(self._plain, self.at_marks.split(text))) + len(self.at_marks.findall(text))

    def _word(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if word.isascii() and text.isprintable() and not (self.at_marks and self.at_marks.search(text)):
            # printable ASCII is its own byte alphabet, and its normal form is its lower case
            return self._pieces(_ASCII_SPLIT.findall(text.lower()))
        return self._any(text)

    def __missing__(self, word: bytes) -> int:
        n = self._word(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = n
        return n

    def count(self, data: bytes) -> tuple[int, int]:
        if self.pieces is not None:
            return len(self.pieces.encode(data.decode("utf-8", "replace"), num_threads=1)), 0
        if not self.shortcut or self.marks is None:
            return len(self.tokenizer.encode(data.decode("utf-8", "replace"), add_special_tokens=False).ids), 0
        if not self.by_word:
            n = self._any(data.decode("utf-8", "replace"))
        else:
            known, miss = self.known.get, self.__missing__
            n = 0
            # bytes.split() cuts at ASCII white space only
            for word in data.split():
                k = known(word)
                n += miss(word) if k is None else k
        return n & ((1 << 40) - 1), n >> 40


def _splits_words(spec: dict) -> bool:
    """Whether the file's split is WORD_SPLIT over a normaliser that keeps ASCII words apart."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers") or []]
    return (
        norm == ["NFC", "Replace", "Lowercase"]
        and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
        and pre[0].get("pattern") == {"Regex": WORD_SPLIT}
        and pre[0].get("invert") is True
        and pre[0].get("behavior") == "Removed"
        and pre[1].get("add_prefix_space") is False
        and pre[1].get("use_regex") is False
    )


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One counter per worker process and file."""
    return Counter(path)


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            offsets, data = T.buffers(batch.column(1))
            raw = memoryview(data)
            got = [c.count(bytes(raw[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            tokens = pa.array([n for n, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array((offsets[1:] - offsets[:-1]).astype("int64")),
                    tokens,
                    pa.array([n > limit for n, _ in got], pa.bool_()),
                    pa.array([k for _, k in got], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"],
            )

    return run


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_whole) of every row of ``docs``.

    ``n_tokens`` is what the file's library gives for the whole text without begin, end or
    added special tokens; special strings inside a text are handled as its default (one
    token each). ``n_whole`` of them were counted by the shortcut.

    A null text counts as empty (0 tokens); rows with a null or repeated id are counted as
    they stand; an empty table gives no rows; other columns, whatever their names, are not
    read. No row, text or word is cut: a long text streams through one task, which holds
    that text and at most REMEMBERED short words."""
    rows = texts(docs, id_col, text_col)
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long"
    return rows.mapInArrow(_count(path or tokenizer_path(), limit), schema)


def totals(counts: DataFrame) -> DataFrame:
    """One row: documents, bytes, tokens, tokens counted by the shortcut, documents over the limit."""
    return counts.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum("n_whole"), F.lit(0)).alias("n_whole"),
        F.coalesce(F.sum(F.col("over_limit").cast("long")), F.lit(0)).alias("n_over_limit"),
    )
