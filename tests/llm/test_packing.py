"""Packing against the tokenizer itself, and the placement rules by replay."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, length string, sequence_id string"
TEXTS = [
    (1, None), (2, ""), (3, " a  b\n\nc \n d "), (4, "<|endoftext|> it's I'll  y　z"),
    (5, " lead"), (6, "trail "), (7, "a\x1c b \t c"), (8, "same"), (8, "same"),
    (None, "no id"), (9, "word " * 5000), (10, "é😀 ß" * 700), (11, "x" * 50_000),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_equal_the_tokenizer(spark, small, tokenizer):
    encode = packing.word_ids(PATH).document
    texts = [t for _, t in TEXTS if t] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "y<|endoftext|>."]
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts += ["a word, word. é!! x'|| 9.. don't.) ½* ʰ. ... ,a ª. 漢。 漢,", "l'été, d'*** a1### ②! ǅ?"]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode(text), "<u4").tolist() == want


def test_new_words_are_encoded_together(tokenizer):
    """A call for each text's first word and one for each stretch of texts, not one a word."""
    odd = ["end\n", "", "x" * 70, "(a)", "it's,", "1.5.", "é!", "漢。漢", "a\nb", "y\u00a0z", "Ġx"]
    texts = [f"{w} n{k}w {w} q{k}. {w}" for k, w in enumerate(odd * 18)] + [None, "", "a  b", " "]
    ids = packing.WordIds(PATH)
    calls = []
    plain = ids.text
    ids.text = lambda s: calls.append(s) or plain(s)
    got = list(ids.documents(texts))
    assert [np.frombuffer(g, "<u4").tolist() + [2] for g in got] == [ids_of(tokenizer, t) for t in texts]
    assert len(calls) < 2 * len(texts)  # each has two words of its own


def test_pieces_and_places(rows, tokenizer):
    df = rows(SCHEMA, [(*r, "a", "b", "c") for r in TEXTS])
    got = packing.pack(df, PATH, capacity=64, with_ids=True).collect()
    by_doc = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert len(r.ids) == r.length <= 64
        by_doc[r.doc_id].append(r)
    for doc, text in TEXTS:
        copies = sum(d == doc for d, _ in TEXTS)
        parts = sorted(by_doc[doc], key=lambda r: r.piece)[::copies]
        assert [i for r in parts for i in r.ids] == ids_of(tokenizer, text)
        assert [r.start for r in parts] == [sum(x.length for x in parts[:k]) for k in range(len(parts))]
        assert all(r.length == 64 for r in parts[1:])
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    least = -(-sum(r.length for r in got) // 64)
    assert len(filled) <= least + 1


def test_sequences_hold_the_ids(rows, tokenizer):
    df = rows(SCHEMA, [(*r, "a", "b", "c") for r in TEXTS])
    whole = packing.sequences(packing.pack(df, PATH, with_ids=True)).collect()
    want = sorted(i for _, t in TEXTS for i in ids_of(tokenizer, t))
    assert sorted(i for r in whole for i in r.ids) == want
    assert all(len(r.ids) <= 1024 for r in whole)


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert bins.place(4) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(8) == (2, 0)  # bin 1, with 3 free, was the fullest and is closed
    assert bins.place(3) == (0, 4)
    assert bins.place(2) == (2, 8)
    assert bins.place(10) == (3, 0)
    assert bins.place(3) == (0, 7)
    assert bins.open == 0


def test_bins_never_exceed_the_limit():
    rng = np.random.default_rng(7)
    bins, used = packing.OpenBins(100, 5), defaultdict(int)
    for need in rng.integers(1, 101, 3000).tolist():
        chosen, offset = bins.place(need)
        assert used[chosen] == offset
        used[chosen] += need
        assert used[chosen] <= 100 and bins.open <= 5


def test_empty_table(rows):
    assert packing.pack(rows(SCHEMA, []), PATH).collect() == []
