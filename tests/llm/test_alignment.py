"""Alignment against whole-text encodings and plain counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from strandline.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, part string, block string, at string"
TEXTS = [
    None, "", " ", "\n", "a", " a  b\n\nc \n d ", "<|endoftext|> it's I'll </s> <0x41>", "▁ has", "x▁y",
    "y　z q", "a\x1c b \t c\r\nd\n\n\ne", "same", "same", "é😀 ß\n漢字 ок\0 z", "  lead", "trail  ", "x" * 5000,
    "word " * 3000, "don't 12345 3.14\n- a\n- b", "a\n", "a \n", "\t\n\tb",
]


@pytest.fixture(scope="module")
def tokens():
    return alignment.Pair(A, B)


def brute(tokens, texts):
    """Rows by a walk over whole encodings."""
    rows, counts = [], Counter()
    for text in texts:
        full = (" " + (text or "")).encode()
        a = tokens.a.encode(full.decode(), add_special_tokens=False).ids if text else []
        b = tokens.b.encode(text) if text else []
        joined = [b"".join(t[x] for x in ids) for t, ids in ((tokens.bytes_a, a), (tokens.bytes_b, b))]
        if not text or joined != [full, full]:
            rows.append((0, 0, [], ""))
            continue
        ends = []
        for table, ids in ((tokens.bytes_a, a), (tokens.bytes_b, b)):
            at, found = 0, {}
            for k, x in enumerate(ids):
                at += len(table[x])
                found[at] = k
            ends.append(found)
        links, groups, i, j = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            k, m = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
            links.append((b[m], a[k]))
            i, j = k + 1, m + 1
        rows.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(links)
    best = defaultdict(int)
    for (b_id, _), n in counts.items():
        best[b_id] = max(best[b_id], n)
    return [
        (n_a, n_b, len(links), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), sha)
        for n_a, n_b, links, sha in rows
    ]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_whole_encodings(rows, tokens):
    texts = TEXTS + TEXTS[:3]
    ids = [None, *range(1, len(texts))]
    df = rows(SCHEMA, [(i, t, "p", "b", "a") for i, t in zip(ids, texts, strict=True)])
    want = sorted(((i, *r) for i, r in zip(ids, brute(tokens, texts), strict=True)), key=repr)
    got = alignment.align(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == want
    assert rows_of(alignment.align(df, A, B, parts=3, block_docs=2, block_units=5)) == want


def test_given_documents(spark, small, tokens):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = docs.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, *x) for r, x in zip(known, brute(tokens, [r.text for r in known]), strict=True)), key=repr)
    assert rows_of(alignment.align(docs, A, B)) == want


def test_units_encode_alone_as_in_the_text(tokens):
    rng = random.Random(5)
    signs = ["a", "B", " ", " ", "\n", "\t", "\r", "'s", "9", ".", "é", "漢", "　", "\x1c", "\0", "the", "</s>", "\x85"]
    for _ in range(3000):
        full = " " + "".join(rng.choices(signs, k=rng.randint(1, 14)))
        parts = alignment.units(full)
        assert "".join(parts) == full and "" not in parts
        a, b = tokens.encode(parts)
        assert sum(a, []) == tokens.a.encode(full, add_special_tokens=False).ids
        assert sum(b, []) == tokens.b.encode(full[1:])


def test_many_runs_merge_in_rounds(rows, tokens, monkeypatch):
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    texts = [f"common words {k} here" for k in range(40)] + ["common"] * 60
    df = rows(SCHEMA, [(k, t, "", "", "") for k, t in enumerate(texts)])
    want = sorted(((k, *r) for k, r in enumerate(brute(tokens, texts))), key=repr)
    assert rows_of(alignment.align(df, A, B, parts=2, block_docs=1)) == want


def test_empty_table(rows):
    assert alignment.align(rows(SCHEMA, []), A, B).collect() == []
