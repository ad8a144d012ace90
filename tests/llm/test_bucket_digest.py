"""Digests against plain counting, next documents against a sorted list."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest

from strandline.llm import bucket_digest as bd

SCHEMA = "doc_id long, text string, chunk int, edge int, hash long"


def brute_digest(text):
    data = text.encode()
    counts = Counter()
    for k in range(len(data) - 2):
        value = data[k] | data[k + 1] << 8 | data[k + 2] << 16
        counts[(value * 2654435761 % 2**32) >> (32 - round(math.log2(bd.BUCKETS)))] += 1
    every = [counts[b] for b in range(bd.BUCKETS)]
    ranked = sorted(every)
    limits = [ranked[bd.BUCKETS * q // 4 - 1] for q in (1, 2, 3)]
    codes = [sum(n > x for x in limits) for n in every]
    packed = bytes(sum(codes[4 * k + j] << 2 * j for j in range(4)) for k in range(bd.BUCKETS // 4))
    return packed + round(8 * math.log2(len(data) + 1)).to_bytes(2, "big"), codes


def brute_likeness(one, other):
    (a, x), (b, y) = brute_digest(one), brute_digest(other)
    if a == b:
        return 1.0
    apart = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(p - q)] for p, q in zip(x, y, strict=True))
    steps = abs(int.from_bytes(a[-2:], "big") - int.from_bytes(b[-2:], "big"))
    return max(0.0, 1 - apart / (3.25 * bd.BUCKETS) - min(0.25, steps / 64))


def brute(docs):
    """docs in order: (id, text)."""
    out = []
    for k, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        out.append(
            (
                doc,
                len(text),
                hashlib.sha256(changed.encode()).hexdigest(),
                brute_digest(text)[0].hex(),
                brute_digest(changed)[0].hex(),
                round(brute_likeness(text, changed), 9),
                round(brute_likeness(text, after), 9),
            )
        )
    return sorted(out, key=repr)


def got(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=repr)


def test_small_tables(rows):
    texts = [None, "", "a", "ab", "é😀" * 9, "the quick brown fox " * 40, "x" * 30_000, "漢字かな" * 50, "same", "same"]
    docs = [(3 * k - 7, t) for k, t in enumerate(texts)]
    for part in (docs, docs[:1], docs[4:6]):
        df = rows(SCHEMA, [(*r, 1, 1, 1) for r in part])
        assert got(bd.fingerprints(df)) == brute(part)


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert got(bd.fingerprints(docs)) == brute(known)


def test_null_and_repeated_ids(rows):
    data = [(None, "no id"), (1, "one"), (1, "one"), (1, "one"), (2, "two")]
    df = rows(SCHEMA, [(*r, 1, 1, 1) for r in data], 4)
    assert got(bd.fingerprints(df)) == brute(data)
    hot = [(5, "text one")] * 200 + [(5, "text two")] * 200
    found = got(bd.fingerprints(rows(SCHEMA, [(*r, 1, 1, 1) for r in hot], 4)))
    assert len(found) == 400 and sum(r[6] < 1 for r in found) == 2


def test_text_ids(rows):
    data = [("a", "first text"), ("b", "second text")]
    df = rows("doc_id string, text string", data)
    assert got(bd.fingerprints(df)) == brute(data)


def test_half_edits_are_nearer_than_neighbours(spark, small):
    found = bd.fingerprints(spark.read.parquet(f"{small}/documents.parquet"))
    kept = found.where("n_chars >= 200 and near_next < 1").collect()
    assert sum(r.near_edited > r.near_next for r in kept) >= 0.99 * len(kept)


@pytest.mark.parametrize("one, other", [("", ""), ("", "a" * 5000), ("abc", "abd")])
def test_likeness_is_bounded(one, other):
    a, b = bd.digest(one), bd.digest(other)
    assert 0 <= bd.likeness(a, b) <= 1 and bd.likeness(a, a) == 1


def test_empty_table(rows):
    assert bd.fingerprints(rows(SCHEMA, [])).collect() == []
