"""SimHash links against all pairs, and components against union-find."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash_dedup as sd
from strandline.llm.components import components
from strandline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, fp string, fingerprint string"


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for u, v in edges:
        root[max(find(u), find(v))] = min(find(u), find(v))
    return {n: find(n) for n in nodes}


def linked(fps, radius):
    nodes = sorted(set(fps))
    return classes(
        nodes,
        [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= radius],
    )


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for text in ["", "  ", "One", "one Two", "A b c d a b c d Äé\x0bÀ", "x " * 70_000, None]:
        assert sd.fingerprint((text or "").encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("bucket_rows", [2, 32])
@pytest.mark.parametrize("radius", [0, 2, 4])
def test_links_reach_what_all_pairs_reach(spark, bucket_rows, radius):
    rng = random.Random(radius)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0]
    for _ in range(400):
        x = rng.choice(fps)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    want = linked(fps, radius)
    nodes = spark.createDataFrame([(signed(f),) for f in set(fps)], "fp long").repartition(3)
    got = {r.node: r.root for r in components(sd.links(nodes, radius, bucket_rows)).collect()}
    groups = {}
    for f in set(fps):
        groups.setdefault(got.get(signed(f), signed(f)), set()).add(want[f])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(want.values()))


def test_plan_follows_the_principle():
    rng = np.random.default_rng(3)
    bits = (rng.random((4000, 64)) < rng.random(64) * 0.9).astype(np.int64)
    bits[:, 1] = bits[:, 40]
    together = bits.T @ bits
    for radius in (0, 2, 4):
        for parts in range(1, radius + 3):
            plan = sd.allocate(4000, together, radius, parts)
            assert sum(plan.thresholds) == radius - parts + 1
            assert sorted(b for g in plan.groups for b in g) == list(range(64))
    groups = sd.grouped_bits(4000, together, 4)
    assert any({1, 40} <= set(g) for g in groups)
    big = sd.probe_plan(10**9, together * 250_000, 2)
    assert len(big.groups) < len(sd.probe_plan(4000, together, 2).groups)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 7), (2000, 2001), (5, 5)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(3)
    want = classes({n for e in edges if e[0] != e[1] for n in e}, edges)
    assert {r.node: r.root for r in components(df).collect()} == want
    assert components(df.where("u < 0")).collect() == []


def test_documents(rows):
    base = " ".join(f"word{i}" for i in range(400))
    data = [
        (9, base), (4, base.upper()), (7, base + " more"), (3, None), (8, ""), (2, " \n"),
        (5, "quite another text"), (5, "quite another text"), (None, base), (None, "nobody"),
        (11, "long " * 60_000),
    ]
    df = rows(SCHEMA, [(*r, "a", "b") for r in data])
    got = sd.near_duplicates(df).collect()
    assert len(got) == len(data)
    fps = {t: plain_fingerprint(t) for _, t in data}
    want = linked(fps.values(), 2)
    least = {}
    for doc, text in data:
        if doc is not None:
            least[want[fps[text]]] = min(doc, least.get(want[fps[text]], doc))
    expected = [(d, f"{fps[t]:016x}", least.get(want[fps[t]])) for d, t in data]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    kept = sd.keep_one(df).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert ids == sorted({c for d, _, c in expected if d is not None})
    assert sum(r.doc_id is None for r in kept) == 2
    assert set(kept[0].asDict()) == set(df.columns)


def test_repeated_ids_with_other_texts(rows):
    other = "quite another text that no row is a near copy of"
    data = [(1, "a b c d"), (1, other), (0, "a b c d"), (7, "seven w x y"), (7, "seven w x y"), (7, None), (3, "")]
    kept = sd.keep_one(rows("doc_id long, text string, kept_id int, fp int", [(*r, 1, 2) for r in data]))
    assert kept.columns == ["doc_id", "text", "kept_id", "fp"]
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    assert got == [(0, "a b c d"), (1, other), (3, ""), (7, "seven w x y")]


def test_empty_table(rows):
    assert sd.near_duplicates(rows(SCHEMA, [])).collect() == []


def test_query_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    want = linked(fps.values(), 2)
    least = {}
    for doc, fp in fps.items():
        least[want[fp]] = min(doc, least.get(want[fp], doc))
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_simhash_near_dedup"](spark, small).collect()}
    assert got == {d: (f"{fp:016x}", least[want[fp]]) for d, fp in fps.items()}
