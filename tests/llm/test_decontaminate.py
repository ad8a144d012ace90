"""Decontamination against the similarity of every item-sized window."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import pytest
import regex

from strandline.llm import decontaminate as dc
from strandline.llm.queries import QUERIES
from tests.conftest import plan_of

DOCS = "doc_id long, text string, row string, item_id string"
ITEMS = "item_id long, text string, size string"


def words_of(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def grams(words):
    return Counter(" ".join(words[i : i + 5]) for i in range(len(words) - 4))


def similarity(a, b):
    keys = a.keys() | b.keys()
    total = sum(len(k) * max(a[k], b[k]) for k in keys)
    return sum(len(k) * min(a[k], b[k]) for k in keys) / total if total else 0.0


def brute(docs, items, least=0.8, cut=True):
    """Best similarity over all windows of the item's size, those that the text's ends shorten
    among them unless ``cut`` is false, per (doc, item) that reaches it."""
    out = {}
    holders = defaultdict(set)
    prepared = {i: words_of(t) for i, t in items if i is not None}
    for i, words in prepared.items():
        for g in grams(words):
            holders[g].add(i)
    for doc, text in docs:
        words = words_of(text)
        close = set().union(*(holders.get(g, ()) for g in grams(words)))
        for i in close:
            n, want = len(prepared[i]), grams(prepared[i])
            inside = range(0, max(1, len(words) - n + 1))
            for start in range(-n + 5, len(words) - 4) if cut else inside:
                s = similarity(grams(words[max(start, 0) : start + n]), want)
                if s >= least:
                    out[doc, i] = max(s, out.get((doc, i), 0))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}{'x' * (k % 9)}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(5, 60)))) for i in range(30)]
    items += [(31, "a b c d"), (32, None), (None, "n n n n n"), (33, "la " * 20), (0, items[0][1])]
    items += [(34, items[4][1] + " tail")]
    docs = []
    for d in range(80):
        words = text(rng.randrange(0, 120))
        kind = d % 4
        if kind:
            item = words_of(rng.choice(items[:30])[1])
            for _ in range(kind - 1):
                item[rng.randrange(len(item))] = "changed"
            if d % 8 == 3:
                item.insert(len(item) // 2, "inserted")
            at = rng.choice([0, len(words), rng.randrange(len(words) + 1)])
            words[at:at] = item
        docs.append((d, ", ".join(words).upper() if d % 3 else " \n".join(words)))
    docs += [(100, None), (101, ""), (102, "la " * 3000), (None, items[2][1]), (5, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_window(rows, seed):
    docs, items = corpus(seed)
    got = dc.matches(
        rows(DOCS, [(*d, "a", "b") for d in docs]), rows(ITEMS, [(*i, "c") for i in items])
    ).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert len(found) == len(got)
    want = brute(docs, items)
    assert found.keys() == want.keys()
    assert all(abs(found[k] - s) < 1e-9 for k, s in want.items())


def test_clean_drops_matching_rows_only(rows):
    item = "the quick brown fox jumps over the lazy dog today"
    docs = [(1, "x " + item), (1, "other"), (2, "the quick brown fox"), (None, item), (None, "y"), (3, None)]
    kept = dc.clean(rows(DOCS, [(*d, "a", "b") for d in docs]), rows(ITEMS, [(1, item, "c")]))
    assert kept.columns == ["doc_id", "text", "row", "item_id"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(1, "other"), (2, "the quick brown fox"), (None, "y"), (3, None)], key=repr
    )


def test_empty_tables(rows):
    docs, items = rows(DOCS, []), rows(ITEMS, [])
    assert dc.matches(docs, items).collect() == []
    assert dc.matches(rows(DOCS, [(1, "a b c d e f", "", "")]), items).collect() == []
    assert dc.matches(docs, rows(ITEMS, [(1, "a b c d e f", "")])).collect() == []


def test_no_python_in_the_plan(spark, small):
    found = QUERIES["op8_simhash_decontamination"](spark, small)
    assert not any(word in plan_of(found) for word in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_query_finds_planted_items(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in QUERIES["op8_simhash_decontamination"](spark, small).collect()}
    want = {(d, i) for d, t in docs for i, b in items if " ".join(words_of(b)) in " ".join(words_of(t))}
    assert want and want <= found
    assert found <= brute(docs, items).keys()


@pytest.mark.parametrize("seed", [1, 2])
def test_every_window_without_allowance(rows, seed):
    """Words moved, inserted, left out and changed: the best window of all is found."""
    rng = random.Random(seed)
    docs, items = corpus(seed)
    vocabulary = [f"v{k}{'y' * (k % 7)}" for k in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for d, (_, item) in enumerate(items[:30] * 4):
        words = words_of(item)
        cut = (len(words) // 2, rng.randrange(len(words)))[d % 2]
        kind = d // 30
        if kind == 0:
            words = words[cut:] + words[:cut]
        if kind in (1, 3):
            words.insert(cut, "inserted")
        if kind in (2, 3):
            del words[rng.randrange(len(words))]
        docs.append((1000 + d, " ".join(text(rng.randrange(80)) + words + text(rng.randrange(80)))))
    got = dc.matches(
        rows(DOCS, [(*d, "a", "b") for d in docs]), rows(ITEMS, [(*i, "c") for i in items])
    ).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert len(found) == len(got)
    want = brute(docs, items)
    assert found.keys() == want.keys()
    assert all(abs(found[k] - s) < 1e-9 for k, s in want.items())


def test_seeds_outweigh_what_may_be_missing(rows):
    """An item of 25 equal shingles without the five heaviest is at 0.8 exactly."""
    words = [f"{k:04d}" for k in range(29)]
    doc = " ".join(words[:24])  # 20 of 25 shingles, in a window that the text's ends shorten
    for item in (words, words[::-1]):
        text = doc if item is words else " ".join(words[::-1][:24])
        docs, items = [(1, text, "", "")], [(1, " ".join(item), "")]
        assert [r.similarity for r in dc.matches(rows(DOCS, docs), rows(ITEMS, items)).collect()] == [0.8]
    for item in (words, words[::-1]):
        docs, items = [(1, " ".join(item[5:]), "", "")], [(1, " ".join(item), "")]
        assert [r.similarity for r in dc.matches(rows(DOCS, docs), rows(ITEMS, items)).collect()] == [0.8]


def test_phrase_shared_by_many_items(rows):
    """A phrase of all items is no seed of theirs: texts with it alone meet no item."""
    phrase = "according to the latest report we know"
    items = [(i, f"{phrase} " + " ".join(f"own{i}x{k}" for k in range(20))) for i in range(200)]
    docs = [(d, " ".join(f"w{d}x{k}" for k in range(100)) + f" {phrase} ") for d in range(20)]
    docs.append((99, "before it " + items[7][1] + " and after"))
    df = rows("doc_id long, text string, match_id int, match_hash int", [(*r, 1, 1) for r in docs])
    table = rows("item_id long, text string", items)
    began = time.time()
    found = [(r.doc_id, r.item_id) for r in dc.matches(df, table).collect()]
    assert found == [(99, 7)] and time.time() - began < 30
    left = dc.clean(df, table)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == list(range(20))


@pytest.mark.parametrize("radius", [0, 2, 9, 20])
def test_index_finds_all_within_the_radius(rows, radius):
    rng = random.Random(radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [(rng.choice([5, 9]), rng.getrandbits(64)) for _ in range(12)] + [(5, 0), (5, 2**64 - 1)]
    prints = [(n, rng.getrandbits(64)) for n in (5, 9) for _ in range(100)]
    for n, fp in items:
        for differ in {0, 1, radius - 1, radius, radius + 1, radius + 8}:
            flip = sum(1 << b for b in rng.sample(range(64), max(differ, 0)))
            prints.append((n, fp ^ flip))
        prints.append((n, fp ^ ((1 << radius) - 1)))
    table = lambda data: rows("size int, fp long", [(n, signed(x)) for n, x in data])
    got = dc.near_items(table(prints + prints[:9]), table(items + items[:3]), radius).collect()
    want = {
        (n, signed(x), signed(y))
        for n, x in prints
        for m, y in items
        if n == m and (x ^ y).bit_count() <= radius
    }
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_sliding_fingerprints_equal_those_of_each_window(rows):
    rng = random.Random(3)
    for n, width in [(1, 1), (7, 3), (20, 20), (30, 44), (70, 9)]:
        words = [f"{rng.randrange(30)}{'z' * rng.randrange(9)}" for _ in range(n)]
        first, last = -(width - 1), n - 1
        df = rows("w array<string>", [(words,)])
        slid = dc.sliding_simhashes(
            dc.weighted(dc.F.col("w")), dc.F.lit(first), dc.F.lit(last), dc.F.lit(width)
        )
        each = [
            dc.simhash(dc.weighted(dc.F.array(*map(dc.F.lit, words[max(s, 0) : s + width]))))
            for s in range(first, last + 1)
        ]
        found = df.select(slid.alias("a"), dc.F.array(*each).alias("b")).collect()[0]
        assert found.a == found.b


def test_item_of_thousands_of_words(rows):
    """A long item is found where words of it are changed, in a text with hits all over."""
    rng = random.Random(4)
    words = [f"k{rng.randrange(900)}" for _ in range(2_000)]
    changed = [w if i % 60 else "other" for i, w in enumerate(words)]
    docs = [(1, " ".join(["before"] * 300 + changed + ["after"] * 300)), (2, " ".join(words[:900]))]
    began = time.time()
    got = dc.matches(
        rows("doc_id long, text string", docs), rows("item_id long, text string", [(5, " ".join(words))])
    ).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)] and time.time() - began < 120


def test_the_index_does_not_pass_the_driver(spark, tmp_path):
    """Few items make a small file and an index of 14,000 rows each, which must be shuffled."""
    path = str(tmp_path / "prints")
    spark.createDataFrame([(9, x * 7_919) for x in range(40)], "size int, fp long").write.parquet(path)
    prints = spark.read.parquet(path)
    found = dc.near_items(prints, prints, 20)
    assert "BroadcastHashJoin" not in plan_of(found)
    near = {(x * 7_919, y * 7_919) for x in range(40) for y in range(40)
            if (x * 7_919 ^ y * 7_919).bit_count() <= 20}
    assert {(r.fp, r.item_fp) for r in found.collect()} == near
