"""Divergence rules against plain Python, and against their SQL."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
import regex

import check
from strandline.llm import quality_rules as qr
from strandline.llm.queries import QUERIES, SQL
from tests.conftest import plan_of

SCHEMA = "doc_id long, text string, lang string, n_words string, words string"


def base(text):
    text = text or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {
        i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)
    }
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(regex.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
        len(words) < 20 or 100 * len(inside) > 30 * len(words),
    )


def bins(text, lang):
    text = text or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    known = qr.COMMON_WORDS.get(lang) or sorted({w for k in qr.COMMON_WORDS.values() for w in k})
    common = [words.count(w) for w in known]
    kinds = [len(regex.findall(c, text)) for c in qr.CLASSES]
    return kinds + [len(text) - sum(kinds)], common + [len(words) - sum(common)]


def distance(p, q):
    p, q = [x / (sum(p) or 1) for x in p], [x / (sum(q) or 1) for x in q]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def brute(data, min_words=50, min_texts=20):
    sums, texts = {}, Counter()
    for _, text, lang in data:
        n, *_, failed = base(text)
        if failed or n < min_words:
            continue
        texts[lang or ""] += 1
        for kind, counts in enumerate(bins(text, lang)):
            total = sums.setdefault((lang or "", kind), [0] * len(counts))
            for i, c in enumerate(counts):
                total[i] += math.floor(c * 1_000_000 / max(sum(counts), 1))
    out = []
    for doc, text, lang in data:
        found = base(text)
        kept, n = not found[-1], found[0]
        if n >= min_words and texts[lang or ""] >= min_texts:
            far = [distance(b, sums[lang or "", k]) for k, b in enumerate(bins(text, lang))]
            kept = kept and far[0] <= 0.12 + 0.9 / math.sqrt(n) and far[1] <= 0.08 + 2.9 / math.sqrt(n)
        out.append((doc, *found, kept))
    return sorted(out, key=repr)


def made():
    rng = random.Random(5)
    data = []
    for d in range(160):
        lang = ("en", "de", None, "xx")[d % 4]
        words = qr.COMMON_WORDS.get(lang, qr.COMMON_WORDS["fr"]) + [f"own{'x' * k}," for k in range(40)]
        text = [rng.choice(words) for _ in range(rng.choice([10, 60, 200, 900]))]
        if d % 11 == 0:
            text = [w.upper() + "##" for w in text]
        if d % 7 == 0:
            text += text[:12] * rng.randrange(1, 20)
        data.append((d, "".join(w + rng.choice(" \n\t ") for w in text), lang))
    data += [(200, None, "en"), (201, "", None), (None, "same line\nsame line\n \n \n", "en")]
    data += [data[1], data[1], (202, "a b c d e f g h " * 4000, "en"), (203, "é😀| <x>\x0b#" * 60, "de")]
    data += [(204, "only one of its language " * 30, "zz")]
    return data


def test_against_plain_python(rows):
    data = made()
    got = qr.judged(rows(SCHEMA, [(*r, "a", "b") for r in data])).drop("class_distance", "word_distance")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data)


def test_distance_is_zero_to_one(rows):
    df = rows("p array<int>, q array<int>", [([1, 3], [2, 6]), ([1, 0], [0, 5]), ([0, 0], [1, 1])])
    got = sorted(round(r[0], 9) for r in df.select(qr.js_distance(df.p, df.q)).collect())
    assert got[0] == 0 and got[-1] == 1


def test_empty_table(rows):
    assert qr.judged(rows(SCHEMA, [])).collect() == []


def test_no_python_in_the_plan(spark, small):
    plan = plan_of(QUERIES["op3_divergence_rules"](spark, small))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_query_equals_its_sql(spark, small):
    con = check.connect(small)
    got = QUERIES["op3_divergence_rules"](spark, small).toArrow()
    want = con.sql(SQL["op3_divergence_rules"]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert check.rows(columns, got) == check.rows(columns, want)
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    shown = [tuple(r[c] for c in got.column_names) for r in got.to_pylist()]
    assert sorted(shown, key=repr) == brute(docs)


def test_clean_labelled_texts_stay(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    kept = QUERIES["op3_divergence_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    count = defaultdict(int)
    for r in kept.collect():
        count[r.quality, r.base_failed, r.kept] += 1
    assert count[1, False, False] == 0
    assert count[0, False, False] > count[0, False, True]


pytestmark = pytest.mark.filterwarnings("ignore")
