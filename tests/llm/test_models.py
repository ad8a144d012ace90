"""Language and quality models: hashing against plain Python, held-out accuracy, odd rows."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import language_id as li
from strandline.llm import quality_model as qm
from strandline.llm.queries import QUERIES
from strandline.llm.sampling import held_out, spread_sample

DOCS = "doc_id long, text string, lang string, source string, held_out string, score string, y string"


def remainder(doc):
    return zlib.crc32(str(doc).encode()) % 3


def test_split(spark):
    got = {r.id: r.h for r in spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: remainder(i) == 1 for i in range(300)}
    none = spark.sql("SELECT CAST(NULL AS BIGINT) AS id")
    assert none.select(held_out(none.id)).first()[0] is False


def test_sample_is_bounded_and_fixed(spark):
    rows = spark.range(20_000)
    take = lambda: {r.id for r in spread_sample(rows, rows.id, F.lit(0.05)).collect()}
    assert 800 < len(take()) < 1200 and take() == take()


def plain_grams(text):
    cleaned = "".join(c if c.isalpha() else " " for c in (text or "").lower() + " ")
    out, runs = Counter(), cleaned.split()
    if not runs:
        return out
    joined = " ".join(runs) + " "
    for size in li.SIZES:
        for i in range(len(joined) - size + 1):
            g = joined[i : i + size]
            if " " not in g[1:-1]:
                out[g] += 1
    return out


def test_grams_are_all_letter_runs():
    for text in ["Der Hund, die Katz!", "é", "a", "12 34", "x" * 50, "ab 1 cd  ef", "İstanbul ß"]:
        found = Counter()
        for points, rows in li.blocks([text]):
            for codes, _ in li.grams(points, rows):
                found.update(codes.tolist())
        assert sorted(found.values()) == sorted(plain_grams(text).values())


def test_blocks_hold_whole_texts():
    texts = ["ab " * 900_000, None, "", "x" * (li.BLOCK + 5), "é"]
    sizes = Counter()
    for points, rows in li.blocks(texts):
        for row, n in zip(*np.unique(rows, return_counts=True), strict=True):
            sizes[int(row)] += int(n)
    for row, text in enumerate(texts):
        assert len(text or "") <= sizes[row] <= len(text or "") + 3


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    masks = np.uint64(1) << rng.integers(0, 5, 20_000).astype(np.uint64)
    model = li.build_model(list("abcde"), codes, masks, 5000, 0)
    assert ((model.masks(codes) & masks) == masks).all()
    others = rng.integers(0, 2**63, 100_000).astype(np.uint64)
    for b, f in enumerate(model.false_positives):
        rate = ((model.masks(others) >> np.uint64(b)) & np.uint64(1)).mean()
        assert abs(rate - f) < 0.003 and f < 0.02


@pytest.fixture(scope="module")
def tiny(spark):
    words = {"de": "der hund und die katze schlafen", "fr": "le chien et la souris dorment"}
    data = [
        (i, f"{words[lang]} {i} {words[lang][::-1]}", lang, None, "h", "s", "y")
        for i in range(120)
        for lang in [("de", "fr")[i % 2]]
    ]
    return spark.createDataFrame(data, DOCS).repartition(3)


def test_language_rows(spark, tiny):
    model = li.fit(tiny)
    assert model.languages == ["de", "fr"]
    odd = [
        (1, None), (2, ""), (3, "123 !?"), (None, "der hund"), (4, "le chien"), (4, "le chien"),
        (5, "漢字"), (6, "die katze " * 200_000),
    ]
    df = spark.createDataFrame([(i, t, None, None, "a", "b", "c") for i, t in odd], DOCS)
    got = sorted(map(tuple, li.predict(df, model).collect()), key=repr)
    by = {(r[0], r[2]): r[3] for r in got}
    assert len(got) == len(odd)
    assert by[1, "und"] == by[2, "und"] == by[3, "und"] == 0
    assert (None, "de") in by and (4, "fr") in by and (6, "de") in by
    assert by[5, model.languages[model.fallback]] == 0
    assert all(0 <= r[3] <= 1 and r[1] == (r[0] is not None and remainder(r[0]) == 1) for r in got)
    assert li.identify(tiny.where("doc_id < 0")).collect() == []
    nothing = li.fit(tiny.where("doc_id < 0"))
    assert {r.lang_pred for r in li.predict(df, nothing).collect()} == {"und"}


def test_language_held_out_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_language_bitmask"](spark, sf).collect()
    assert len(got) == len(langs)
    own = [langs[r.doc_id] == r.lang_pred for r in got if r.held_out and langs[r.doc_id]]
    assert len(own) > 250 and np.mean(own) > 0.98


def context_by_hand(index, texts):
    want = np.zeros((qm.WORDS + qm.SHAPES, qm.WIDTH), np.int64)
    for text in texts:
        tokens = [divmod(qm._codes[w], qm.SHAPES) for w in (text or "").split()]
        own = [index[a] + index[qm.WORDS + b] for a, b in tokens]
        for i, (a, b) in enumerate(tokens):
            for j in (i - 1, i + 1):
                if 0 <= j < len(tokens):
                    want[a] += own[j]
                    want[qm.WORDS + b] += own[j]
    return want


def test_context_sums_by_hand():
    rng = np.random.default_rng(4)
    index, pool = qm.index_vectors(), ["one", "Two", "two", "9!", *map(str, range(40))]
    long = [" ".join(rng.choice(pool, n)) for n in (qm.BLOCK, qm.BLOCK + 1, 9000, qm.JOINED + 5)]
    texts = ["one Two two one", None, "", "single", *long, *[f"a b{i}" for i in range(500)], None]
    assert (qm.context_sums(texts, index) == context_by_hand(index, texts)).all()
    assert not qm.context_sums([], index).any()


def test_vectors_come_from_all_rows_and_the_network_from_one_text_an_id(rows):
    """Unlabelled and held-out rows count in the word vectors; a repeated id is learned once."""
    docs = [(i, f"plain text {i} here" if i % 2 else f"X{i}!! Y!!", None, None, "a", "b", "c") for i in range(60)]
    docs += [(900 + i, f"unlabelled zebra {i}", None, None, "a", "b", "c") for i in range(20)]
    docs += [(3, f"repeated {i}", None, None, "a", "b", "c") for i in range(5)]
    labels = rows("doc_id long, quality int, toxic int, text string", [(i, i % 2, 0, "") for i in range(60)])
    model = qm.fit(rows(DOCS, docs), labels)
    want = qm.unit_vectors(context_by_hand(qm.index_vectors(), [d[1] for d in docs]))
    assert (model.vectors == want).all()
    again = qm.fit(rows(DOCS, docs + docs), labels)
    assert np.allclose(again.center, model.center) and again.temperature == model.temperature


def test_shapes_by_characters(spark, small):
    """The short way for plain words gives what character runs give."""

    def runs(word):
        out = []
        for c in word:
            kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
            if out[-1:] != [kind] or (not kind.isalnum() and out[-2:] != [kind, kind]):
                out.append(kind)
        return "".join(out[:12])

    words = {w for r in spark.read.parquet(f"{small}/documents.parquet").collect() for w in (r.text or "").split()}
    rng = np.random.default_rng(6)
    signs = list("aZ9,-.!\u24b6\u01c5\u00df\u00bd\u00b2\u4e2d\u0301\u02b0\u00aa")
    words |= {"".join(rng.choice(signs, n)) for n in rng.integers(1, 6, 20_000)} | {""}
    assert [w for w in words if qm.shape_of(w) != runs(w)] == []
    assert qm.shape_of("Word,") == "Aa," and qm.shape_of("x!!!!") == "a!!"


def test_long_texts_pool_like_short_ones():
    rng = np.random.default_rng(2)
    vectors = rng.random((qm.WORDS + qm.SHAPES, qm.WIDTH)).astype(np.float32)
    unit = "alpha Beta beta, 12!! "
    one, many = qm.features(vectors, [unit * 500, unit * 40_000])
    assert np.allclose(one[:-2], many[:-2], atol=1e-3)
    assert abs(one[-2] - many[-2]) < 1e-3


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < qm.sigmoid(logits)).astype(float)
    assert abs(qm.fitted_temperature(3 * logits, y) - 3) < 0.25


def test_quality_rows(spark, rows):
    labels = "doc_id long, quality int, toxic int, text string"
    docs = [(i, f"a plain text of number {i} with words" if i % 2 else f"X{i}!! " * 9) for i in range(90)]
    odd = [(200, None), (201, ""), (None, "text"), (202, "word " * 100_000), (1, docs[1][1])]
    df = rows(DOCS, [(*d, None, None, "a", "b", "c") for d in docs + odd])
    marks = [(i, i % 2, 0, "") for i in range(90)] + [(None, 1, 0, ""), (5, None, 0, ""), (300, 1, 1, "")]
    model = qm.fit(df, rows(labels, marks))
    got = qm.score(df, model).collect()
    assert len(got) == len(docs) + len(odd)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 90:
            assert r.predicted == r.doc_id % 2
    kept = qm.keep_predicted(df, model)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.predicted for r in got)
    none = qm.fit(df, rows(labels, []))
    assert none is None and {r.score for r in qm.score(df, none).collect()} == {0.5}
    assert qm.score(df.where("doc_id < 0"), model).collect() == []


def test_quality_held_out_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op7_quality_network"](spark, sf).collect() if r.held_out and r.doc_id in marks]
    right = [r.predicted == marks[r.doc_id] for r in got]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert all(r.predicted for r in got if marks[r.doc_id] == 1)


def test_more_languages_than_bits_of_a_mask(spark):
    rng = np.random.default_rng(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    data = []
    for k in range(70):
        words = ["".join(rng.choice(list(letters), 6)) for _ in range(12)]
        for i in range(30 if k < 64 else 20):
            text = " ".join(rng.choice(words, 15))
            data.append((100 * k + i, text, f"l{k:02d}", None, "h", "s", "y"))
    docs = spark.createDataFrame(data, DOCS).repartition(3)
    model = li.fit(docs)
    assert model.languages == [f"l{k:02d}" for k in range(70)] and model.slots.shape[0] == 2
    truth = {d: lang for d, _, lang, *_ in data}
    got = li.predict(docs, model).collect()
    assert len(got) == len(data) and all(r.lang_pred == truth[r.doc_id] for r in got)


def test_small_language_is_learned(spark):
    """One or two texts beside many: their n-grams are met once, and still make a filter."""
    russian = ["собака идёт домой по улице", "кошка спит на тёплой крыше дома"]
    data = [(3 * i, f"the dog walks home along the street {i} and sleeps", "en", None, "h", "s", "y") for i in range(60)]
    ids = [i for i in range(1000, 1100) if remainder(i) != 1][:2]
    data += [(d, t, "ru", None, "h", "s", "y") for d, t in zip(ids, russian, strict=True)]
    docs = spark.createDataFrame(data, DOCS)
    model = li.fit(docs)
    assert model.languages == ["en", "ru"] and model.density()[1] > 0
    got = {r.doc_id: r for r in li.predict(docs, model).collect()}
    assert all(got[d].lang_pred == "ru" and got[d].score > 0.5 for d in ids)
    assert sum(r.lang_pred == "en" for r in got.values()) == 60


def test_model_size_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(li, "MAX_GRAMS", 100)
    data = [(3 * i, f"some text {i} of a language", f"l{i % 4}", None, "h", "s", "y") for i in range(40)]
    calls = []
    build = li.build_model
    monkeypatch.setattr(li, "build_model", lambda langs, codes, *a, **k: calls.append(len(codes)) or build(langs, codes, *a, **k))
    li.fit(spark.createDataFrame(data, DOCS))
    assert calls and calls[0] <= 100
