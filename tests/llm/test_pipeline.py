"""The pipeline: every stage against what its operator says of the stage's own input."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from strandline.llm.staging import staged
from tests.llm.test_decontaminate import brute as similar
from tests.llm.test_line_dedup import brute as without_repeats
from tests.llm.test_simhash_dedup import linked, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, label string"


@pytest.fixture(scope="module")
def steps(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for _, stage in cp.STAGES:
        out.append((docs, staged(stage(spark, docs, small))))
        docs = out[-1][1]
    return out


def as_rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(spark, small, steps):
    assert [name for name, _ in cp.STAGES] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination",
        "best-fit packing",
    ]
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_keeps_clean_documents(spark, small, steps):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    before, after = map(as_rows, steps[0])
    assert all(after[d] == before[d] for d in after)
    assert all(d in after for d, q in marks.items() if q == 1)
    gone = [d for d, q in marks.items() if q == 0 and d not in after]
    assert len(gone) >= 0.9 * sum(q == 0 for q in marks.values())


def test_lines(steps):
    before, after = map(as_rows, steps[1])
    want = without_repeats([(r.doc_id, r.text) for r in before.values()])
    assert {d: after[d].text or "" for d in after} == {d: t for d, _, _, t in want}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_copies(steps):
    before, after = map(as_rows, steps[2])
    fps = {d: plain_fingerprint(r.text) for d, r in before.items()}
    root, least = linked(fps.values(), 2), {}
    for d in sorted(fps):
        least.setdefault(root[fps[d]], d)
    assert set(after) == set(least.values()) and len(after) < len(before)


def test_benchmark(spark, small, steps):
    before, after = map(as_rows, steps[3])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    sure = {d for d, _ in similar([(d, r.text) for d, r in before.items()], items, cut=False)}
    may = {d for d, _ in similar([(d, r.text) for d, r in before.items()], items)}
    assert sure and sure <= set(before) - set(after) <= may


def test_packing(spark, small, steps):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, pieces, filled = as_rows(steps[4][0]), defaultdict(list), defaultdict(int)
    for r in steps[4][1].collect():
        pieces[r.doc_id].append(r)
        filled[r.sequence_id] += r.length
    assert pieces.keys() == docs.keys() and max(filled.values()) <= 1024
    for d, parts in pieces.items():
        ids = np.array(tokenizer.encode(docs[d].text or "", add_special_tokens=False).ids + [2], "<u4")
        assert sum(p.length for p in parts) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in parts)


def test_run_is_the_stages_in_order(spark, small, steps):
    shown = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert shown(cp.run(spark, small)) == shown(steps[4][1])


def test_odd_rows_and_extra_columns(spark, small, rows):
    same = "the same long line in many texts"
    data = [
        (1, None), (2, ""), (None, "no id " + same), (3, same), (4, same), (5, same), (5, same),
        (6, "x" * 100_000), (7, "word " * 50_000), (None, None),
    ]
    df = rows(SCHEMA, [(d, t, None, None, len(t or ""), "mine", "mine") for d, t in data])
    for table in (df, df.where("doc_id < 0")):
        for _, stage in cp.STAGES[:-1]:
            table = staged(stage(spark, table, small))
            assert table.columns == df.columns
        assert {r.n_lines for r in table.collect()} <= {"mine"}
        cp.STAGES[-1][1](spark, table, small).collect()
