"""Line deduplication against a dictionary of whole keys, and against its SQL."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

import check
from strandline.llm import line_dedup
from strandline.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, n_lines string, h1 string"


def brute(data, least=20, docs=3):
    holders = defaultdict(set)

    def key(line):
        line = line.strip(line_dedup.BLANKS)
        return "".join(c.lower() if c in line_dedup.UPPER else c for c in line)

    for doc, text in data:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= least:
                    holders[key(line)].add(doc)
    out = []
    for doc, text in data:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if doc is None
            or len(holders.get(key(line), ())) < docs
            or doc == max(holders[key(line)])
        ]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def made(n, seed):
    rng = random.Random(seed)
    pool = [f"the shared line number {k} of the corpus" for k in range(12)]
    data = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randrange(6)):
            line = rng.choice([*pool, "short", "", f"own line {doc} {rng.random()}"])
            if rng.random() < 0.3:
                line = "\t " + line.upper() + " \r"
            lines.append(line)
        data.append((doc, "\n".join(lines)))
    data += [(n, None), (n + 1, ""), (n + 2, "\n" * 5000), (None, pool[0] + "\n" + pool[1])]
    data += [data[3], data[3], (n + 3, "\n".join(pool * 50)), (n + 4, "É" * 19), (4, pool[2])]
    data += [(n + 5, "Ä line with Ä twenty chars"), (n + 6, "ä line with ä twenty chars")]
    return data


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (4, 3)])
def test_against_whole_keys(rows, batches, fanout):
    data = made(120, batches)
    df = rows(SCHEMA, [(*r, "a", "b") for r in data])
    got = line_dedup.drop_repeated_lines(df, batches=batches, fanout=fanout).collect()
    shown = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got]
    assert sorted(shown, key=repr) == brute(data)
    assert got[0].h1 == "b"


def test_levels_are_compacted(spark, rows):
    runs = line_dedup.Runs(spark, fanout=2)
    for k in range(5):
        runs.add(rows("h1 long, h2 long, n_docs long, keep long", [(1, 1, 2, 9 - k), (k + 2, 0, 1, 5)]))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {(r.h1, r.h2): r.keep for r in runs.repeated(2).collect()}
    assert got == {(1, 1): 9}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_run")]


def test_empty_table(rows):
    assert line_dedup.drop_repeated_lines(rows(SCHEMA, [])).collect() == []


def test_query_equals_its_sql(spark, small):
    con = check.connect(small)
    got = QUERIES["op4_line_dedup"](spark, small).toArrow()
    want = con.sql(SQL["op4_line_dedup"]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert check.rows(columns, got) == check.rows(columns, want)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["kept_sha256"] != empty for r in got.to_pylist() if not r["n_dropped"] and texts[r["doc_id"]])


def test_clashing_columns_and_text_ids(spark):
    line = "a line that is long enough"
    names = "doc_id long, text string, lost_doc string, lost_row string, lost_lines string, text_row string"
    df = spark.createDataFrame([(k, line, "a", "b", "c", "d") for k in range(3)], names)
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in got.collect()) == [
        (k, line if k == 2 else "", "a", "b", "c", "d", 1, int(k < 2)) for k in range(3)
    ]
    with pytest.raises(TypeError, match="numbers"):
        line_dedup.drop_repeated_lines(spark.createDataFrame([("x", line)], "doc_id string, text string"))
