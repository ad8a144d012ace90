"""License scan: base places by brute force, method labels on edited wordings."""

from __future__ import annotations

import re

import pytest

from strandline.llm import licenses
from strandline.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, row string, labels string"
PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    ends = (min(places), max(places)) if places else (None, None)
    return (len(words), len(places), *ends, ",".join(sorted(labels)))


def brute_spans(text, k=3, cover=0.8, shift=3):
    """Labels and score of the templates that are no exact phrases, by plain loops."""
    words, spans = words_of(text), []
    for number, t in enumerate(licenses.TEMPLATES):
        own = words_of(t.text)
        grams = [tuple(own[i : i + k]) for i in range(len(own) - k + 1)]
        hits = [
            (p - q, p, q)
            for p in range(len(words) - k + 1)
            for q, gram in enumerate(grams)
            if not t.exact and tuple(words[p : p + k]) == gram
        ]
        chain, last, chains = [], None, []
        for diagonal, p, q in sorted(hits):
            if last is not None and diagonal - last > shift:
                chains, chain = [*chains, chain], []
            chain.append((p, q))
            last = diagonal
        for chain in [*chains, chain]:
            for start in {p for p, _ in chain}:
                inside = [(p, q) for p, q in chain if start <= p <= start + 2 * len(own) - k]
                score = len({q for _, q in inside}) / len(grams)
                if score >= cover:
                    end = max(p for p, _ in inside) + k
                    spans.append((-score, -len(grams), start, end, number))
    taken = []
    for s in sorted(set(spans)):
        if all(s[3] <= x[2] or x[3] <= s[2] or x[:2] == s[:2] for x in taken):
            taken.append(s)
    return {licenses.TEMPLATES[s[4]].label for s in taken}, max((-s[0] for s in taken), default=0.0)


def brute_all(text):
    found = brute(text)
    labels, score = brute_spans(text)
    base = set(found[4].split(",")) - {""}
    return (*found, ",".join(sorted(labels | base)), 1.0 if base else score)


MIT, APACHE, BSD = (t.text for t in (licenses.TEMPLATES[3], licenses.TEMPLATES[4], licenses.TEMPLATES[5]))
CASES = [
    (1, None, ""), (2, "", ""), (3, "ü", ""), (4, "The MIT-License the mit license!", "mit"),
    (5, "CC BY-NC 4.0, apache license, version 2.0", "apache-2,cc-by-nc"),
    (6, "the mit", ""), (6, "the mit", ""), (None, "cc by nc", "cc-by-nc"),
    (7, "intro " * 300 + MIT.replace("free of charge", "entirely free of charge") + " outro", "mit"),
    (8, MIT.replace("hereby ", "").replace("merge, ", ""), "mit"),
    (9, " ".join(MIT.split()[:25]), ""), (10, APACHE + " " + BSD, "apache-2,bsd"),
    (11, "This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    (12, "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    (13, "licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    (14, " ".join(reversed(MIT.split())), ""), (15, "the mit license " * 20_000, "mit"),
    (16, "cc by nc by nc cc by ncs", "cc-by-nc"), (17, "THE MİT LICENSE the mıt license", ""),
    (18, "software without restriction " * 500, ""),
    (19, "gnu general public " * 8 + "license version 2", "gpl-2"),
    (20, BSD + " " + MIT + " and " + "in source and binary " * 30 + BSD, "bsd,mit"),
]


def test_base_and_labels(rows):
    df = rows(SCHEMA, [(d, t, "a", "b") for d, t, _ in CASES])
    got = sorted((tuple(r)[:6] + (r.labels,) for r in licenses.scan(df).collect()), key=repr)
    want = [(d, *brute(t), labels) for d, t, labels in CASES]
    assert got == sorted(want, key=repr)
    whole = sorted(((*tuple(r)[:7], round(r.score, 9)) for r in licenses.scan(df).collect()), key=repr)
    brutes = [(d, *brute_all(t)) for d, t, _ in CASES if d != 15]
    assert [r for r in whole if r[0] != 15] == sorted(((*b[:7], round(b[7], 9)) for b in brutes), key=repr)
    scores = {r.doc_id: r.score for r in licenses.scan(df).collect()}
    assert scores[1] == 0 and scores[4] == 1 and 0.8 <= scores[7] < 1


def test_short_template_is_an_error(rows):
    with pytest.raises(ValueError, match="fewer than 3 words"):
        licenses.scan(rows(SCHEMA, []), templates=(licenses.Template("x", "two words"),))


def test_empty_table(rows):
    assert licenses.scan(rows(SCHEMA, [])).collect() == []


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    found = QUERIES["op5_license_scan"](spark, small).collect()
    got = {r.doc_id: (*tuple(r)[1:7], round(r.score, 9)) for r in found}
    want = {r.doc_id: brute_all(r.text) for r in docs}
    assert got == {d: (*w[:6], round(w[6], 9)) for d, w in want.items()}


def test_query_takes_the_base_phrases_of_the_contract(spark, tmp_path):
    """The mit phrase begins with "under"; the shorter one gives its label, but is no base place."""
    texts = [
        "Released UNDER the MIT-License.", "the mit license", "under\u0301 the mit license",
        "x under the mit license, or the mit license under the mit license", "Under\x00the\x7fmit\tlicense",
        "under the mit licenses", "cc by nc under the apache license version 2", None, "",
        "under under the mit license cc by nc by nc",
    ]
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    data = list(enumerate(texts))
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def base(text):
        words = words_of(text)
        at = [
            (i, label)
            for label, phrase in phrases.items()
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        places = [i for i, _ in at]
        ends = (min(places), max(places)) if places else (None, None)
        return (len(words), len(places), *ends, ",".join(sorted({label for _, label in at})))

    got = {r.doc_id: r for r in QUERIES["op5_license_scan"](spark, str(tmp_path)).collect()}
    assert {d: tuple(r)[1:6] for d, r in got.items()} == {d: base(t) for d, t in data}
    assert (got[1].n_base, got[1].base_labels, got[1].labels, got[1].score) == (0, "", "mit", 1.0)
