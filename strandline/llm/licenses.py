"""License scan by diagonal voting.

Every rolling k-word gram of a text is joined to its positions in the license templates. A hit
at word p of the text and word t of a template votes for diagonal p - t. Votes are counted per
diagonal; neighbouring diagonals, which an inserted or missing word separates, are merged into
a chain. From every hit of a chain a span is laid of up to twice the template's length, and it
counts if its grams, compared word by word, cover enough of the template. Of a text's spans the
best are taken as long as they do not overlap. Exact phrases need all their grams on one diagonal.
The templates are a fixed table, so its broadcast has a fixed size.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.arrays import gram_hash, let, lower_ascii, positions, split_words
from strandline.llm.staging import staged

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``exact`` phrases count wherever their words stand consecutively; those that are not
    ``base`` only give their label."""

    label: str
    text: str
    exact: bool = False
    base: bool = True


# Phrases that must be found, then wordings of public licenses.
TEMPLATES = (
    Template("mit", "the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies",
    ),
    Template("gpl-2", "GNU General Public License version 2"),
    Template("gpl-3", "GNU General Public License version 3"),
    Template(
        "gpl-2",
        "under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    Template(
        "gpl-3",
        "under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    Template("lgpl", "GNU Lesser General Public License"),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template(
        "cc-by-sa",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    Template(
        "cc-by-nc",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_grams(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """(template, label, exact, base, grams, tpos, gram, h): one row per gram of every template."""
    rows = [(i, t.label, t.exact, t.base, t.text) for i, t in enumerate(templates)]
    table = spark.createDataFrame(
        rows, "template int, label string, exact boolean, base boolean, text string"
    )
    words = split_words(lower_ascii(F.col("text")), SEPARATORS)
    return (
        table.withColumn("words", words)
        .withColumn("grams", F.size("words") - (k - 1))
        .select("*", F.explode(positions(F.col("grams"))).alias("tpos"))
        .select(
            "template",
            "label",
            "exact",
            "base",
            "grams",
            "tpos",
            F.slice("words", F.col("tpos") + 1, k).alias("gram"),
            gram_hash(F.col("words"), F.col("tpos"), k).alias("h"),
        )
    )


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def taken(spans: list[dict]) -> list[dict]:
    """The spans of one text from the best down, by score, then grams. One that overlaps a taken
    span is left, unless it is as good as all those."""
    order = sorted(
        spans, key=lambda s: (-s["score"], -s["grams"], s["start"], s["end"], s["template"])
    )
    found: list[tuple[int, int, tuple]] = []  # disjoint but for ties, in order of their starts
    reach, out = max(s["end"] - s["start"] for s in spans), []
    for s in order:
        rank = (s["score"], s["grams"])
        at = bisect.bisect_left(found, (s["end"],))
        clear = True
        while clear and at and found[at - 1][0] + reach > s["start"]:
            at -= 1
            clear = found[at][1] <= s["start"] or found[at][2] == rank
        if clear:
            bisect.insort(found, (s["start"], s["end"], rank))
            out.append(s)
    return out


def best_spans(spans: DataFrame) -> DataFrame:
    """(row, label, base, start, score) of the spans that ``taken`` leaves of each text."""
    names = ["row", "label", "base", "start", "score"]
    types = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, own in itertools.groupby(rows, key=lambda r: r["row"]):
            kept = taken(list(own))
            columns = [[s.get(n, False) for s in kept] for n in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

    dealt = spans.repartition("row").sortWithinPartitions("row")
    return dealt.mapInArrow(run, "row long, label string, base boolean, start int, score double")


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    k: int = 3,
    cover: float = 0.8,
    max_shift: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score.

    ``n_base`` counts the places of the exact base phrases, ``first_word`` and ``last_word`` are
    their least and greatest start. Labels are distinct, sorted, comma-joined; none is an empty
    string. ``score`` is the best share of a template's grams found (1 for an exact phrase, 0
    without a label). A NULL text counts as empty. Repeated rows and NULL ids are rows like any
    other. Other columns are not read. Templates shorter than ``k`` words are an error.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates, k)
    known = [r.h for r in grams.select("h").distinct().collect()]  # a fixed table
    opening = [r.w for r in grams.select(F.get("gram", 0).alias("w")).distinct().collect()]
    if grams.select("template").distinct().count() < len(templates):
        raise ValueError(f"a template has fewer than {k} words")

    def hits(words):
        starts = F.filter(
            positions(F.size(words) - (k - 1)),
            lambda i: F.get(words, i).isin(opening) & gram_hash(words, i, k).isin(known),
        )
        found = F.transform(
            starts, lambda i: F.struct(i.alias("pos"), F.slice(words, i + 1, k).alias("gram"))
        )
        return F.struct(F.size(words).cast("long").alias("n_words"), found.alias("hits"))

    words = split_words(lower_ascii(F.col(text_col)), SEPARATORS)
    read = staged(
        docs.select(F.col(id_col).alias("doc_id"), let(words, hits).alias("found")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "found.*"
        )
    )
    met = staged(
        read.select("row", F.inline("hits"))
        .withColumn("h", F.xxhash64(*[F.get("gram", i) for i in range(k)]))
        .join(F.broadcast(grams), ["h", "gram"])
        .select("row", "template", "label", "exact", "base", "grams", "pos", "tpos",
                (F.col("pos") - F.col("tpos")).alias("diagonal"))
    )
    votes = (
        met.where("exact")
        .groupBy("row", "template", "diagonal")
        .agg(
            F.first("label").alias("label"),
            F.first("base").alias("base"),
            F.first("grams").alias("grams"),
            F.count_distinct("tpos").alias("covered"),
            F.min("pos").alias("low"),
        )
    )
    base = votes.where("covered = grams").select(
        "row", "label", "base", F.col("low").alias("start"), F.lit(1.0).alias("score")
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > max_shift
    chained = (
        met.where("NOT exact")
        .withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
        # Equal diagonals are one step: the default frame ends with the last of them.
        .withColumn("chain", F.sum("apart").over(along))
    )
    longest = max(len(_words(t.text)) for t in templates)
    ahead = (
        Window.partitionBy("row", "template", "chain").orderBy("pos").rangeBetween(0, 2 * longest)
    )
    last = F.col("pos") + 2 * (F.col("grams") + k - 1) - k
    near = F.filter("ahead", lambda x: x["pos"] <= F.col("last"))
    spans = (
        chained.withColumn("ahead", F.collect_set(F.struct("pos", "tpos")).over(ahead))
        .withColumn("last", last)
        .withColumn("near", near)
        .select(
            "row",
            "template",
            "label",
            "grams",
            F.col("pos").alias("start"),
            (F.array_max(F.transform("near", lambda x: x["pos"])) + k).alias("end"),
            F.size(F.array_distinct(F.transform("near", lambda x: x["tpos"]))).alias("covered"),
        )
        .distinct()
        .withColumn("score", F.col("covered") / F.col("grams"))
        .where(F.col("score") >= cover)
    )
    best = best_spans(spans)
    place = F.when(F.col("base"), F.col("start").cast("long"))
    named = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array())), ",")
    summary = (
        base.unionByName(best)
        .groupBy("row")
        .agg(
            F.count(place).alias("n_base"),
            F.min(place).alias("first_word"),
            F.max(place).alias("last_word"),
            F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
            F.collect_set("label").alias("labels"),
            F.max("score").alias("score"),
        )
    )
    return read.drop("hits").join(summary, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        named(F.col("base_labels")).alias("base_labels"),
        named(F.col("labels")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
