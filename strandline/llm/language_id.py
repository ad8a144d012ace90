"""Language identification with bit-sliced Bloom filters of character n-grams.

A table of m slots holds a 64-bit mask each; bit l belongs to the Bloom filter of language l.
There is one such table for every 64 languages, so their number has no bound.
The AND of an n-gram's slots is the set of all languages that contain it. A text's score for a
language is its share of n-grams in that filter, corrected for the filter's false positives:
(share - f) / (1 - f), where f is the language's slot density to the power of the hashes.

A filter holds the n-grams typical of its language: of the languages' relative frequencies, at
least ``typical`` times the highest. The model is learned from a sample bounded by
``texts_per_language``; what reaches the driver is one row per language and ``MAX_GRAMS``
n-grams at most. Of a language with few texts rare n-grams are kept as well, so that it is learned
however small it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.sampling import held_out, spread_sample
from strandline.llm.staging import staged

SIZES = (3, 4)
#: Languages in a mask.
WORD = 64
#: N-grams that a model holds in all; beyond 80 languages each has fewer than 50,000.
MAX_GRAMS = 4_000_000
#: A language's n-grams must occur once for so many that were read of it, and thrice at most.
RARE_PER = 20_000
#: Characters worked on at a time.
BLOCK = 1 << 20
#: Odd multipliers of the hashes.
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, row of each) of the texts in lower case, a blank after each, in blocks;
    long texts are cut at a blank where they have one."""
    parts, owners, filled = [], [], 0

    def flush():
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        rows = np.repeat(np.array(owners, np.int64), [len(p) for p in parts])
        return points, rows

    for row, text in enumerate(texts):
        at, text = 0, (text or "").lower()
        while at < len(text):
            end = min(len(text), at + BLOCK)
            if end < len(text):
                end = text.rfind(" ", at, end) + 1 or end
            parts.append(text[at:end] + " ")
            owners.append(row)
            filled += end - at
            at = end
            if filled >= BLOCK:
                yield flush()
                parts, owners, filled = [], [], 0
    if parts:
        yield flush()


def grams(points: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, row of each) of all n-grams: letters in a row, with one blank at either end."""
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one separator after each run of letters
    codes = np.where(letter, points, 0)[keep].astype(np.uint64)
    rows, inner = rows[keep], letter[keep]
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        code = np.zeros(n, np.uint64)
        for k in range(size):
            code = code * np.uint64(0x110001) + codes[k : k + n]
        whole = rows[:n] == rows[size - 1 :]
        for k in range(1, size - 1):
            whole &= inner[k : k + n]
        code ^= code >> np.uint64(31)
        yield ((code + np.uint64(size)) * _MIX)[whole], rows[:n][whole]


@dataclass(frozen=True)
class Model:
    """``slots`` has a row for every 64 languages with a power of two of masks; ``languages`` are
    by row and bit."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    fallback: int

    @property
    def false_positives(self) -> np.ndarray:
        return self.density() ** self.hashes

    def density(self) -> np.ndarray:
        return np.array(
            [has_bit(self.slots[b // WORD], b % WORD).mean() for b in range(len(self.languages))]
        )

    def masks(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """The languages of row ``word`` whose filters contain each n-gram."""
        return bloom_and(self.slots[word], codes, self.hashes)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        count = len(self.languages)
        hits, total = np.zeros((len(texts), count)), np.zeros(len(texts))
        lettered = np.zeros(len(texts), bool)
        for points, rows in blocks(texts):
            lettered[rows[letters()[points]]] = True
            for codes, owner in grams(points, rows):
                total += np.bincount(owner, minlength=len(texts))
                for b in range(count):
                    if b % WORD == 0:
                        found = self.masks(codes, b // WORD)
                    bit = has_bit(found, b % WORD)
                    hits[:, b] += np.bincount(owner[bit], minlength=len(texts))
        f = self.false_positives if count else np.zeros(0)
        share = np.maximum((hits / np.maximum(total, 1)[:, None] - f) / (1 - f), 0)
        names, score = [], np.zeros(len(texts))
        for i in range(len(texts)):
            if not lettered[i] or not count:
                names.append("und")
                continue
            sums = share[i].sum()
            best = int(share[i].argmax()) if sums else self.fallback
            names.append(self.languages[best])
            score[i] = share[i, best] / sums if sums else 0.0
        return names, score


def has_bit(masks: np.ndarray, bit: int) -> np.ndarray:
    return ((masks >> np.uint64(bit)) & np.uint64(1)).astype(bool)


def slots_of(codes: np.ndarray, log2: int, hashes: int) -> Iterator[np.ndarray]:
    second = (codes * _STEP) | np.uint64(1)
    for k in range(hashes):
        yield (codes + np.uint64(k) * second) >> np.uint64(64 - log2)


def bloom_and(slots: np.ndarray, codes: np.ndarray, hashes: int) -> np.ndarray:
    log2 = len(slots).bit_length() - 1
    found = np.full(len(codes), ~np.uint64(0))
    for at in slots_of(codes, log2, hashes):
        found &= slots[at]
    return found


def build_model(
    languages: list[str], codes: np.ndarray, masks: np.ndarray, largest: int, fallback: int,
    hashes: int = 3, words: np.ndarray | int = 0,
) -> Model:
    """``masks`` are those of the rows ``words``. ``largest``: most n-grams in one language; slots
    are sized for about 1 % false positives."""
    log2 = max(10, int(np.ceil(np.log2(max(largest, 1) * hashes / 0.24))))
    slots = np.zeros((max(1, -(-len(languages) // WORD)), 1 << log2), np.uint64)
    for at in slots_of(codes, log2, hashes):
        np.bitwise_or.at(slots, (words, at), masks)
    return Model(languages, slots, hashes, fallback)


def _by_language(values: dict[str, float]) -> Column:
    """The value of the row's language; NULL for one that is not listed."""
    parts = [F.lit(x) for pair in values.items() for x in pair]
    known = F.create_map(*parts) if parts else F.create_map().cast("map<string,double>")
    return F.try_element_at(known, F.col("lang"))


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    texts_per_language: int = 3000,
    grams_per_language: int = 50_000,
    typical: float = 0.2,
) -> Model:
    """Learn all languages of rows with a text, a language and an id that are not held out. About
    ``texts_per_language`` whole texts of each language, or all of a smaller one, are read, chosen
    by a hash of the id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.where(~held_out(F.col("id")))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not sizes:
        return Model([], np.zeros((1, 1024), np.uint64), 3, 0)
    languages = sorted(r["lang"] for r in sizes)
    wanted = _by_language({r["lang"]: texts_per_language / r["count"] for r in sizes})
    sample = spread_sample(rows, F.col("id"), wanted).select("lang", "text")
    schema = T.StructType().add("lang", "string").add("code", "long").add("n", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for points, rows_ in blocks(own):
                    for codes, _ in grams(points, rows_):
                        found, n = np.unique(codes, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)],
                            names=schema.names,
                        )

    counts = sample.mapInArrow(run, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = staged(counts)
    read = {r["lang"]: float(r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # N-grams met once or twice are left out where a language's texts are many enough.
    rare = F.least(F.lit(3), F.ceil(_by_language(read) / F.lit(RARE_PER)))
    counts = counts.where(F.col("n") >= rare)
    most = max(1, min(grams_per_language, MAX_GRAMS // len(languages)))
    totals = {r["lang"]: float(r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    shares = counts.withColumn("share", F.col("n") / _by_language(totals))
    highest = shares.groupBy("code").agg(F.max("share").alias("highest"))
    ranked = (
        shares.join(highest, "code")
        .where(F.col("share") >= typical * F.col("highest"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")))
        .where(F.col("rank") <= most)
    )
    table = ranked.select("lang", "code").toArrow()  # at most MAX_GRAMS rows
    which = pc.index_in(table.column(0), pa.array(languages, pa.string())).to_numpy().astype(np.int64)
    codes = table.column(1).to_numpy().astype(np.int64).view(np.uint64)
    masks = np.uint64(1) << (which % WORD).astype(np.uint64)
    largest = int(np.bincount(which, minlength=1).max())
    fallback = languages.index(sizes[0]["lang"])
    return build_model(languages, codes, masks, largest, fallback, words=which // WORD)


def predict(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score (the best language's part of all
    corrected shares). ``und`` with score 0 if the text is NULL or has no letter, or no language
    was learned; the most frequent language with score 0 if no filter knows any n-gram. Equal
    shares go to the first language by name. Repeated rows and NULL ids are rows like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = (
        T.StructType()
        .add("doc_id", docs.schema[id_col].dataType)
        .add("held_out", "boolean")
        .add("lang_pred", "string")
        .add("score", "double")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)],
                names=schema.names,
            )

    return docs.select(
        F.col(id_col), held_out(F.col(id_col)), F.col(text_col)
    ).mapInArrow(run, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """``fit`` and ``predict`` on the same table."""
    return predict(docs, fit(docs, **options))
