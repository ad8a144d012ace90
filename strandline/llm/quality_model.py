"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

A word has two tokens: its letters and digits in lower case, hashed into a bucket, and its shape
(capitals, digits, marks), hashed too. Every bucket has a fixed sparse index vector of -1, 0
and 1; a bucket's context vector is the sum of the index vectors of both tokens of the words
beside it, over all texts. A text is the mean and the spread of its words' context
vectors, with the share of words equal to their predecessor and the length. The network is one
hidden layer of numpy. A temperature calibrates it: it is fitted on a fifth of the training
texts, with a network trained on the others; the final network has all of them.

Context vectors come from every row; the network and the temperature from at most about
``labelled_texts`` labelled texts, whole ones. Context sums are integers, so they do not depend
on the order of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.sampling import held_out, spread_sample

WORDS, SHAPES, WIDTH = 1 << 13, 1 << 8, 32
#: Words worked on at a time.
BLOCK = 1 << 12
#: Words whose contexts are summed at a time.
JOINED = 1 << 15
_GAP = np.array([-1])
SEED = 20
#: What a word's own vector counts for beside its shape's: words tell topics and languages apart
#: first, which a small training set would otherwise mistake for quality.
WORD_WEIGHT = 0.2
_OF_WORDS = np.r_[0:WIDTH, 2 * WIDTH : 3 * WIDTH]


def shape_of(word: str) -> str:
    """Runs of like characters: ``Word,`` is ``Aa,``; a mark that repeats is written twice."""
    end = word[-1:]
    plain, end = (word, "") if end.isalnum() or end.isupper() else (word[:-1], end)
    rest = plain[1:]
    if plain.islower() and plain.isalpha():  # most words are plain ones, perhaps with a mark
        return "a" + end
    if plain[:1].isupper() and rest.islower() and rest.isalpha():
        return "Aa" + end
    out = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if out[-1:] != [kind] or (not kind.isalnum() and out[-2:] != [kind, kind]):
            out.append(kind)
    return "".join(out[:12])


class WordCodes(dict):
    """Word -> word bucket and shape bucket in one number, computed when first met."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        core = word if word.isalnum() else "".join(filter(str.isalnum, word))
        shape = zlib.crc32(shape_of(word).encode("utf-8", "replace")) % SHAPES
        code = zlib.crc32(core.lower().encode("utf-8", "replace")) % WORDS * SHAPES + shape
        if len(word) <= 64:
            self[word] = code
        return code

    def blocks(self, text: str | None) -> Iterator[np.ndarray]:
        words = (text or "").split()
        if len(self) > self.LIMIT:
            self.clear()
        for at in range(0, len(words), BLOCK):
            part = words[max(at - 1, 0) : at + BLOCK]  # one word back, for its neighbour
            yield np.fromiter(map(self.__getitem__, part), np.int64, len(part))


_codes = WordCodes()


def index_vectors() -> np.ndarray:
    """(WORDS + SHAPES) x WIDTH of -1, 0, 1; an eighth of the entries are set."""
    rng = np.random.default_rng(SEED)
    set_ = rng.random((WORDS + SHAPES, WIDTH)) < 0.125
    return (set_ * rng.choice([-1, 1], (WORDS + SHAPES, WIDTH))).astype(np.int64)


def context_sums(texts: Iterable[str | None], index: np.ndarray) -> np.ndarray:
    """The context vectors' sums over ``texts``, for the index vectors ``index``."""
    small, sums = index.astype(np.int8), np.zeros(index.shape, np.int64)
    for codes in _joined(texts):
        word, shape = codes // SHAPES, codes % SHAPES
        own = small[word] + small[WORDS + shape]
        real = codes >= 0
        own[~real] = 0
        beside = np.zeros_like(own)
        beside[1:] = own[:-1]
        beside[:-1] += own[1:]
        beside = beside[real]
        _add_by(sums[:WORDS], word[real], beside)
        _add_by(sums[WORDS:], shape[real], beside)
    return sums


def _joined(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The codes of many blocks in one array, -1 after each block, so that short texts do not
    cost an array each."""
    held, size = [], 0
    for text in texts:
        for codes in _codes.blocks(text):
            held += [codes, _GAP]
            size += len(codes) + 1
            if size >= JOINED:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def _add_by(sums: np.ndarray, buckets: np.ndarray, rows: np.ndarray) -> None:
    """Add each of ``rows`` to its bucket's row of ``sums``."""
    order = np.argsort(buckets.astype(np.int16), kind="stable")
    ordered = buckets[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sums[ordered[starts]] += np.add.reduceat(rows[order], starts, axis=0, dtype=np.int64)


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    hidden: tuple[np.ndarray, np.ndarray]
    out: tuple[np.ndarray, float]
    temperature: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.logits(features(self.vectors, texts)) / self.temperature)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh(((x - self.center) / self.scale) @ self.hidden[0] + self.hidden[1])
        return z @ self.out[0] + self.out[1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    norm = np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
    return (sums / np.maximum(norm, 1)).astype(np.float32)


def features(vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Mean and spread of the word vectors (word and shape), share of repeats, log length."""
    out = np.zeros((len(texts), 4 * WIDTH + 2))
    for row, text in enumerate(texts):
        total = repeats = 0
        sums, squares = np.zeros(2 * WIDTH), np.zeros(2 * WIDTH)
        for codes in _codes.blocks(text):
            repeats += int((codes[1:] == codes[:-1]).sum())
            if total:
                codes = codes[1:]
            total += len(codes)
            for at, tokens in ((0, codes // SHAPES), (WIDTH, WORDS + codes % SHAPES)):
                v = vectors[tokens]
                sums[at : at + WIDTH] += v.sum(axis=0)
                squares[at : at + WIDTH] += np.einsum("ij,ij->j", v, v)
        if total:
            mean = sums / total
            out[row, : 2 * WIDTH] = mean
            out[row, 2 * WIDTH : 4 * WIDTH] = np.sqrt(np.maximum(squares / total - mean**2, 0))
            out[row, -2:] = repeats / total, np.log1p(total)
    return out


def train(x: np.ndarray, y: np.ndarray, units: int = 24, rounds: int = 400) -> tuple:
    """Adam on the whole training set; the weight decay falls with its size. The same result in
    every run."""
    decay = 0.3 / len(y)
    rng = np.random.default_rng(SEED + 1)
    w = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], units)),
        np.zeros(units),
        rng.normal(0, 1 / np.sqrt(units), units),
        np.zeros(1),
    ]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, rounds + 1):
        z = np.tanh(x @ w[0] + w[1])
        error = (sigmoid(z @ w[2] + w[3]) - y) / len(y)
        back = np.outer(error, w[2]) * (1 - z**2)
        grads = [x.T @ back + decay * w[0], back.sum(axis=0), z.T @ error + decay * w[2], error.sum(keepdims=True)]
        for p, g, m, v in zip(w, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g**2 - v)
            p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return (w[0], w[1]), (w[2], float(w[3][0]))


def fitted_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, from 0.25 to 8."""
    options = np.geomspace(0.25, 8, 61)
    signed = np.where(y > 0, logits, -logits)
    losses = [np.logaddexp(0, -signed / t).mean() for t in options]
    return float(options[int(np.argmin(losses))])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    labelled_texts: int = 6000,
    tasks: int = 6,
) -> Model | None:
    """Learn word vectors from all of ``docs`` and the network from about ``labelled_texts``
    labelled rows that are not held out, chosen by a hash of the id. Labels are 0 or 1; an id
    labelled twice counts as the rounded mean, and of an id with several texts the one of least
    hash is learned from. Without any labelled text there is no model (None)."""
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.round(F.avg("y")).alias("y"))
    )
    count = marked.count()
    chosen = spread_sample(marked, F.col("id"), F.lit(labelled_texts / max(count, 1)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The chosen ids are bounded by labelled_texts, so their broadcast is, too; with one text an
    # id the sample is as well.
    sample = (
        texts.join(F.broadcast(chosen), "id")
        .groupBy("id", "y")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .repartition(tasks)
    )
    names = [f"v{j}" for j in range(WIDTH)]
    schema = T.StructType().add("bucket", "integer")
    for name in names:
        schema = schema.add(name, "long")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (text.as_py() for batch in batches for text in batch.column(0))
        total = context_sums(rows, index_vectors())
        met = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(met, pa.int32()), *(pa.array(total[met, j]) for j in range(WIDTH))],
            names=schema.names,
        )

    table = (
        texts.select("text")
        .mapInArrow(sums, schema)
        .groupBy("bucket")
        .agg(*[F.sum(n).alias(n) for n in names])
        .toArrow()  # one row per bucket: a fixed number
    )
    context = np.zeros((WORDS + SHAPES, WIDTH), np.int64)
    if table.num_rows:
        at = table.column(0).to_numpy()
        context[at] = np.column_stack([table.column(n).to_numpy() for n in names])
    vectors = unit_vectors(context)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    pooled = T.StructType().add("id", docs.schema[id_col].dataType).add("y", "double").add(
        "x", T.ArrayType(T.DoubleType())
    )

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(shared.value, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))],
                names=pooled.names,
            )

    found = sample.select("id", "y", "text").mapInArrow(pool, pooled).orderBy("id", "x").toArrow()
    if not found.num_rows:
        return None
    x = np.array(found.column("x").to_pylist())
    y = found.column("y").to_numpy()
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    scale[_OF_WORDS] /= WORD_WEIGHT
    ids = found.column("id").to_pylist()
    unseen = np.array([zlib.crc32(f"t{i}".encode()) % 5 == 0 for i in ids])
    if unseen.all():
        unseen[:] = False
    z = (x - center) / scale
    temperature = 1.0
    if unseen.any():
        trial = Model(vectors, center, scale, *train(z[~unseen], y[~unseen]), 1.0)
        temperature = fitted_temperature(trial.logits(x[unseen]), y[unseen])
    return Model(vectors, center, scale, *train(z, y), temperature)


def score(
    docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. A NULL text is scored as an empty
    one; without a model every score is 0.5. Repeated rows and NULL ids are rows like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = (
        T.StructType()
        .add("doc_id", docs.schema[id_col].dataType)
        .add("held_out", "boolean")
        .add("score", "double")
        .add("predicted", "integer")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = np.full(len(texts), 0.5) if shared.value is None else shared.value.score(texts)
            predicted = pa.array((found >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), predicted], names=schema.names
            )

    return docs.select(F.col(id_col), held_out(F.col(id_col)), F.col(text_col)).mapInArrow(
        run, schema
    )


def keep_predicted(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows the model rejects; all columns pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is None:
                yield batch
            else:
                kept = shared.value.score(batch.column(where).to_pylist()) >= 0.5
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
