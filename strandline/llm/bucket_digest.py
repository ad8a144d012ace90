"""Document fingerprints by quartile bucket digests.

The byte triplets of a text are hashed into ``BUCKETS`` counters. Each counter is written in two
bits, by the quartile of all counters that it falls in, and the digest ends with the length on a
logarithmic scale. Two digests are compared by a bounded difference: the distance of the
quartiles, where opposite ends count double, on a scale that ends at twice what unrelated digests
give, plus the capped difference of the lengths.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.staging import staged

#: A power of two. More buckets tell texts of one language better apart.
BUCKETS = 1024
#: Distance of two quartiles by their difference; twice its mean over unrelated quartiles.
_STEPS = np.array([0, 1, 2, 6], np.uint8)
_FAR = 2 * (3 * 1 + 2 * 2 + 1 * 6) / 8
#: Steps of the length code to a doubling, and what one step and all steps may add at most.
_LENGTH_SCALE, _LENGTH_STEP, _LENGTH_MOST = 8, 1 / 64, 1 / 4
_SLICE = 1 << 20


def _distances() -> np.ndarray:
    """Summed distance of the four quartiles in two bytes."""
    codes = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    apart = np.abs(codes[:, None, :] - codes[None, :, :])
    return _STEPS[apart].sum(axis=2, dtype=np.uint16)


_APART = _distances()


def buckets(data: bytes) -> np.ndarray:
    """Counts of hashed byte triplets."""
    counts = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(32 - (BUCKETS.bit_length() - 1))
    for at in range(0, max(len(data) - 2, 0), _SLICE):
        x = np.frombuffer(data, np.uint8)[at : at + _SLICE + 2].astype(np.uint32)
        triplet = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
        triplet *= np.uint32(2654435761)
        counts += np.bincount(triplet >> shift, minlength=BUCKETS)
    return counts


def digest(text: str) -> bytes:
    """Quartiles of the buckets, four to a byte, then the length code in two bytes. Counts equal
    to a quartile's limit fall below it, so a text under three bytes has zero quartiles."""
    data = text.encode()
    counts = buckets(data)
    quarter = BUCKETS // 4
    limits = np.partition(counts, [quarter - 1, 2 * quarter - 1, 3 * quarter - 1])
    limits = limits[[quarter - 1, 2 * quarter - 1, 3 * quarter - 1]]
    codes = (counts[:, None] > limits).sum(axis=1, dtype=np.uint8).reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    length = round(_LENGTH_SCALE * math.log2(len(data) + 1))
    return packed.tobytes() + length.to_bytes(2, "big")


def likeness(one: bytes, other: bytes) -> float:
    """1 for equal digests, 0 for those at or beyond the end of the scale."""
    if one == other:
        return 1.0
    a, b = np.frombuffer(one[:-2], np.uint8), np.frombuffer(other[:-2], np.uint8)
    apart = int(_APART[a, b].sum()) / (_FAR * BUCKETS)
    steps = abs(int.from_bytes(one[-2:], "big") - int.from_bytes(other[-2:], "big"))
    return max(0.0, 1.0 - apart - min(_LENGTH_MOST, steps * _LENGTH_STEP))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much, or all, of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = (
    "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)


def _figures(text: str, own: bytes, following: str, after: bytes) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else digest(changed)
    return (
        len(text),
        hashlib.sha256(changed.encode()).digest(),
        own,
        other,
        likeness(own, other),
        likeness(own, after),
    )


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Figures of every row but the last of each range chunk, digests in bytes; of the last and the
    first row the texts are handed on: ``edge`` is 0 for figures, 1 for a first and 2 for a last row."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType().add("doc_id", kind)
    for field in T.StructType.fromDDL(_OUT).fields + T.StructType.fromDDL(
        "edge int, text string, chunk int, copy long"
    ).fields:
        schema = schema.add(field)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, types = None, None
        for batch in batches:
            if types is None:
                types = [batch.schema.field(0).type, pa.int64(), *[pa.binary()] * 3]
                types += [pa.float64()] * 2 + [pa.int32(), pa.string(), pa.int32(), pa.int64()]
            rows = []
            for row, text, chunk, copy in zip(
                *(batch.column(k).to_pylist() for k in range(4)), strict=True
            ):
                text = text or ""
                own = last[2] if last is not None and last[1] == text else digest(text)
                if last is None:
                    rows.append((row, *[None] * 6, 1, text, chunk, copy))
                else:
                    rows.append((last[0], *_figures(last[1], last[2], text, own), 0, *[None] * 3))
                last = row, text, own, chunk, copy
            if rows:
                yield _batch(rows, types, names)
        if last is not None:
            row, text, _, chunk, copy = last
            yield _batch([(row, *[None] * 6, 2, text, chunk, copy)], types, names)

    spread = F.monotonically_increasing_id()  # so that rows that repeat an id are split too
    dealt = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .select("doc_id", "text", F.xxhash64("text").alias("hash"), spread.alias("copy"))
        .repartitionByRange(F.asc_nulls_first("doc_id"), "hash", "copy")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash", "copy")
        .select("doc_id", "text", F.spark_partition_id().alias("chunk"), "copy")
    )
    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
    )


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    per row of ``docs``.

    The next document is that of the next greater id; the first one follows the last, and a
    single document follows itself. A NULL text counts as empty, a NULL id comes first, and rows
    that repeat an id are ordered by a hash of their texts. Other columns are not read. An empty
    table gives no rows. Texts move once, in range chunks of the ids; each chunk hands on its
    first and its last text only.
    """
    found = staged(_chunks(docs, id_col, text_col))
    edges = found.where("edge > 0").select("chunk", "edge", "doc_id", "text")

    # One row for each range chunk and edge; texts are looked up after.
    order = Window.orderBy("chunk")
    firsts = edges.where("edge = 1").select("chunk")
    following = firsts.select(
        "chunk",
        F.coalesce(F.lead("chunk").over(order), F.min("chunk").over(Window.partitionBy())).alias(
            "next_chunk"
        ),
    )
    starts = edges.where("edge = 1").select(
        F.col("chunk").alias("next_chunk"), F.col("text").alias("following")
    )
    ends = edges.where("edge = 2").join(following, "chunk").join(starts, "next_chunk")
    schema = T.StructType().add("doc_id", docs.schema[id_col].dataType)
    for field in T.StructType.fromDDL(_OUT).fields:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), *[pa.binary()] * 3, *[pa.float64()] * 2]
        for batch in batches:
            rows = [
                (row, *_figures(text, digest(text), after, digest(after)))
                for row, text, after in zip(
                    *(batch.column(k).to_pylist() for k in range(3)), strict=True
                )
            ]
            if rows:
                yield _batch(rows, [batch.schema.field(0).type, *types], schema.names)

    closed = ends.select("doc_id", "text", "following").mapInArrow(run, schema)
    whole = found.where("edge = 0").select(*schema.names).unionByName(closed)
    digests = ("edited_sha256", "fingerprint", "edited_fingerprint")
    return whole.select(
        *[F.lower(F.hex(c)).alias(c) if c in digests else F.col(c) for c in schema.names]
    )

