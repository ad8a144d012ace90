"""Near-duplicates by SimHash and the generalised pigeonhole principle.

Fingerprints are 64 bits. All fingerprints within ``radius`` differing bits of each other are
linked, exactly: bits are grouped into partitions, correlated bits together, and partition i
gets a threshold t_i >= -1 with sum(t_i) = radius - partitions + 1. Two fingerprints within the
radius then agree up to t_i bits in some partition with t_i >= 0. Thresholds, and the number of
partitions, come from dynamic programming over estimated candidates, whose bit statistics cover
all fingerprints. Rows are probed under (partition, value) and candidates verified.

Only distinct fingerprints take part, so exact copies cost one row. A bucket with more than
``bucket_rows`` rows is not paired up: its fingerprints emit themselves and their one-bit (for
radius 2) neighbours, and those sharing a value are linked to the least of them. Two
fingerprints are within 2k bits exactly if their k-bit neighbourhoods meet, so no link of such
a bucket is lost and the work stays linear in its rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.arrays import free_names
from strandline.llm.components import components
from strandline.llm.staging import staged

BITS = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text as an unsigned number; 0 without words."""
    words = text.lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        tuples = [words]
    else:
        tuples = zip(*(words[k:] for k in range(shingle)), strict=False)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(t), 42) for t in tuples], np.dtype("<u8"))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    set_bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(set_bits.view(np.dtype("<u8"))[0])


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """(doc_id, fp) per row, fp as a signed long. A NULL text counts as empty."""
    schema = T.StructType().add("doc_id", docs.schema[id_col].dataType).add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=schema.names
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(number of rows, 64 x 64 counts of bits set together) over all of ``fp``."""
    names = [f"b{j}" for j in range(BITS)]
    schema = T.StructType().add("i", "integer")
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            seen += len(fps)
            for at in range(0, len(fps), 65_536):
                part = fps[at : at + 65_536].astype("<i8").view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)  # exact: counts below 2**24
        if seen:
            rows = [pa.array([*range(BITS), BITS], pa.int32())]
            both = np.vstack([total, np.full((1, BITS), seen)])
            yield pa.RecordBatch.from_arrays(
                [*rows, *(pa.array(both[:, j]) for j in range(BITS))], names=schema.names
            )

    sums = (
        nodes.select("fp")
        .mapInArrow(run, schema)
        .groupBy("i")
        .agg(*[F.sum(n).alias(n) for n in names])
        .collect()  # 65 rows
    )
    table = {r.i: [r[n] for n in names] for r in sums}
    if not table:
        return 0, np.zeros((BITS, BITS), np.int64)
    return table[BITS][0], np.array([table[i] for i in range(BITS)])


def grouped_bits(rows: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of about equal size; each takes the bits most correlated with it."""
    p = np.diag(together) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs((together / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(phi, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(sorted(left), key=lambda b: phi[b, sorted(left)].sum())
        group = [first]
        left.remove(first)
        while len(group) < size:
            nearest = max(sorted(left), key=lambda b: phi[b, group].sum())
            group.append(nearest)
            left.remove(nearest)
        groups.append(sorted(group))
    return groups


def chance_within(differ: np.ndarray, most: int) -> np.ndarray:
    """P(at most t of independent bits differ) for t = 0..most."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for q in differ:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return np.cumsum(chance)


@dataclass(frozen=True)
class Plan:
    """Bit groups, their thresholds (-1: not probed) and the estimated number of rows."""

    groups: list[list[int]]
    thresholds: list[int]
    cost: float


def allocate(rows: int, together: np.ndarray, radius: int, parts: int) -> Plan:
    """Thresholds of least estimated cost (probe rows and candidate pairs) for ``parts`` groups."""
    groups = grouped_bits(rows, together, parts)
    p = np.diag(together) / max(rows, 1)
    differ, pairs = 2 * p * (1 - p), rows * (rows - 1) / 2
    cost = []
    for group in groups:
        within = chance_within(differ[group], radius)
        probes = np.cumsum([math.comb(len(group), k) for k in range(radius + 1)]) * rows
        cost.append([0.0, *(pairs * within + probes)])
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t in range(-1, radius + 1):
                entry = (spent + options[t + 1], [*chosen, t])
                if total + t not in step or entry < step[total + t]:
                    step[total + t] = entry
        best = step
    spent, chosen = best[radius - parts + 1]
    return Plan(groups, chosen, spent)


def probe_plan(rows: int, together: np.ndarray, radius: int) -> Plan:
    plans = [allocate(rows, together, radius, m) for m in range(1, radius + 3)]
    return min(plans, key=lambda x: x.cost)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], most: int) -> list[int]:
    """All masks of up to ``most`` of ``bits``; 0 first."""
    return [
        _signed(sum(1 << b for b in chosen))
        for k in range(most + 1)
        for chosen in itertools.combinations(bits, k)
    ]


def probes(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(part, value, fp, own): every fingerprint under its own value and those near it."""
    entries = [
        F.struct(
            F.lit(part).alias("part"),
            F.lit(_signed(sum(1 << b for b in bits))).alias("mask"),
            F.array(*[F.lit(x).cast("long") for x in _flips(bits, t)]).alias("flips"),
        )
        for part, (bits, t) in enumerate(zip(plan.groups, plan.thresholds, strict=True))
        if t >= 0
    ]
    by_part = nodes.select("fp", F.inline(F.array(*entries)))
    return by_part.select("fp", "part", "mask", F.explode("flips").alias("flip")).select(
        "part",
        F.col("fp").bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("value"),
        "fp",
        (F.col("flip") == 0).alias("own"),
    )


def links(nodes: DataFrame, radius: int = 2, bucket_rows: int = 32) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs within ``radius`` bits."""
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even")
    rows, together = bit_statistics(nodes)
    found = probes(nodes, probe_plan(rows, together, radius))
    loads = found.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    busy = staged(found.join(loads, ["part", "value"]))
    cold = busy.where(F.col("n") <= bucket_rows)
    a = cold.where("own").select("part", "value", F.col("fp").alias("u"))
    b = cold.select("part", "value", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    paired = (
        a.join(b, ["part", "value"]).where((F.col("u") != F.col("v")) & near).select("u", "v")
    )
    around = F.array(*[F.lit(x).cast("long") for x in _flips(list(range(BITS)), radius // 2)])
    meeting = (
        busy.where(F.col("n") > bucket_rows)
        .select("fp")
        .distinct()
        .select("fp", F.explode(around).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    )
    least = meeting.groupBy("value").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n"))
    starred = meeting.join(least.where("n > 1"), "value").select(F.col("fp").alias("u"), "v")
    return paired.unionByName(starred)


def grouped(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 2,
    shingle: int = 3,
    bucket_rows: int = 32,
) -> DataFrame:
    """(doc_id, fp, root, component_id) per row: ``root`` is the least fingerprint that links
    reach, ``component_id`` the least id."""
    found = staged(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    nodes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = staged(components(links(nodes, radius, bucket_rows)))
    members = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    linked = members.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = members.join(linked, "root").select("fp", "root", "component_id")
    return found.join(of_fp, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``; options as for ``grouped``.

    ``component_id`` is the least id that links reach, the row's own included. Texts without a
    word (NULL, empty, blank) have fingerprint zero and are linked like any other. Rows with a
    NULL id get the component of their fingerprint (NULL if no row in it has an id). Repeated
    rows stay. Other columns are not read.
    """
    return grouped(docs, **options).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the least id, and of rows that
    repeat it one with the group's least fingerprint. So a row that repeats an id stays if its
    text is a near copy of no other. Rows without an id stay. All columns pass. Further options
    as for ``grouped``."""
    found = staged(
        grouped(docs, id_col=id_col, text_col=text_col, **options).where(F.col("doc_id").isNotNull())
    )
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("kept")).select("kept.*")
    several = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own, print_, other = free_names(docs, "kept_id", "fp", "kept_fp")
    by_id = F.col(id_col) == F.col(own)
    ids = lambda df: df.select(F.col("doc_id").alias(own)).distinct()
    known = docs.where(F.col(id_col).isNotNull())
    single = known.join(ids(several), by_id, "left_anti").join(ids(kept), by_id, "left_semi")
    again = known.join(ids(several), by_id, "left_semi")
    printed = with_fingerprints(again, print_, text_col=text_col, shingle=options.get("shingle", 3))
    pairs = kept.select(F.col("doc_id").alias(own), F.col("fp").alias(other))
    chosen = printed.dropDuplicates([id_col, print_]).join(
        pairs, by_id & (F.col(print_) == F.col(other)), "left_semi"
    )
    return single.unionByName(chosen.drop(print_)).unionByName(docs.where(F.col(id_col).isNull()))


def with_fingerprints(
    docs: DataFrame, name: str, *, text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """``docs`` and the fingerprint of each row's text, as a signed long, in column ``name``."""
    schema = T.StructType([*docs.schema.fields]).add(name, "long")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found.view(np.int64))], names=schema.names
            )

    return docs.mapInArrow(run, schema)
