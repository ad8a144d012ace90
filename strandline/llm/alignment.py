"""Cross-tokenizer alignment with link counts by external spill counting.

A text is encoded by a byte-level tokenizer (A) and a piece tokenizer (B). Byte offsets where
tokens of both end cut them into groups, and the two tokens that end there are linked. How often
a pair of ids is linked in the whole corpus is counted outside memory:

1. Documents are read in blocks. The pair-document records of a block are radix-partitioned by
   B id and written as zstd runs, one for a block and part: a head with the pairs in B-major
   order and their counts, and a body with the documents of each pair.
2. Heads meet by part. A k-way heap merge adds up the counts of each pair; as the order is
   B-major, the highest count of a B id is known when its last pair has passed.
3. Bodies meet the counts of their part, run by run, so that a part with a hot id is split over
   tasks. Each run streams back what it contributes to its documents, and blocks add these up.

No step holds more than a block, ``FAN_IN`` heads or the pairs of one part; the pairs of a part
are bounded by the vocabularies, not by the corpus.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.staging import staged

#: Runs that one merge reads at a time.
FAN_IN = 128
_CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=\S\n)(?=\S)")
_OTHER_SPACES = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_UNEASY = ("\0", "  ", "\n\n", " \n", "\n ", *_OTHER_SPACES)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, loaded once per worker, and the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        codes = byte_alphabet()
        special = {x["id"] for x in json.loads(self.a.to_str())["added_tokens"]}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = entry.encode() if i in special else bytes(codes[c] for c in entry)
        size = self.b.get_piece_size()
        pieces = self.b.id_to_piece(list(range(size)))
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        inner = [p for p in pieces if "▁" in p[1:] and p.strip("▁")]
        if inner or any("\n" in p for p in pieces):
            raise ValueError("pieces of the second tokenizer reach over white space")
        self.names_a = [str(i) for i in range(len(self.bytes_a))]
        self.names_b = [str(i) for i in range(size)]
        self.lengths_a, self.lengths_b = (
            np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b)
        )
        self.said_a = np.array([(x + ",", x + "|") for x in self.names_a], object)
        self.said_b = np.array([(x + ",", x + ";", x) for x in self.names_b], object)
        self._before = len(self.b.encode("\n"))

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units of a text that begins with a space. The piece tokenizer puts a space
        before its input, so units are encoded behind a line end, and both are cut off."""
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode(["\n" + u for u in units], num_threads=1)
        return a, [x[self._before :] for x in b]

    def groups(self, a: list[int], b: list[int]) -> tuple[str, list[tuple[int, int]]]:
        """The groups as text, and the links: the two tokens that end each group."""
        names_a, names_b = self.names_a, self.names_b
        if len(a) == 1 or len(b) == 1:
            text = ",".join([names_a[x] for x in a]) + "|" + ",".join([names_b[x] for x in b])
            return text, [(a[-1], b[-1])]
        ends_a = list(accumulate([len(self.bytes_a[x]) for x in a]))
        ends_b = list(accumulate([len(self.bytes_b[x]) for x in b]))
        at_b = {end: j for j, end in enumerate(ends_b)}
        parts, links, i0, j0 = [], [], 0, 0
        for i, end in enumerate(ends_a):
            j = at_b.get(end)
            if j is not None:
                parts.append(
                    ",".join([names_a[x] for x in a[i0 : i + 1]])
                    + "|"
                    + ",".join([names_b[x] for x in b[j0 : j + 1]])
                )
                links.append((a[i], b[j]))
                i0, j0 = i + 1, j + 1
        return ";".join(parts), links


@functools.lru_cache(maxsize=2)
def pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def units(full: str) -> list[str]:
    """Stretches of a text that both tokenizers encode alike alone and in the text.

    Cuts lie before a blank or line end that follows a printing character, and between a single
    line end and a printing character: no token of either reaches over these.
    """
    if any(x in full for x in _UNEASY):
        return _CUT.split(full)
    found = full.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return found[1:-1] if full[-1] == "\n" else found[1:]


class Units:
    """Units met so far: group text, token numbers and links, one number for each unit."""

    #: Units kept; beyond it the table is emptied before the next block.
    LIMIT = 400_000

    def __init__(self, tokenizers: Pair):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes = array("q")  # n_a, n_b, n_links, without tokens: 1
        self.starts = array("q", [0])
        self.links = array("q")  # numbers of pairs
        self.pairs: dict[int, int] = {}  # B id, A id in 32 bits each -> number

    def learn(self, new: list[str]) -> None:
        plain = [u for u in new if u.split() == [u if u[0] != " " else u[1:]] and "▁" not in u]
        self._learn_together(plain)
        rest = sorted(set(new).difference(plain))
        t = self.tokenizers
        for unit, a, b in zip(rest, *t.encode(rest), strict=True):
            data = unit.encode()
            whole = (
                b"".join([t.bytes_a[x] for x in a]) == data
                and b"".join([t.bytes_b[x] for x in b]) == data
            )
            text, links = t.groups(a, b) if whole else ("", [])
            self.number[unit] = len(self.texts)
            self.texts.append(text)
            self.sizes.extend((len(a), len(b), len(links), not whole))
            self.links.extend(self._pair(b_id << 32 | a_id) for a_id, b_id in links)
            self.starts.append(len(self.links))

    def _pair(self, code: int) -> int:
        return self.pairs.setdefault(code, len(self.pairs))

    def _learn_together(self, plain: list[str]) -> None:
        """Units that are a word with or without a blank, encoded as one text: each starts at a
        cut if a line end stands before those without a blank. Line ends are units to be left out.
        """
        if not plain:
            return
        t = self.tokenizers
        parts = [x for u in plain for x in ((u,) if u[0] == " " else ("\n", u))]
        (a,), (b,) = (np.array(x) for x in t.encode(["".join(parts)]))
        ends_a, ends_b = np.cumsum(t.lengths_a[a]), np.cumsum(t.lengths_b[b])
        bounds = np.cumsum([len(x.encode()) for x in parts])
        ends, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        if not np.isin(bounds, ends).all():
            raise ValueError("a token reaches over a cut")
        last_a, last_b = np.zeros(len(a), int), np.zeros(len(b), int)
        last_a[at_a], last_b[at_b] = 1, 1
        last_b[at_b[np.isin(ends, bounds)]] = 2
        # Groups one after the other, in each the tokens of A before those of B.
        order_a = np.arange(len(a)) + np.append(0, at_b + 1)[np.searchsorted(ends, ends_a)]
        order_b = np.arange(len(b)) + at_a[np.searchsorted(ends, ends_b)] + 1
        said = np.empty(len(a) + len(b), object)
        said[order_a], said[order_b] = t.said_a[a, last_a], t.said_b[b, last_b]
        said = said.tolist()
        codes, back = np.unique((b[at_b] << 32) | a[at_a], return_inverse=True)
        numbers = np.array([self._pair(c) for c in codes.tolist()], np.int64)[back]
        counts = [
            np.diff(np.searchsorted(x, bounds, "right"), prepend=0) for x in (ends_a, ends_b, ends)
        ]
        upto = np.cumsum(counts[0] + counts[1]).tolist()
        links = np.cumsum(counts[2]).tolist()
        sizes = np.stack(counts, axis=1).tolist()
        for k, unit in enumerate(parts):
            if unit != "\n":
                self.number[unit] = len(self.texts)
                self.texts.append("".join(said[upto[k - 1] if k else 0 : upto[k]]))
                self.sizes.extend((*sizes[k], 0))
                self.links.frombytes(numbers[links[k - 1] if k else 0 : links[k]].tobytes())
                self.starts.append(len(self.links))


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart, as one zstd frame."""
    planes = [x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(widths), 0, []
    for kind, width in zip(kinds, widths, strict=True):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += n * width
    return out


HEAD = ("<u8", "<u8", "<u4")  # pair, links, documents
BODY = ("<u4", "<u4")  # document of the block (a difference within a pair), links
COUNTS = ("<u8", "<u8", "u1")  # pair, links, whether its B id has no pair with more


class Block:
    """Documents read together: their own figures, and their pair-document records."""

    def __init__(self, table: Units):
        self.table = table
        self.rows: list[pa.Scalar] = []
        self.numbers: list[np.ndarray] = []
        self.digests: list[str] = []
        self.units = 0

    def add(self, ids: Iterable[pa.Scalar], texts: list[str | None]) -> None:
        known = self.table.number
        parts = [units(" " + t) if t else [] for t in texts]
        new = set().union(*parts).difference(known)
        if new:
            self.table.learn(sorted(new))
        said = self.table.texts
        for row, part in zip(ids, parts, strict=True):
            numbers = [known[u] for u in part]
            text = ";".join([said[k] for k in numbers])
            self.rows.append(row)
            self.numbers.append(np.array(numbers, np.int64))
            self.digests.append(hashlib.sha256(text.encode()).hexdigest() if part else "")
            self.units += len(part)

    def _counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, unit, times) of all units of texts that have tokens."""
        lengths = [len(x) for x in self.numbers]
        doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        key = (doc << 32) | np.concatenate([*self.numbers, np.empty(0, np.int64)])
        key, times = np.unique(key, return_counts=True)
        return key >> 32, key & 0xFFFFFFFF, times

    def finish(self, parts: int) -> tuple[dict[str, np.ndarray], Iterator[tuple[int, bytes, bytes]]]:
        """Figures of each document, and (part, head, body) of every run."""
        doc, unit, times = self._counted()
        sizes = np.array(self.table.sizes, np.int64).reshape(-1, 4)[unit] * times[:, None]
        sums = np.zeros((len(self.rows), 4), np.int64)
        np.add.at(sums, doc, sizes)
        bad = sums[:, 3] > 0
        sums[bad] = 0
        for k in np.flatnonzero(bad):
            self.digests[k] = ""
        good = ~bad[doc]
        figures = dict(zip(("n_a", "n_b", "n_links"), sums.T[:3], strict=True))
        return figures, self._runs(doc[good], unit[good], times[good], parts)

    def _runs(self, doc, unit, times, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
        starts = np.array(self.table.starts, np.int64)
        first, many = starts[unit], starts[unit + 1] - starts[unit]
        total = int(many.sum())
        if not total:
            return
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
        link = np.array(self.table.links, np.int64)[at]
        doc, times = np.repeat(doc, many), np.repeat(times, many)
        pairs = np.array(list(self.table.pairs), np.int64)
        b, a = pairs >> 32, pairs & 0xFFFFFFFF
        order = np.lexsort((a, b, b % parts))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        record = place[link] * len(self.rows) + doc
        record, back = np.unique(record, return_inverse=True)
        n = np.zeros(len(record), np.int64)
        np.add.at(n, back, times)
        spot, doc = record // len(self.rows), record % len(self.rows)
        begins = np.flatnonzero(np.diff(spot, prepend=-1))
        own = order[spot[begins]]
        codes = pairs[own].astype("<u8")
        links = np.add.reduceat(n, begins)
        docs = np.diff(begins, append=len(record))
        step = np.diff(doc, prepend=0)
        step[begins] = doc[begins]
        part = b[own] % parts
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(edges, [*edges[1:], len(part)], strict=True):
            head = squeeze(codes[lo:hi], links[lo:hi].astype("<u8"), docs[lo:hi].astype("<u4"))
            inner = slice(begins[lo], begins[hi] if hi < len(begins) else len(record))
            yield int(part[lo]), head, squeeze(step[inner].astype("<u4"), n[inner].astype("<u4"))


def spilled(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    *,
    id_col: str,
    text_col: str,
    parts: int,
    block_docs: int,
    block_units: int,
) -> DataFrame:
    """Rows of documents (``part`` NULL) and of runs, by block."""
    own = [("doc_id", docs.schema[id_col].dataType), ("at", T.LongType())]
    own += [(x, T.LongType()) for x in ("n_a", "n_b", "n_links")]
    own += [("groups_sha256", T.StringType())]
    runs = [("part", T.IntegerType()), ("head", T.BinaryType()), ("body", T.BinaryType())]
    schema = T.StructType([T.StructField(*x) for x in [("block", T.LongType()), *own, *runs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Units(pair(byte_path, piece_path))
        serial = TaskContext.get().partitionId() << 32
        block, kinds = Block(table), None

        def batch_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
            blank = {f.name: pa.nulls(n, t) for f, t in zip(schema.fields, kinds, strict=True)}
            blank["block"] = pa.array([serial] * n, pa.int64())
            return pa.RecordBatch.from_pydict(blank | columns)

        def out() -> Iterator[pa.RecordBatch]:
            figures, spills = block.finish(parts)
            n = len(block.rows)
            yield batch_of(
                n,
                doc_id=pa.array([x.as_py() for x in block.rows], kinds[1]),
                at=pa.array(range(n), pa.int64()),
                groups_sha256=pa.array(block.digests, pa.string()),
                **{k: pa.array(v, pa.int64()) for k, v in figures.items()},
            )
            for part, head, body in spills:
                yield batch_of(
                    1,
                    part=pa.array([part], pa.int32()),
                    head=pa.array([head], pa.binary()),
                    body=pa.array([body], pa.binary()),
                )

        for batch in batches:
            if kinds is None:
                kinds = [pa.int64(), batch.schema.field(0).type, *[pa.int64()] * 4, pa.string()]
                kinds += [pa.int32(), pa.binary(), pa.binary()]
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                block.add(part.column(0), part.column(1).to_pylist())
                if len(block.rows) >= block_docs or block.units >= block_units:
                    yield from out()
                    serial += 1
                    if len(table.texts) > table.LIMIT:
                        table.clear()
                    block = Block(table)
        if block.rows:
            yield from out()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


Run = tuple[np.ndarray, np.ndarray]


def merged(runs: list[Run]) -> Run:
    """One run of the pairs of all, counts added up, by a k-way heap merge."""
    pairs, counts, last = array("Q"), array("Q"), -1
    streams = [zip(p.tolist(), n.tolist(), strict=True) for p, n in runs]
    for code, n in heapq.merge(*streams):
        if code == last:
            counts[-1] += n
        else:
            pairs.append(code)
            counts.append(n)
            last = code
    return np.array(pairs, np.uint64), np.array(counts, np.uint64)


def best_flags(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether no pair of the same B id has a higher count; ``pairs`` are in B-major order."""
    side = pairs >> np.uint64(32)
    begins = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    highest = np.maximum.reduceat(counts, begins)
    sizes = np.diff(np.append(begins, len(pairs)))
    return (counts == np.repeat(highest, sizes)).astype(np.uint8)


def pair_counts(runs: DataFrame) -> DataFrame:
    """(part, counts): the pairs of each part with their corpus-wide counts and best flags."""
    names = ["part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting = None, []

        def done() -> pa.RecordBatch:
            pairs, counts = merged(waiting)
            packed = squeeze(pairs, counts, best_flags(pairs, counts))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=names
            )

        for batch in batches:
            for p, head in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p != part:
                    if waiting:
                        yield done()
                    part, waiting = p, []
                waiting.append(tuple(unsqueeze(head.as_py(), *HEAD)[:2]))
                if len(waiting) == FAN_IN:
                    waiting = [merged(waiting)]
        if waiting:
            yield done()

    dealt = runs.select("part", "head").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "part int, counts binary")


def contributions(runs: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """(block, sums): what each run adds to ``n_best`` and ``count_sum`` of its documents."""
    names = ["block", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pairs, links, best = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    pairs, links, best = unsqueeze(row["counts"], *COUNTS)
                    part = row["part"]
                codes, _, many = unsqueeze(row["head"], *HEAD)
                step, n = unsqueeze(row["body"], *BODY)
                at = np.repeat(np.searchsorted(pairs, codes), many)
                begins = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64)
                doc = np.cumsum(step.astype(np.int64))
                doc -= np.repeat(doc[begins] - step[begins], many)
                found, back = np.unique(doc, return_inverse=True)
                sums = np.zeros((2, len(found)), np.uint64)
                np.add.at(sums[0], back, n * best[at].astype(np.uint64))
                np.add.at(sums[1], back, n * links[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]], pa.int64()),
                        pa.array([squeeze(found.astype("<u4"), *sums)], pa.binary()),
                    ],
                    names=names,
                )

    spark = runs.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    salted = runs.select("part", "block", "head", "body").withColumn(
        "salt", F.pmod("block", F.lit(salts)).cast("int")
    )
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = salted.join(spread, ["part", "salt"]).select("part", "block", "head", "body", "counts")
    return met.mapInArrow(run, "block long, sums binary")


def document_sums(found: DataFrame) -> DataFrame:
    """(block, at, n_best, count_sum) from the contributions of all runs of a block."""
    names = ["block", "at", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros((2, 0), np.uint64)

        def done() -> pa.RecordBatch:
            n = sums.shape[1]
            columns = [np.full(n, block), np.arange(n), *sums.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != block:
                    if sums.shape[1]:
                        yield done()
                    block, sums = b, np.zeros((2, 0), np.uint64)
                doc, *more = unsqueeze(data.as_py(), "<u4", "<u8", "<u8")
                wanted = int(doc[-1]) + 1
                if wanted > sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, wanted - sums.shape[1])))
                sums[:, doc] += np.array(more)
        if sums.shape[1]:
            yield done()

    dealt = found.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def align(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int = 64,
    block_docs: int = 4096,
    block_units: int = 500_000,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs``.

    A text is encoded behind one space. NULL and empty texts, and texts that a tokenizer does not
    give back byte by byte, have no tokens: their figures are zero, their digest is empty and
    they add nothing to counts. Pairs with equal counts are all best. A NULL id stays NULL;
    repeated rows stay and count as often as they occur. Other columns are not read. An empty
    table gives no rows.
    """
    both = staged(
        spilled(
            docs,
            byte_path,
            piece_path,
            id_col=id_col,
            text_col=text_col,
            parts=parts,
            block_docs=block_docs,
            block_units=block_units,
        )
    )
    runs = both.where(F.col("part").isNotNull())
    sums = document_sums(contributions(runs, pair_counts(runs), parts))
    own = both.where(F.col("part").isNull()).drop("part", "head", "body")
    zero = F.lit(0).cast("long")
    return own.join(sums, ["block", "at"], "left").select(
        "doc_id",
        "n_a",
        "n_b",
        F.col("n_links").alias("n_groups"),
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
