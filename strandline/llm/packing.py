"""Bounded-space online best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt evenly over tasks,
and each task streams its pieces through a fixed number of open bins: a piece goes to the
fullest open bin that has room, found in a bitset keyed by free space; when a new bin is
needed and all are open, the fullest one closes. A task keeps the open bins and nothing else.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.staging import staged

#: Whitespace other than blanks and line ends; a blank next to whitespace is no safe place to cut.
_OTHER_SPACES = "".join(
    c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"
)
_MARKS = ".,;:!?|*#$%&()[]{}-"
_TOUCHING = re.compile(r"\s | \s")


def touching(s: str) -> bool:
    """Whether some blank of ``s`` has whitespace beside it."""
    if any(c in s for c in _OTHER_SPACES):
        return _TOUCHING.search(s) is not None
    return "  " in s or " \n" in s or "\n " in s


def core(word: str) -> str:
    """The word without marks behind its last letter, which are tokens of their own."""
    bare = word.rstrip(_MARKS)
    return bare if bare[-1:].isalpha() else word


def stretches(texts: Iterable[str | None], rows: int = 64, chars: int = 1 << 20) -> Iterator[list[str]]:
    """Successive texts, NULL as empty: at most ``rows``, and ``chars`` unless one text is longer."""
    out, held = [], 0
    for s in texts:
        s = s or ""
        if out and (len(out) == rows or held + len(s) > chars):
            yield out
            out, held = [], 0
        out.append(s)
        held += len(s)
    if out:
        yield out


class WordIds(dict):
    """Blank-led word -> its token ids as little-endian uint32 bytes, encoded when first met."""

    #: Entries kept; beyond it the table is emptied before the next texts.
    LIMIT = 1_000_000
    #: Longer words, in characters, are encoded anew each time.
    LONGEST = 64

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores
        from tokenizers import Tokenizer

        super().__init__()
        self.marks = functools.lru_cache(maxsize=4096)(self.text)
        self._tokenizer = Tokenizer.from_file(path)
        #: Strings in a text that the tokenizer reads as one token of their own.
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        #: Whether a token, by id, begins with a blank.
        self._blank_led = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._blank_led[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True

    def text(self, s: str) -> bytes:
        found = self._tokenizer.encode_batch_fast([s], add_special_tokens=False)[0]
        return array("I", found.ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        bare = core(word)
        if bare != word:
            ids = self[bare] + self.marks(word[len(bare) :])
        else:
            ids = self.text(" " + word)
        if len(word) <= self.LONGEST:
            self[word] = ids
        return ids

    def special(self, s: str) -> bool:
        return any(x in s for x in self._special)

    def learn(self, words: Iterable[str]) -> None:
        """Encode new words together, in one call: the blanks between them start tokens, which
        tell their ids apart. Words not learned here are encoded alone when looked up."""
        new = [
            w
            for w in filterfalse(self.__contains__, dict.fromkeys(map(core, words)))
            if w and len(w) <= self.LONGEST and not (w[0].isspace() or w[-1].isspace())
        ]
        joined = " " + " ".join(new)
        if not new or self.special(joined):
            return
        data = self.text(joined)
        starts = np.flatnonzero(self._blank_led[np.frombuffer(data, "<u4")]) * 4
        if len(starts) == len(new):
            at = [*starts.tolist(), len(data)]
            self.update(zip(new, (data[i:j] for i, j in zip(at, at[1:]))))

    def documents(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of whole texts. A blank between two printing characters always starts a
        token, so such texts are looked up word by word. Special strings may hold a blank or
        reach over one, so texts with one are encoded whole."""
        for some in stretches(texts):
            if len(self) > self.LIMIT:
                self.clear()
            split = [[] if touching(s) or self.special(s) else s.split(" ") for s in some]
            new: dict[str, None] = {}
            for words in split:
                new.update(dict.fromkeys(filterfalse(self.__contains__, words[1:])))
            self.learn(new)
            for s, words in zip(some, split):
                if words:
                    yield self.text(words[0]) + b"".join(map(self.__getitem__, words[1:]))
                else:
                    yield self.text(s)

    def document(self, s: str) -> bytes:
        return next(self.documents([s]))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length): only texts over ``capacity`` are cut; the first piece is the
    remainder, all others are full."""
    head = (n - 1) % capacity + 1
    yield 0, 0, head
    for piece, start in enumerate(range(head, n, capacity), 1):
        yield piece, start, capacity


def tokenized_pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, ids.

    A NULL or empty text is the end id alone. A NULL id stays NULL; repeated rows are packed as
    often as they occur. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    schema = (
        T.StructType()
        .add("doc_id", kind)
        .add("piece", "integer")
        .add("start", "long")
        .add("length", "long")
        .add("ids_crc32", "long")
    )
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = word_ids(tokenizer).documents
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, found in enumerate(encoded(batch.column(1).to_pylist())):
                data = found + end
                for k, at, n in cuts(len(data) // 4, capacity):
                    part = data[4 * at : 4 * (at + n)]
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(memoryview(part).cast("I").tolist())
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


class OpenBins:
    """At most ``limit`` open bins; bit f of ``free`` is set if some open bin has f tokens left."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        found = self.bins[free]
        out = found.pop()
        if not found:
            self.free ^= 1 << free
        self.open -= 1
        return out

    def place(self, need: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``need`` tokens."""
        fitting = self.free >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            chosen = self._take(room)
        else:
            room, chosen = self.capacity, self.made
            self.made += 1
        left = room - need
        if left:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            self.bins[left].append(chosen)
            self.free |= 1 << left
            self.open += 1
        return chosen, self.capacity - room


def assign(
    pieces: DataFrame,
    *,
    capacity: int = 1024,
    open_bins: int = 131_072,
    pieces_per_task: int = 400_000,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. ``pieces`` must be a written table, as it is counted
    first. Long pieces arrive first, which best fit packs tightest; ties arrive in a fixed order,
    so that a task that runs again places every piece as before."""
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    at = len(pieces.columns)
    schema = T.StructType([*pieces.schema.fields])
    schema = schema.add("sequence_id", "long").add("offset", "long")
    where = pieces.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in batch.column(where).to_pylist()]
            base = (batch.column(at)[0].as_py() << 40) if placed else 0
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:at],
                    pa.array([base + b for b, _ in placed], pa.int64()),
                    pa.array([o for _, o in placed], pa.int64()),
                ],
                names=schema.names,
            )

    dealt = pieces.repartition(tasks).sortWithinPartitions(
        F.desc("length"), "doc_id", "piece", "ids_crc32"
    )
    return dealt.withColumn("__task", F.spark_partition_id()).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    open_bins: int = 131_072,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id,
    offset. An empty table gives no rows."""
    pieces = staged(
        tokenized_pieces(
            docs,
            tokenizer,
            id_col=id_col,
            text_col=text_col,
            capacity=capacity,
            end_id=end_id,
            with_ids=with_ids,
        )
    )
    return assign(pieces, capacity=capacity, open_bins=open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence with its token ids, from ``pack(..., with_ids=True)``. A group is
    one sequence, so at most its capacity in tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return (
        packed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select(
            "sequence_id",
            F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
            F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        )
    )
