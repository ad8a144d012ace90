"""Conversation prefix trie by adaptive radix trees.

Every distinct sequence of the first d turns of a conversation is a node. A turn is a fixed-width
big-endian id (16 bytes of its SHA-256, 4 bytes with its number of words), a conversation the
concatenation of its ids. Conversations are range-partitioned by these keys, and each stretch of a
partition, of at most ``shard_bytes``, becomes a radix tree with resizable node layouts and path
compression, which emits nodes at turn-aligned byte depths only.

A node that lies in one stretch is finished there. Nodes on the path of a stretch's first or last
key may go on in its neighbours: these edge nodes are emitted as partial sums and added up, so a
prefix or conversation that a third of all rows share is split over tasks like any other. The
ids of conversations that end at an edge node travel as sorted runs and are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.arrays import split_words
from strandline.llm.staging import staged

WIDTH = 20
_SPACES = r"[\x20\x09-\x0D]+"
NODE_COLUMNS = (
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
)


class Sorted:
    """A layout of up to ``most`` children: sorted bytes and their nodes."""

    def __init__(self, most: int):
        self.most, self.keys, self.nodes = most, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.keys, byte)
        return self.nodes[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, node: Node) -> bool:
        """False if a larger layout is needed."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
        elif len(self.keys) == self.most:
            return False
        else:
            self.keys.insert(at, byte)
            self.nodes.insert(at, node)
        return True

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.nodes, strict=True)


class Indexed:
    """A layout of up to 48 children: one slot number for each byte."""

    most = 48

    def __init__(self):
        self.slots, self.nodes = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        slot = self.slots[byte]
        return self.nodes[slot - 1] if slot else None

    def put(self, byte: int, node: Node) -> bool:
        slot = self.slots[byte]
        if slot:
            self.nodes[slot - 1] = node
        elif len(self.nodes) == self.most:
            return False
        else:
            self.nodes.append(node)
            self.slots[byte] = len(self.nodes)
        return True

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.nodes[s - 1]) for b, s in enumerate(self.slots) if s)


class Direct:
    """A layout with a place for every byte."""

    most = 256

    def __init__(self):
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


_NO_CHILDREN = Sorted(0)
_LARGER = {0: lambda: Sorted(4), 4: lambda: Sorted(16), 16: Indexed, 48: Direct}


class Node:
    """``path``: the bytes that lead here from the parent, its branching byte first."""

    __slots__ = (
        "path",
        "layout",
        "ends",
        "count",
        "least",
        "below",
        "below_inner",
        "tops",
        "tops_inner",
    )

    def __init__(self, path: bytes):
        self.path, self.layout, self.ends = path, _NO_CHILDREN, array("q")

    def put(self, node: Node) -> None:
        while not self.layout.put(node.path[0], node):
            larger = _LARGER[self.layout.most]()
            for byte, child in self.layout.items():
                larger.put(byte, child)
            self.layout = larger


def _common(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi - 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, conv: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.layout.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.put(child)
            elif not key.startswith(child.path, at):
                same = _common(child.path, key[at : at + len(child.path)])
                upper = Node(child.path[:same])
                child.path = child.path[same:]
                upper.put(child)
                node.put(upper)
                child = upper
            at += len(child.path)
            node = child
        node.ends.append(conv)

    def _ordered(self) -> list[tuple[Node, Node | None, int]]:
        """(node, parent, length of the key up to the node's path), parents first."""
        found, stack = [], [(self.root, None, 0)]
        while stack:
            entry = stack.pop()
            found.append(entry)
            node, _, start = entry
            stack += [(child, node, start + len(node.path)) for _, child in node.layout.items()]
        return found

    def emit(self, first: bytes, last: bytes) -> tuple[list[tuple], list[tuple], list[tuple]]:
        """Finished nodes, edge nodes and ends of edge nodes; ``first`` and ``last`` are the
        least and the greatest key. An edge node is known by a chained hash of its turns."""
        order = self._ordered()
        on_edge: dict[int, int] = {id(self.root): 3}
        for node, parent, start in order[1:]:
            flags = on_edge.get(id(parent), 0)
            byte = node.path[0]
            on = [
                bit
                for bit, key in ((1, first), (2, last))
                if flags & bit and len(key) > start and key[start] == byte
            ]
            if on:
                on_edge[id(node)] = sum(on)
        for node, _, start in reversed(order):
            self._sum_up(node, start, id(node) in on_edge)
        return self._rows(order, on_edge, first, last)

    @staticmethod
    def _depths(node: Node, start: int) -> range:
        """Turn-aligned byte depths on the node's path, deepest first; the root is at 0."""
        end = start + len(node.path)
        return range(end // WIDTH * WIDTH, start if node.path else -1, -WIDTH)

    @staticmethod
    def _words(node: Node, start: int, depth: int) -> int:
        """Words of the turn that ends at ``depth``. Ids differ within their hash, so the four
        bytes behind it never lie on two paths."""
        return int.from_bytes(node.path[max(depth - start - 4, 0) : depth - start], "big")

    def _sum_up(self, node: Node, start: int, edge: bool) -> None:
        """``count`` and ``least`` of the members; ``below``: number, leaves and saved tokens of
        the topmost trie nodes below the path, ``below_inner``: of those that are no edge nodes;
        ``tops`` and ``tops_inner``: the same, the path included."""
        children = [child for _, child in node.layout.items()]
        node.count = len(node.ends) + sum(c.count for c in children)
        node.least = min([*node.ends[:1], *(c.least for c in children)])
        node.below = tuple(sum(c.tops[k] for c in children) for k in range(3))
        node.below_inner = tuple(sum(c.tops_inner[k] for c in children) for k in range(3))
        node.tops, node.tops_inner = node.below, node.below_inner
        depths = self._depths(node, start)
        if depths:
            own = sum(self._words(node, start, d) for d in depths) * (node.count - 1)
            node.tops = (1, node.below[1] or 1, node.below[2] + own)
            node.tops_inner = (0, 0, 0) if edge else node.tops

    def _rows(self, order: list, on_edge: dict, first: bytes, last: bytes) -> tuple:
        finished, edges, ends = [], [], []
        chains = {bit: chained(key) for bit, key in ((1, first), (2, last))}
        above = {None: (None, None)}  # conv_id of the trie node above, its hash if on the edge
        for node, parent, start in order:
            chain = chains.get(on_edge.get(id(node), 0) & 1 or on_edge.get(id(node), 0))
            up = above[id(parent) if parent is not None else None]
            saved, rows = node.below[2], []
            for depth in self._depths(node, start):
                words = self._words(node, start, depth)
                saved += (node.count - 1) * words
                rows.append((depth, words, saved))
            for depth, words, saved in reversed(rows):
                deepest = depth == rows[0][0]
                turn = depth // WIDTH
                if chain is None:
                    below = (node.below[0] if deepest else 1, node.below[1] or 1, saved)
                    digest = ends_digest(node.ends if deepest else ())
                    finished.append((node.least, turn, *up, node.count, *below, digest))
                    up = (node.least, None)
                else:
                    below = node.below_inner if deepest else (0, 0, 0)
                    top = chain[1] if turn else None
                    edges.append(
                        (node.least, turn, up[1], chain[turn], top, words, node.count, *below)
                    )
                    if deepest and node.ends:
                        ends.append((chain[turn], node.ends[0], node.ends.tobytes()))
                    up = (None, chain[turn])
            above[id(node)] = up
        return finished, edges, ends


def chained(key: bytes) -> list[bytes]:
    """A hash for every number of turns, each made of the one before and the next turn."""
    found = [bytes(16)]
    for at in range(0, len(key), WIDTH):
        found.append(hashlib.blake2b(found[-1] + key[at : at + WIDTH], digest_size=16).digest())
    return found


_NONE = hashlib.sha256().hexdigest()


def ends_digest(ids: array | tuple) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else _NONE


def turn_ids(
    conversations: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, turns): the ids of each conversation in order, in hexadecimal.

    Turns are ordered by turn, NULL first; rows of one turn by their ids. Repeated rows stay, a
    NULL role or text counts as empty, rows without a conversation id belong to none. The ids of
    one conversation meet in one row, 40 characters a turn.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.lpad(F.hex(F.size(split_words(text, _SPACES))), 8, "0")
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.concat(F.substring(F.sha2(said, 256), 1, 32), words).alias("id"),
    )
    return (
        conversations.where(F.col(conv_col).isNotNull())
        .groupBy(F.col(conv_col).cast("long").alias("conv_id"))
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: t["id"]).alias("turns"))
    )


def with_shared_starts(turns: DataFrame, stride: int = 20, starts: int = 4) -> DataFrame:
    """Every conversation with its first h turns replaced by those of the conversation whose id
    is its own less the remainder (of its sign) by ``stride`` (fewer if that has fewer, none if it is absent);
    h is the CRC-32 of the decimal id modulo ``starts``."""
    turns = staged(turns)
    h = (F.crc32(F.col("conv_id").cast("string")) % starts).cast("int")
    heads = turns.select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, starts).alias("head")
    )
    own = turns.select("conv_id", "turns", h.alias("h"), _base(F.col("conv_id"), stride))
    lent = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(lent, rest).alias("turns"))


def _base(conv: Column, stride: int) -> Column:
    return (conv - conv % stride).alias("base")


_FOUND = (
    "kind int, conv_id long, depth long, parent_conv_id long, parent binary, node binary, "
    "top binary, words long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, ids binary"
)
_NAMES = [part.split()[0] for part in _FOUND.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_COLUMNS = (
    ("conv_id", "depth", "parent_conv_id", "parent", "n_convs", "n_children", "n_leaves",
     "saved_tokens", "ends_sha256"),
    ("conv_id", "depth", "parent", "node", "top", "words", "n_convs", "n_children", "n_leaves",
     "saved_tokens"),
    ("node", "conv_id", "ids"),
)


def _batches(tree: RadixTree, first: bytes, last: bytes) -> Iterator[pa.RecordBatch]:
    types = {n: _TYPES[part.split()[1]] for n, part in zip(_NAMES, _FOUND.split(", "), strict=True)}
    for kind, rows in enumerate(tree.emit(first, last)):
        if rows:
            columns = dict(zip(_COLUMNS[kind], zip(*rows, strict=True), strict=True))
            columns["kind"] = [kind] * len(rows)
            blank = [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns.get(n, blank), types[n]) for n in _NAMES], names=_NAMES
            )


def shards(keyed: DataFrame, shard_bytes: int) -> DataFrame:
    """What the radix trees of all stretches of the sorted keys emit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, last, held = RadixTree(), None, None, 0
        for batch in batches:
            for conv, key in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                if held > shard_bytes:
                    yield from _batches(tree, first, last)
                    tree, first, held = RadixTree(), None, 0
                tree.add(key, conv)
                first, last = key if first is None else first, key
                held += len(key) + 64
        if first is not None:
            yield from _batches(tree, first, last)

    dealt = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    return dealt.mapInArrow(run, _FOUND)


def _closed(group: pd.DataFrame) -> pd.DataFrame:
    """Edge nodes under one first turn, sums carried from the deepest up."""
    group = group.sort_values("depth", ascending=False, kind="stable")
    more: dict[bytes, list[int]] = {}
    out = []
    for row in group.itertuples(index=False):
        children, leaves, saved = more.get(row.node, (0, 0, 0))
        children, saved = children + row.n_children, saved + row.saved_tokens
        leaves = leaves + row.n_leaves if children else 1
        saved += (row.n_convs - 1) * row.words
        up = more.setdefault(row.parent, [0, 0, 0])
        for k, value in enumerate((1, leaves, saved)):
            up[k] += value
        out.append((children, leaves, saved))
    group[["n_children", "n_leaves", "saved_tokens"]] = np.array(out, np.int64).reshape(-1, 3)
    return group


def closed_edges(found: DataFrame) -> DataFrame:
    """Edge nodes with the sums of all stretches. Under one first turn there are at most two
    paths for each stretch; the root is put together from the nodes below it."""
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    edges = (
        found.where("kind = 1")
        .groupBy("node")
        .agg(
            F.min("conv_id").alias("conv_id"),
            *[F.min(c).alias(c) for c in ("depth", "parent", "top", "words")],
            *[F.sum(c).alias(c) for c in sums],
        )
    )
    deep = staged(edges.where("depth > 0").groupBy("top").applyInPandas(_closed, edges.schema))
    below = deep.where("depth = 1").select(
        *[F.lit(None).cast(t).alias(c) for c, t in (("node", "binary"), ("conv_id", "long"), ("n_convs", "long"))],
        F.lit(1).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
    )
    top = edges.where("depth = 0").select("node", "conv_id", *sums).unionByName(below)
    one = [F.max(c).alias(c) for c in ("node", "conv_id", "n_convs")]
    root = (
        top.agg(*one, *[F.sum(c).alias(c) for c in sums[1:]])
        .where(F.col("node").isNotNull())
        .select(
            "node",
            "conv_id",
            F.lit(0).cast("long").alias("depth"),
            F.lit(None).cast("binary").alias("parent"),
            "n_convs",
            "n_children",
            F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
            "saved_tokens",
        )
    )
    return root.unionByName(deep.select(root.columns))


def edge_ends(found: DataFrame) -> DataFrame:
    """(node, ends_sha256): runs of ids in ascending order, hashed as a stream for each node."""
    names = ["node", "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=names
            )

        for batch in batches:
            for own, data in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                ids = ",".join(map(str, np.frombuffer(data, np.int64).tolist()))
                if own != node:
                    if node is not None:
                        yield done()
                    node, state = own, hashlib.sha256()
                else:
                    ids = "," + ids
                state.update(ids.encode())
        if node is not None:
            yield done()

    runs = found.where("kind = 2").select("node", "ids", "conv_id")
    dealt = runs.repartition("node").sortWithinPartitions("node", "conv_id").select("node", "ids")
    return dealt.mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, *, shard_bytes: int = 4 << 20) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), by ``NODE_COLUMNS``.

    ``conv_id`` is the smallest member, ``parent_conv_id`` the parent's (NULL for the root),
    ``n_leaves`` the childless nodes of the subtree, ``saved_tokens`` the subtree's sum of
    (members - 1) times the words of the last turn, ``ends_sha256`` the digest of the ids that end
    at the node. Every id stands in one row. Conversations without turns end at the root. An
    empty table gives no rows.
    """
    key = F.unhex(F.array_join("turns", ""))
    found = staged(shards(turns.select("conv_id", key.alias("key")), shard_bytes))
    edges = staged(closed_edges(found))
    names = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    inner = found.where("kind = 0")
    under = inner.where(F.col("parent").isNotNull()).drop("parent_conv_id").join(names, "parent", "left")
    closed = (
        edges.join(names, "parent", "left")
        .join(edge_ends(found), "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
    )
    return (
        inner.where(F.col("parent").isNull())
        .select(*NODE_COLUMNS)
        .unionByName(under.withColumnRenamed("above", "parent_conv_id").select(*NODE_COLUMNS))
        .unionByName(closed.withColumnRenamed("above", "parent_conv_id").select(*NODE_COLUMNS))
    )
