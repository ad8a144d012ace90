"""The trie against a plain dictionary of prefixes, and the radix tree's layouts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import check
import pytest

from strandline.llm import prefix_trie as pt
from strandline.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, node string, parent string, key int"


def words(text):
    return len([w for w in re.split(r"[\x20\x09-\x0D]+", text) if w])


def brute(rows, shared=True):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            ident = hashlib.sha256(f"{len(said[0])}:{said[0]}{said[1]}".encode()).hexdigest()[:32]
            turns[conv].append(((turn is not None, turn or 0, ident), said))
    own = {c: [s for _, s in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:] if shared else t
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
            if d:
                children[tuple(t[: d - 1])].add(tuple(t[:d]))
        ends[tuple(t)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        own_saved = (len(members[node]) - 1) * words(node[-1][1]) if node else 0
        saved[node] = own_saved + sum(saved[x] for x in below)
    return sorted(
        (
            (
                min(m),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(m),
                len(children[node]),
                leaves[node],
                saved[node],
                hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
            )
            for node, m in members.items()
        ),
        key=repr,
    )


def got(df, shared=True, **options):
    turns = pt.turn_ids(df)
    found = pt.prefix_trie(pt.with_shared_starts(turns) if shared else turns, **options)
    assert tuple(found.columns) == pt.NODE_COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def table(rows, data, parts=3):
    return rows(SCHEMA, [(*r, "n", "p", 1) for r in data], parts)


def random_rows(seed, convs=120):
    rng = random.Random(seed)
    said = ["", "hi", "hi there", " a  b\n c ", "é 漢字", "x" * 300]
    out = []
    for c in range(convs):
        conv = rng.choice([c, c * 7, -c])
        for turn in range(rng.choice([1, 2, 3, 3, 4, 8])):
            out.append((conv, turn, rng.choice(["user", "user", "assistant", None]), rng.choice([None, *said])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(rows, seed):
    data = random_rows(seed)
    df = table(rows, data)
    assert got(df) == brute(data)
    assert got(df, shard_bytes=300) == brute(data)  # many stretches, so many edge nodes


def test_hot_first_turn_and_conversation(rows):
    data = [(c, t, "user", f"turn {t}") for c in range(150) for t in range(3)]
    data += [(c, t, "user", f"turn {t * (c % 9)}") for c in range(200, 320) for t in range(c % 5)]
    want = brute(data, shared=False)
    assert got(table(rows, data), shared=False, shard_bytes=500) == want
    assert got(table(rows, data), shared=False) == want


def test_nested_and_long_conversations(rows):
    data = [(c, t, "user", f"{t} word") for c in range(40) for t in range(c)]
    data += [(900, t, "user", f"long {t}") for t in range(700)]
    assert got(table(rows, data), shared=False, shard_bytes=2000) == brute(data, shared=False)


def test_nulls_ties_and_repeats(rows):
    data = [
        (None, 0, "user", "none"), (1, None, None, None), (1, None, None, None), (1, 0, "a", "bc"),
        (1, 0, "ab", "c"), (2, 1, "user", "only second"), (40, 0, "user", "x"), (41, 0, "user", "y"),
    ]
    for shared in (True, False):
        assert got(table(rows, data), shared) == brute(data, shared)


def test_turnless_root(rows):
    lone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 1][:2]
    data = [(c, 0, "user", "gone") for c in lone]
    found = got(table(rows, data))
    assert found == brute(data) and len(found) == 1


def test_given_conversations(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    data = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == brute(data)


def test_layouts_grow():
    node = pt.Node(b"")
    for n, kind in ((4, pt.Sorted), (16, pt.Sorted), (48, pt.Indexed), (256, pt.Direct)):
        for byte in range(n):
            node.put(pt.Node(bytes([byte])))
        assert isinstance(node.layout, kind) and node.layout.most == n
        assert [b for b, _ in node.layout.items()] == list(range(n))
        assert node.layout.get(n - 1).path == bytes([n - 1])
        assert node.layout.get(255) is None or n == 256


def test_paths_are_compressed():
    tree = pt.RadixTree()
    one, other = bytes(range(60)), bytes(range(30)) + bytes(30)
    tree.add(one, 1)
    tree.add(other, 2)
    tree.add(one[:20], 3)
    (top,) = [n for _, n in tree.root.layout.items()]
    assert top.path == one[:20] and list(top.ends) == [3]
    (fork,) = [n for _, n in top.layout.items()]
    assert fork.path == one[20:30] and [n.path for _, n in fork.layout.items()] == [other[30:], one[30:]]


def test_empty_table(rows):
    assert got(table(rows, [])) == []


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query_matches_sql(spark, small, size):
    sf = small.replace("0.001", size)
    con = check.connect(sf)
    got = sorted((tuple(r) for r in QUERIES["op13_prefix_trie"](spark, sf).collect()), key=repr)
    want = con.execute(SQL["op13_prefix_trie"]).fetchall()
    assert got == sorted(want, key=repr)
