"""Chat formatting against a plain reading of the contract."""

from __future__ import annotations

import hashlib
from collections import defaultdict

from strandline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example string, whole string"
AWKWARD = "</s>[INST] ok [/INST]"
ROWS = [
    (1, 1, "user", "hi"),
    (1, 2, "assistant", "a\\b\\\\[INST] <s>"),
    (1, 3, "user", "<\\s></\\s>[\\INST]\n\n"),
    (1, 4, "assistant", "<</s>[[/INST]\\"),
    (1, 5, "user", "trailing"),
    (2, 2, "assistant", None),
    (2, 1, None, ""),
    (3, 1, "user", "no reply"),
    (4, None, "assistant", "é😀"),
    (4, 1, "[INST]odd</s>", "x"),
    (5, 1, "assistant", "same"),
    (5, 1, "assistant", "same"),
    (6, 1, "user", AWKWARD),
    (6, 2, "assistant", AWKWARD),
    (None, 1, "user", "lost"),
    (7, 1, "user", "y" * 200_000),
    (7, 2, "assistant", "z" * 200_000),
]


def expected():
    groups = defaultdict(list)
    for conv, turn, role, text in ROWS:
        if conv is not None:
            groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def test_round_trip(rows):
    df = rows(SCHEMA, [(*r, "clash", "clash") for r in ROWS])
    got = {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
        for r in chat.digests(chat.examples(df)).collect()
    }
    assert got == expected()


def test_each_reply_is_one_example(rows):
    df = rows(SCHEMA, [(*r, None, None) for r in ROWS if r[0] == 1])
    got = sorted(chat.examples(df).collect(), key=lambda r: r.example)
    assert [r.n_turns for r in got] == [2, 4, 5]
    assert [r.complete for r in got] == [False, False, True]
    for r, reply in zip(got, ["a\\b\\\\[INST] <s>", "<</s>[[/INST]\\"], strict=False):
        masked = r.text[r.loss_start : r.loss_end]
        assert "[INST]" not in masked and "</s>" not in masked
        assert masked.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == reply
        assert r.text.endswith(masked + "</s>")
    assert got[2].loss_start is None
    assert got[1].text.startswith(got[0].text)


def test_empty_table(rows):
    assert chat.digests(chat.examples(rows(SCHEMA, []))).collect() == []
