"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only
that reply is trainable. Turns after the last reply, and conversations without one, come as an
example without a target, so that the output holds every turn.

A turn is ``<s>[INST]role[/INST]text</s>``. In roles and texts a backslash is doubled and one
is put into every control string after its first character, so control strings in the output
are always the template's own, and ``unescape`` gives back what was escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"<(?=/?s>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(
    conversations: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """One row per example: conv_id, example, n_turns, text, loss_start, loss_end, complete.

    ``loss_start`` and ``loss_end`` are code points of ``text`` (end exclusive), NULL without a
    target. ``complete`` marks the example that holds all turns. Turns are ordered by turn, then
    role and text; a NULL turn comes first, repeated rows stay. A NULL role or text counts as
    empty. Rows without a conversation id belong to none and give no example. Other columns
    are not read.
    """
    role = F.coalesce(F.col(role_col), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    turns = (
        conversations.where(F.col(conv_col).isNotNull())
        .select(F.col(conv_col).alias("conv_id"), turn.alias("turn"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    )
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MIDDLE))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: head(t)).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
        F.transform("turns", lambda t: t["role"] == target_role).alias("replies"),
    )
    ends = F.filter(
        F.transform(
            "replies",
            lambda reply, i: F.when(
                reply | (i == F.size("replies") - 1), F.struct(i.alias("at"), reply.alias("reply"))
            ),
        ),
        lambda x: x.isNotNull(),
    )
    at = F.col("end.at")
    before = F.array_join(
        F.transform(
            F.arrays_zip(F.slice("heads", 1, at), F.slice("bodies", 1, at)),
            lambda x: F.concat(x["0"], x["1"], F.lit(CLOSE)),
        ),
        "",
    )
    return (
        parts.select("*", F.posexplode(ends).alias("example", "end"))
        .select(
            "conv_id",
            "example",
            "end",
            (at == F.size("replies") - 1).alias("complete"),
            F.concat(before, F.get("heads", at)).alias("context"),
            F.get("bodies", at).alias("body"),
        )
        .select(
            "conv_id",
            "example",
            (at + 1).alias("n_turns"),
            F.concat("context", "body", F.lit(CLOSE)).alias("text"),
            F.when(F.col("end.reply"), F.length("context")).alias("loss_start"),
            F.when(F.col("end.reply"), F.length("context") + F.length("body")).alias("loss_end"),
            "complete",
        )
    )


def loss_text(text: str = "text", start: str = "loss_start", end: str = "loss_end") -> Column:
    """The unescaped text under an example's loss mask; NULL without one."""
    return unescape(F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)))


def parsed_turns(text: Column) -> Column:
    """The turns of a formatted text, read back: an array of (role, text)."""
    marked = F.filter(F.split(text, CLOSE), lambda x: x != "")
    halves = F.transform(
        marked, lambda x: F.split(F.substring(x, len(OPEN) + 1, 2**31 - 1), r"\[/INST\]", 2)
    )
    return F.transform(
        halves,
        lambda x: F.struct(
            unescape(F.get(x, 0)).alias("role"), unescape(F.get(x, 1)).alias("text")
        ),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars (code points of all its examples)."""
    target = F.struct("example", loss_text().alias("reply"))
    per_conversation = formatted.groupBy("conv_id").agg(
        F.sum(F.length("text")).alias("formatted_chars"),
        F.get(F.collect_list(F.when(F.col("complete"), F.col("text"))), 0).alias("whole"),
        F.array_sort(
            F.collect_list(F.when(F.col("loss_start").isNotNull(), target))
        ).alias("targets"),
    )
    said = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return per_conversation.select(
        "conv_id",
        "formatted_chars",
        parsed_turns(F.col("whole")).alias("turns"),
        F.array_join(F.transform("targets", lambda t: t["reply"]), "").alias("loss"),
    ).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", said), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
