"""Chat formatting: one example per assistant turn, in SQL functions only.

An example is the conversation up to an assistant turn, of which only that
turn's text is trainable.  A turn is written as

    <|turn|>ROLE<|text|>
    TEXT<|end|>

and a line end.  Inside roles and texts every ``<``, backslashes, ``|`` gets
one backslash more, so that no marker can arise; taking one away reads back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>\n", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def expand(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """``conv_id, target, formatted, loss_start, loss_end``: all examples.

    ``target`` is the zero-based place of the trained turn; places run by turn
    number (nulls first), then role and text, so that repeated turns all stay.
    The loss covers code points ``loss_start`` (inclusive) to ``loss_end``
    (exclusive) of ``formatted``.  Turns after the last reply are context of
    no reply: they end in one further example with an empty loss, so that
    every turn can be read back.  Null roles and texts are empty, a null
    conversation is one conversation, an empty table gives no rows, other
    columns are left out.

    An example holds its whole context, so a conversation must fit in a row;
    conversations share nothing and spread over tasks by their id.
    """
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    pieces = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == target_role).alias("trained"),
        F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    last = F.size("trained") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("trained", i) | (i == last))
    rows = pieces.withColumn("target", F.explode(targets))
    before = F.array_join(F.transform(F.slice(F.arrays_zip("heads", "bodies"), 1, F.col("target")), lambda x: F.concat(x["heads"], x["bodies"], F.lit(END))), "")
    rows = rows.select("conv_id", "target", F.get("trained", F.col("target")).alias("trained"), F.concat(before, F.get("heads", F.col("target"))).alias("context"), F.get("bodies", F.col("target")).alias("body"))
    start = F.length("context")
    return rows.select("conv_id", "target", F.concat("context", "body", F.lit(END)).alias("formatted"), start.alias("loss_start"), F.when(F.col("trained"), start + F.length("body")).otherwise(start).alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of ``role, text``."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x.startswith(TURN))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, TEXT, 1)
        role = F.substring(head, F.lit(len(TURN) + 1), F.length(head))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, F.length(head) + len(TEXT) + 1, F.length(x))).alias("text"))

    return F.transform(parts, turn)


def report(conversations: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its examples."""
    examples = expand(conversations)
    loss = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    read = examples.select("conv_id", "target", "formatted", F.length("formatted").cast("long").alias("size"), unescape(loss).alias("loss"))
    by = read.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("size").alias("formatted_chars"),
    )
    back = by.select("conv_id", read_turns(F.col("whole")).alias("turns"), "loss", "formatted_chars")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
