"""Chat formatting by prefix-target expansion. DataFrame functions only.

Template of a turn: ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>`` and a line
feed. Inside roles and texts, ``\\`` becomes ``\\\\`` and ``<|`` becomes
``<\\|``, so no text can hold a control string, and `unescape` gets it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length) from turns
    (conv_id, turn, role, text).

    One example per assistant turn: all preceding turns are its context, and
    only the reply, ``formatted[loss_start : loss_start + loss_length]`` in code
    points from 0, is trainable. Turns after a conversation's last reply have
    no reply to serve as context for; they come with their whole conversation
    in a last example of loss_length 0, so every turn is in the output. Examples
    of a conversation are numbered from 0.

    Turns are ordered by turn, then role and text (nulls first), so repeated
    rows stay and ties have one order. Null roles and texts are empty; rows
    without conv_id form one conversation. A role other than ``assistant`` is
    context. Other columns are ignored. No rows give no rows.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    shown = turns.select(
        "conv_id", "turn", "role", "text",
        F.length(head).cast("long").alias("lead"),
        F.length(escape(F.col("text"))).cast("long").alias("body"),
        F.concat(head, escape(F.col("text")), F.lit(END + "\n")).alias("shown"),
    )
    # where each turn ends in the text of the conversation
    inner = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = shown.withColumn("end", F.sum(F.col("lead") + F.col("body") + (len(END) + 1)).over(inner))
    whole = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "end", "lead", "body", "shown"))).alias("t"))
    whole = whole.select("conv_id", F.col("t.role").alias("roles"), F.col("t.body").alias("bodies"), F.col("t.end").alias("ends"), F.array_join("t.shown", "").alias("all"))
    n = F.size("roles")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("roles", i) == "assistant")
    last = F.when(F.element_at("roles", -1) != "assistant", F.array(n)).otherwise(F.array().cast("array<int>"))
    targets = whole.select("*", F.posexplode(F.concat(replies, last)).alias("example", "i"))
    reply = F.element_at("roles", F.col("i")) == "assistant"
    end, body = (F.element_at(c, F.col("i")) for c in ("ends", "bodies"))
    return targets.select(
        "conv_id",
        "example",
        F.substring("all", F.lit(1), end.cast("int")).alias("formatted"),
        (end - (len(END) + 1) - body).alias("loss_start"),
        F.when(reply, body).otherwise(F.lit(0).cast("bigint")).alias("loss_length"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    role = lambda p: unescape(F.substring_index(p, SEP, 1))
    text = lambda p: unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold, read back from their text."""
    loss = F.substring("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int"))
    seen = examples.select("conv_id", "example", "formatted", F.length("formatted").cast("long").alias("chars"), unescape(loss).alias("loss"))
    whole = seen.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("last"),
        F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    losses = F.array_join("losses.loss", "")
    return whole.select("conv_id", read_back(F.col("last")).alias("turns"), losses.alias("all_loss"), "formatted_chars").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("all_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("all_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
