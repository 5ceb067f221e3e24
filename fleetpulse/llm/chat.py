"""Chat formatting with Spark expressions only.

Turns are sorted within their conversation, adjacent turns of one role become one block, and
blocks are concatenated:

    <s>[INST]user[/INST]text[NEXT]next text of the same role</s>[INST]assistant[/INST]text</s>

A control string inside a text or role gets one more backslash after its first character
(`<s>` becomes `<\\s>`, `<\\s>` becomes `<\\\\s>`), so control strings in the output are always
the template's and every text can be read back exactly.

Defined results: null text and null role are empty; turns sort by (turn, role, text), null
turns first, so ties and repeated rows give one order; null conv_id is one conversation; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings. Each starts with `<` or `[` and has neither of them later on."""

    begin: str = "<s>"
    end: str = "</s>"
    open: str = "[INST]"
    close: str = "[/INST]"
    join: str = "[NEXT]"

    def __post_init__(self):
        for s in self.controls:
            if len(s) < 2 or s[0] not in "<[" or set(s[1:]) & set("<[\\"):
                raise ValueError(f"not a control string: {s!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.end, self.open, self.close, self.join)

    def _tails(self, first: str) -> str:
        return "|".join(re.escape(s[1:]) for s in self.controls if s[0] == first)

    def escaped(self, text: Column) -> Column:
        """One more backslash between first and second character of every control string."""
        for h in "<[":
            if tails := self._tails(h):
                text = F.regexp_replace(text, rf"\{h}(\\*)({tails})", rf"\{h}\\$1$2")
        return text

    def unescaped(self, text: Column) -> Column:
        for h in "<[":
            if tails := self._tails(h):
                text = F.regexp_replace(text, rf"\{h}\\(\\*)({tails})", rf"\{h}$1$2")
        return text


DEFAULT = ChatTemplate()


def format_conversations(turns: DataFrame, template: ChatTemplate = DEFAULT, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans of code points, end exclusive).

    The loss spans are exactly the escaped texts of `learn_role`, in order.
    """
    t = template
    raw_role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select(
        "conv_id",
        "turn",
        t.escaped(raw_role).alias("role"),
        t.escaped(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        (raw_role == learn_role).alias("learn"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("at"),
        (~F.lag("role").over(order).eqNullSafe(F.col("role"))).alias("opens"),
        (~F.lead("role").over(order).eqNullSafe(F.col("role"))).alias("closes"),
    )
    head = F.when(F.col("opens"), F.length("role") + len(t.open) + len(t.close)).otherwise(len(t.join))
    tail = F.when(F.col("closes"), F.lit(len(t.end))).otherwise(0)
    rows = rows.select(
        "*",
        F.sum(F.col("opens").cast("long")).over(so_far).alias("block"),
        (len(t.begin) + F.sum(head + F.length("text") + tail).over(so_far) - tail).alias("end"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(
        F.first("role").alias("role"),
        F.first("learn").alias("learn"),
        F.sort_array(F.collect_list(F.struct("at", "text", "end"))).alias("parts"),
    )
    spans = F.transform("parts", lambda p: F.struct((p.end - F.length(p.text)).alias("start"), p.end.alias("end")))
    blocks = blocks.select(
        "conv_id",
        "block",
        F.concat(F.lit(t.open), "role", F.lit(t.close), F.array_join("parts.text", t.join), F.lit(t.end)).alias("text"),
        F.when(F.col("learn"), spans).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("loss"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "text", "loss"))).alias("blocks"))
    return whole.select(
        "conv_id",
        F.concat(F.lit(t.begin), F.array_join("blocks.text", "")).alias("formatted"),
        F.flatten("blocks.loss").alias("loss"),
    )


def read_back(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped, one per original turn."""
    t = template
    body = F.substring(formatted, F.lit(len(t.begin) + 1), F.length(formatted))
    blocks = F.split(body, _quoted(t.end))
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        sides = F.split(block, _quoted(t.close), 2)
        role = t.unescaped(F.substring(sides[0], F.lit(len(t.open) + 1), F.length(sides[0])))
        return F.transform(
            F.split(sides[1], _quoted(t.join)),
            lambda x: F.struct(role.alias("role"), t.unescaped(x).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, loss: Column, template: ChatTemplate = DEFAULT) -> Column:
    """All text under the loss mask, unescaped."""
    parts = F.transform(
        loss, lambda s: template.unescaped(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))
    )
    return F.array_join(parts, "")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "[]<>/" else c for c in s)
