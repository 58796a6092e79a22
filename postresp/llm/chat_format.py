"""Chat formatting (operator 6), in Spark expressions only.

A conversation's turns are sorted as collected structs, adjacent turns of one
role are merged into one block by array functions, and blocks are concatenated:

    <|role|>\\n  text [ <|+|> text ]*  </s>\\n

Inside texts and roles every string that could be read as a control string
(``<|...|>``, ``</s>``, ``<s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>`` ...) is
broken by a backslash after its first character, and a backslash is doubled;
``unescaped`` reverses that exactly.  Loss is taken on the texts of the
``loss_role`` alone: not on headers, ends or the marks between merged turns.

Defined results: a null text or role is empty; turns with equal numbers are
ordered by role, then text, null turns first; repeated rows are turns of their
own; a null conversation id is a conversation; other columns are ignored; an
empty table gives an empty result.  The one row of a conversation holds all its
text, so its size is that of the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, JOIN = "</s>\n", "<|+|>"
_CONTROL = r"<(?=[|/s<\\])|\|(?=[>\\])|\[(?=/?INST\]|\\)|\\"
_ESCAPED = r"([<|\[\\])\\"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, _CONTROL, r"$0\\")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, "$1")


def format_conversations(turns: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, segments, formatted`` of each conversation.

    ``segments`` is the output cut at the borders of the loss mask: an array of
    ``(text, loss)`` whose texts concatenate to ``formatted``.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    starts = F.filter(F.sequence(F.lit(0), F.size("turns") - 1),
                      lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", F.greatest(i - 1, F.lit(0)))["role"]))
    convs = convs.withColumn("starts", starts)

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        role = F.get("turns", start)["role"]
        own = F.slice("turns", start + 1, stop - start)

        def segment(text: Column, loss) -> Column:
            return F.struct(text.alias("text"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))

        bodies = F.flatten(F.transform(own, lambda t, n: F.array(
            segment(F.when(n == 0, F.lit("")).otherwise(F.lit(JOIN)), False),
            segment(escaped(t["text"]), role == loss_role))))
        return F.concat(F.array(segment(F.concat(F.lit("<|"), escaped(role), F.lit("|>\n")), False)), bodies,
                        F.array(segment(F.lit(END), False)))

    merged = convs.select("conv_id", F.filter(F.flatten(F.transform("starts", block)), lambda s: s["text"] != "").alias("segments"))
    return merged.withColumn("formatted", F.array_join(F.col("segments")["text"], ""))


def parse_formatted(formatted: Column) -> Column:
    """The turns read back from the output: array of ``(role, text)``.

    Escaping leaves no end, header or join mark inside a text, so plain splits
    at the marks are exact."""
    blocks = F.filter(F.split(formatted, "</s>\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescaped(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>\n", 1))
        body = F.regexp_replace(b, r"(?s)^<\|.*?\|>\n", "")
        return F.transform(F.split(body, r"<\|\+\|>", -1), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
