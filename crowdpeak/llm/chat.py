"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template. No escaped text holds `<` or `[`, so a mark found in the output is a mark.
OPEN, ROLE_END, CLOSE = "<s>[", "]", "</s>"
#: What stands for the characters that marks are made of; `~` itself first when escaping, last when undoing it.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars, is_last) from rows of (conv_id, turn, role, text).

    One example for each turn of `target_role`: all turns before it as context, then the turn itself; only its text is
    trainable, the `loss_chars` code points from `loss_start` on (from 0, in the escaped text). Turns after the last
    such turn, or all turns when there is none, are in one more example with nothing trainable, so that no turn is
    lost; `example` counts from 0, `is_last` marks the longest example, which holds every turn.

    Turns go by `turn`, null last, then by role and text; repeated rows are turns of their own. A null role or text is
    empty. A null conv_id is a conversation. A conversation must fit in a row, as its longest example does; examples
    of a conversation are made row by row. Other columns are not looked at."""
    turns = conversations.select("conv_id", F.struct(F.col("turn").isNull().alias("z"), F.col("turn").alias("t"),
                                                     F.coalesce("role", F.lit("")).alias("role"),
                                                     F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    head = lambda x: F.concat(F.lit(OPEN), escaped(x["role"]), F.lit(ROLE_END))
    whole = whole.select(
        "conv_id", F.transform("turns", lambda x: F.concat(head(x), escaped(x["text"]), F.lit(CLOSE))).alias("pieces"),
        F.transform("turns", lambda x: F.length(escaped(x["text"]))).alias("lengths"),
        F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == target_role, i)), lambda i: i.isNotNull()).alias("targets"))
    last = F.size("pieces") - 1
    open_end = (F.size("targets") == 0) | (F.element_at("targets", -1) < last)
    ends = F.when(F.size("targets") == 0, F.array(last)).when(open_end, F.concat("targets", F.array(last))).otherwise(F.col("targets"))
    each = (whole.withColumn("n_targets", F.size("targets")).select("conv_id", "pieces", "lengths", "n_targets", F.posexplode(ends).alias("example", "at")))
    formatted = F.array_join(F.slice("pieces", 1, F.col("at") + 1), "")
    length = F.element_at("lengths", F.col("at") + 1)
    trained = F.col("example") < F.col("n_targets")
    return (each.withColumn("is_last", F.col("at") == last).withColumn("formatted", formatted)
            .select("conv_id", "example", "formatted",
                    F.when(trained, F.length("formatted") - len(CLOSE) - length).otherwise(0).alias("loss_start"),
                    F.when(trained, length).otherwise(0).alias("loss_chars"), "is_last"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted example as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: F.length(p) > 0)
    body = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(body, lambda p: F.struct(
        unescaped(F.substring_index(p, ROLE_END, 1)).alias("role"),
        unescaped(F.substring(p, F.instr(p, ROLE_END) + 1, F.length(p))).alias("text")))


def loss_text(example: DataFrame) -> Column:
    """The trainable text of an example, as it was before formatting."""
    return unescaped(F.substring(example["formatted"], example["loss_start"] + 1, example["loss_chars"]))
