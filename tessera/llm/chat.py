"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, and its own text, as formatted, the
only part under the loss mask. What follows a conversation's last assistant turn becomes one example more,
without a target, so that every turn is in the output; a conversation's last example has all its turns.

A turn is ``<s>``, the role (URL-encoded), a new line, the text, ``</s>``. In texts, a control string (``<s>``,
``</s>``, ``[INST]``, ``[/INST]``) gets a backslash after its first character, and one that has some there
already gets one more; taking one away from each restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name

OPEN, CLOSE = "<s>", "</s>"
_ESCAPE = r"([<\[])(\\*/?(?:s>|INST\]))"
_UNESCAPE = r"([<\[])\\(\\*/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def chat_examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: ``conv_col, example`` (from 0), ``formatted, loss_start, loss_end, last``.

    Turns are ordered by ``turn_col`` (nulls first), equal ones by role and text; repeated rows stay as
    turns. Null texts and roles are empty; a null conversation id is a conversation. The loss span is in
    code points of ``formatted``, null in an example without a target; ``last`` marks the conversation's
    last example. Other columns are ignored; no turns give no examples. Rows are formed one at a time, but
    an example holds its whole context, so a conversation's output grows with the square of its turns.
    """
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = turns.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").alias("t"), role.alias("r"), text.alias("x"))
    head = F.concat(F.lit(OPEN), F.url_encode("r"), F.lit("\n"))
    pieces = named.select("c", "t", "r", "x", head.alias("head"), escape(F.col("x")).alias("body"))
    pieces = pieces.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("c").orderBy("t", "r", "x")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.select(
        "c", "r", "piece", F.row_number().over(order).alias("n"), F.sum(F.char_length("piece").cast("long")).over(upto).alias("end"),
        F.char_length("body").alias("body"),
    )
    stop = F.col("end") - len(CLOSE)
    target = F.struct(
        "n", F.col("end").alias("length"), (stop - F.col("body")).alias("loss_start"), stop.alias("loss_end"), (F.col("r") == "assistant").alias("is_target")
    )
    whole = placed.groupBy("c").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "").alias("whole"),
        F.sort_array(F.collect_list(target)).alias("turns"),
    )
    count = F.size("turns")
    wanted = F.filter("turns", lambda x: x["is_target"] | (x["n"] == F.size("turns")))
    each = whole.select("c", "whole", count.alias("of"), F.posexplode(wanted).alias("example", "e"))
    own = F.col("e.is_target")
    return each.select(
        F.col("c").alias(conv_col), "example", F.expr("substring(whole, 1, int(e.length))").alias("formatted"),
        F.when(own, F.col("e.loss_start")).alias("loss_start"), F.when(own, F.col("e.loss_end")).alias("loss_end"),
        (F.col("e.n") == F.col("of")).alias("last"),
    )


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation, from its examples alone.

    ``n_turns`` and ``turns_sha256`` come from the turns of the last example, ``loss_chars`` and
    ``loss_sha256`` from the unescaped text under all loss masks in order, ``formatted_chars`` is the length
    of all examples.
    """
    parts = F.slice(F.split("formatted", CLOSE), 1, F.size(F.split("formatted", CLOSE)) - 1)
    turn = lambda p: F.concat(
        F.url_decode(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)), F.lit("\n"),
        unescape(F.substr(p, F.locate("\n", p) + 1)), F.lit("\n"),
    )
    masked = unescape(F.expr("substring(formatted, int(loss_start) + 1, int(loss_end - loss_start))"))
    name = free_name(examples, "conv")
    slim = examples.select(
        F.col(f"`{conv_col}`").alias(name), "example", F.char_length("formatted").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), masked).alias("loss"),
        F.when(F.col("last"), F.size(parts).cast("long")).alias("n"),
        F.when(F.col("last"), F.sha2(F.array_join(F.transform(parts, turn), ""), 256)).alias("sha"),
    )
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))), lambda x: x["loss"]), "")
    made = slim.groupBy(name).agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), told.alias("told"), F.sum("chars").alias("formatted_chars"))
    return made.select(
        F.col(name).alias(conv_col), "n_turns", "turns_sha256", F.char_length("told").cast("long").alias("loss_chars"), F.sha2("told", 256).alias("loss_sha256"), "formatted_chars"
    )
