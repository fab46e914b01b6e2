"""Chat formatting with a loss mask, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrays import let, sums

#: Marks of the template. Turns of one role in a row share a block and are parted by NEXT.
START, END, NEXT, LINE = "<|im_start|>", "<|im_end|>", "<|im_next|>", "<|nl|>"
TRAINED = "assistant"


def escaped(text: Column) -> Column:
    r"""A backslash more in each `<\...\|`, so that no text holds `<|`, which begins all marks."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss.

    formatted is `<|im_start|>role`, a line end, the texts parted by `<|im_next|>`, `<|im_end|>` and a line end
    for each block of turns in a row with one role; marks in texts and roles are escaped, line ends in roles
    are a mark. loss has (block, first, length) in code points from the block's start for each text of TRAINED.

    Turns are in order of turn, role and text, a null turn first; null roles and texts are empty; a null
    conv_id is a conversation; equal rows are turns each; an empty table gives no rows; other columns are
    ignored. A conversation is one row by its nature, and so is collected whole.
    """
    given = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    rows = given.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    begins = F.filter(F.sequence(F.lit(0), F.size("ts") - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", F.greatest(i - 1, F.lit(0)))["role"]))
    rows = rows.withColumn("begins", begins)
    blocks = F.transform("begins", lambda b, j: F.slice("ts", b + 1, F.coalesce(F.get("begins", j + 1), F.size("ts")) - b))
    rows = rows.select("conv_id", blocks.alias("blocks"))
    head = lambda block: F.concat(F.lit(START), F.replace(escaped(block[0]["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    made = F.transform("blocks", lambda b: F.struct(head(b).alias("head"), (b[0]["role"] == TRAINED).alias("trained"), F.transform(b, lambda t: escaped(t["text"])).alias("texts")))
    rows = rows.select("conv_id", made.alias("made"))
    text = F.array_join(F.transform("made", lambda m: F.concat(m["head"], F.array_join(m["texts"], NEXT), F.lit(END + "\n"))), "")
    upto = lambda m: sums(F.transform(m["texts"], lambda x: (F.length(x) + len(NEXT)).cast("long")))
    span = lambda m, k, x, n: F.struct(k.alias("block"), (F.length(m["head"]) + n - F.length(x) - len(NEXT)).cast("int").alias("first"), F.length(x).alias("length"))
    spans = lambda m, k: let(upto(m), lambda n: F.zip_with(m["texts"], n, lambda x, at: span(m, k, x, at)))
    loss = F.flatten(F.transform("made", lambda m, k: F.when(m["trained"], spans(m, k)).otherwise(F.expr("cast(array() as array<struct<block:int,first:int,length:int>>)"))))
    return rows.select("conv_id", text.alias("formatted"), loss.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from formatted and loss alone."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    rows = chats.select("conv_id", "loss", parts.alias("parts"))  # without START
    plain = F.transform("parts", lambda p: F.struct(unescaped(F.replace(F.substring_index(p, "\n", 1), F.lit(LINE), F.lit("\n"))).alias("role"), F.split(_body(p), r"<\|im_next\|>", -1).alias("texts")))
    turns = F.flatten(F.transform(plain, lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescaped(x).alias("text")))))
    under = F.transform("loss", lambda s: unescaped(F.substring(F.get("parts", s["block"]), s["first"] - len(START) + 1, s["length"])))
    return rows.select("conv_id", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))


def _body(part: Column) -> Column:
    """What stands between a part's first line and its END."""
    first = F.instr(part, "\n")
    return F.substring(part, first + 1, F.length(part) - first - len(END) - 1)
