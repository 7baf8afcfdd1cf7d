"""Conversations as training text, with column expressions only.

Turns are collected as structs and sorted, adjacent turns of one role become one block, and blocks are joined with marks:

    <s>[ROLE]user[TEXT]first message[NEXT]second message</s><s>[ROLE]assistant[TEXT]...</s>

Control strings inside roles and messages get a backslash after their first character, and one more where backslashes are
already there, so `unescape` gives back the exact text. A control string starts with `<` or `[` and has neither inside, so
occurrences never overlap, and no mark can arise where a message meets a mark.

Loss mask: run lengths over the formatted text, one run of marks before every message and one for the message itself;
assistant messages carry loss.

Edge cases: null text or role counts as empty; null turn sorts first; equal turns are ordered by role and text; repeated rows
are kept; null conv_id is one conversation of its own; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, ROLE, TEXT, NEXT, END = "<s>", "[ROLE]", "[TEXT]", "[NEXT]", "</s>"
#: Control strings of this and of other common templates.
CONTROL = r"(s>|/s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|SYS>>|/SYS>>)"
BRACKETS = r"(ROLE\]|TEXT\]|NEXT\]|INST\]|/INST\])"


def escape(text):
    text = F.regexp_replace(text, r"<(\\*)" + CONTROL, r"<$1\\$2")
    return F.regexp_replace(text, r"\[(\\*)" + BRACKETS, r"[$1\\$2")


def unescape(text):
    text = F.regexp_replace(text, r"<(\\*)\\" + CONTROL, r"<$1$2")
    return F.regexp_replace(text, r"\[(\\*)\\" + BRACKETS, r"[$1$2")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask) of rows (conv_id, turn, role, text); mask is an array of (chars, loss) runs."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct(F.col("turn"), escape(empty("role")).alias("role"), escape(empty("text")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    position = F.sequence(F.lit(1), F.size("t"))
    first = F.filter(position, lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", i - 2)["role"]))
    starts = sorted_turns.withColumn("first", first)
    stop = lambda k: F.coalesce(F.get("first", k + 1), F.size("t") + 1)
    blocks = F.transform("first", lambda i, k: F.struct(
        F.get("t", i - 1)["role"].alias("role"), F.transform(F.slice("t", i, stop(k) - i), lambda x: x["text"]).alias("texts")))
    joined = starts.select("conv_id", blocks.alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(START + ROLE), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    run = lambda n, loss: F.struct(n.cast("int").alias("chars"), loss.alias("loss"))
    head = lambda b: F.length(b["role"]) + len(START + ROLE + TEXT)
    runs = F.flatten(F.transform("blocks", lambda b, k: F.flatten(F.transform(b["texts"], lambda x, i: F.array(
        run(F.when(i > 0, F.lit(len(NEXT))).otherwise(head(b) + F.when(k > 0, len(END)).otherwise(0)), F.lit(False)),
        run(F.length(x), b["role"] == loss_role))))))
    return joined.select("conv_id", text.alias("formatted"), runs.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trained texts as the formatted text and its mask tell them: adds `turns` (role, text) and `trained`.

    The runs of the mask must end where the marks and messages of the formatted text end, so that the text under a run is the message
    in its place; a mask that points elsewhere is an error. (Cutting at running sums would walk a long conversation once a message.)
    """
    parts = F.slice(F.split("formatted", r"<s>\[ROLE\]"), 2, F.lit(1 << 30))
    block = lambda p: F.split(F.regexp_replace(p, "</s>$", ""), r"\[TEXT\]", 2)
    cut = F.transform(parts, lambda p: block(p))
    blocks = F.transform(cut, lambda b, k: F.struct(unescape(b[0]).alias("role"), F.split(b[1], r"\[NEXT\]", -1).alias("texts"),
                                                    (F.length(b[0]) + len(START + ROLE + TEXT) + F.when(k > 0, len(END)).otherwise(0)).alias("head")))  # once a block, not once a message
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda x, i: F.struct(
        b["role"].alias("role"), unescape(x).alias("text"), F.length(x).alias("chars"), F.when(i > 0, len(NEXT)).otherwise(b["head"]).alias("marks")))))
    runs = formatted.withColumn("turns", turns)
    # the run after each run of marks belongs to the message in the same place
    placed = F.transform("turns", lambda t, i: F.struct(t["text"].alias("text"), F.get("mask", 2 * i + 1)["loss"].alias("loss"), (
        (F.get("mask", 2 * i)["chars"] == t["marks"]) & (F.get("mask", 2 * i + 1)["chars"] == t["chars"]) & ~F.get("mask", 2 * i)["loss"]).alias("fits")))
    runs = runs.withColumn("placed", placed)
    fits = (F.size("mask") == 2 * F.size("turns")) & F.forall("placed", lambda x: x["fits"])
    trained = F.array_join(F.transform(F.filter("placed", lambda x: x["loss"]), lambda x: x["text"]), "")
    wrong = F.raise_error(F.lit("a loss mask doesn't fit its formatted text")).cast("string")
    return runs.withColumn("trained", F.when(F.coalesce(fits, F.lit(False)), trained).otherwise(wrong)).drop("placed")
