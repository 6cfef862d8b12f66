"""Operator 3 (native): chat formatting with a grammar round trip.

Grammar of a rendered conversation::

    conversation := turn*
    turn         := "<s>" role "[INST]" text end
    end          := "</s>" for the trained role, "[/INST]" for any other

The loss mask covers the text before each ``</s>``.  The four control strings
must not stand inside a role or text, and a backslash there quotes the character
after it.  A conversation is first rendered as it is; the rendering is parsed
again, and unless exactly the source turns come back, all its roles and texts
are escaped (backslashes doubled, one put into each control string).

Turns go by (turn, role, text), so ties have one order; repeated rows are turns
of their own; a null role or text is empty; a null conv_id is a conversation of
its own; an empty table gives no rows; further columns are ignored.
A conversation is one row in the end (its digest needs all of it), so one
task holds one conversation; equal texts in other conversations don't meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"<(?=/?s>)|\[(?=/?INST\])", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column, trained_role: str, escaped: bool) -> Column:
    put = escape if escaped else (lambda c: c)
    one = lambda t: F.concat(F.lit(BEGIN), put(t["role"]), F.lit(OPEN), put(t["text"]), F.when(t["role"] == trained_role, F.lit(END)).otherwise(F.lit(CLOSE)))
    return F.array_join(F.transform(turns, one), "")


def parse(df: DataFrame, formatted: str, out: str) -> DataFrame:
    """Adds ``out``: the turns of a rendered conversation as
    array<struct<role, text, trained>>, null where it isn't in the grammar.

    The control strings and what stands between them are columns of their own,
    so each is found once and not again for every turn."""
    cut = df.withColumns(
        {
            "_marks": F.regexp_extract_all(F.col(formatted), F.lit(f"({_CONTROL})"), 1),
            "_between": F.split(F.col(formatted), _CONTROL),
        }
    ).withColumn("_n", F.floor(F.size("_marks") / 3).cast("int"))
    cut = cut.withColumn("_steps", F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array().cast("array<int>")))
    mark = lambda i: F.get(F.col("_marks"), i)
    between = lambda i: F.get(F.col("_between"), i)
    turns = F.transform(
        "_steps",
        lambda k: F.struct(unescape(between(3 * k + 1)).alias("role"), unescape(between(3 * k + 2)).alias("text"), (mark(3 * k + 2) == END).alias("trained")),
    )
    in_grammar = (
        (F.size("_marks") == 3 * F.col("_n"))
        & F.forall("_steps", lambda k: (mark(3 * k) == BEGIN) & (mark(3 * k + 1) == OPEN) & mark(3 * k + 2).isin(END, CLOSE) & (between(3 * k) == ""))
        & (F.element_at("_between", -1) == "")
    )
    return cut.withColumn(out, F.when(in_grammar, turns)).drop("_marks", "_between", "_n", "_steps")


def format_chats(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped, parsed (turns read
    back from ``formatted``) and round_trip (they equal the source)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == trained_role).alias("trained")))
    plain = chats.select("conv_id", source.alias("source")).withColumn("plain", render(F.col("source"), trained_role, False))
    same = F.coalesce(F.col("_tried") == F.col("source"), F.lit(False))
    tried = parse(plain, "plain", "_tried").withColumn("same", same)
    chosen = tried.select(
        "conv_id",
        "source",
        F.when(F.col("same"), F.col("plain")).otherwise(render(F.col("source"), trained_role, True)).alias("formatted"),
        (~F.col("same")).alias("escaped"),
    )
    done = parse(chosen, "formatted", "parsed")
    return done.select("conv_id", "formatted", "escaped", "parsed", F.coalesce(F.col("parsed") == F.col("source"), F.lit(False)).alias("round_trip"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digest columns, all derived from what was read back."""
    all_turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("parsed", lambda t: t["trained"]), lambda t: t["text"]), "")
    return chats.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
