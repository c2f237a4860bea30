"""Chat logs to training strings: event-sourced reconstruction with DataFrame functions only.

A log holds events (``conv_id``, ``turn``, ``seq``, ``kind``, ``role``, ``text``).  The events of a turn
are folded in order of ``seq``: "message" opens a message, "delta" appends to it, "edit" replaces its
text, "regenerate" starts its text anew, "delete" removes it unless something follows.  The folded
messages of a conversation are rendered in order of turn.

The template of a message is ``<s>[role]text</s>`` and a line feed.  In roles and texts ``&``, ``<``, ``[``
and ``]`` are written as ``&amp;``, ``&lt;``, ``&lb;`` and ``&rb;``, so no control string can occur inside
them and reading back is exact.  ``mask`` gives each turn's place in the string and the code points
of it that the loss covers: the escaped text of assistant messages.

Null texts and roles are empty; events without a kind are messages; ties of ``seq`` are ordered by
kind, role and text; repeated rows stay repeated messages.  A conversation id of null is a conversation.
Deltas are folded by turn before turns meet in their conversation, so a long conversation's events
are spread over its turns.  A conversation is one output row by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), ("]", "&rb;"))
HEAD, MIDDLE, TAIL = "<s>[", "]", "</s>\n"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescaped(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold_events(log: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``k``, ``role``, ``text``: the final messages; k counts those of one turn."""
    kind = F.coalesce("kind", F.lit("message"))
    event = F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = log.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("e"))
    opened = "filter(sequence(1, size(e)), i -> i = 1 or e[i - 1].kind = 'message')"
    parts = "transform(opened, (p, k) -> slice(e, p, coalesce(get(opened, k + 1), size(e) + 1) - p))"
    anew = "array_max(transform(s, (x, j) -> if(x.kind in ('message', 'edit', 'regenerate'), j + 1, 1)))"
    message = f"""transform(filter({parts}, s -> s[size(s) - 1].kind <> 'delete'), s -> struct(
        s[0].role as role,
        array_join(transform(filter(slice(s, {anew}, size(s)), x -> x.kind <> 'delete'), x -> x.text), '') as text))"""
    folded = turns.withColumn("opened", F.expr(opened)).select("conv_id", "turn", F.posexplode(F.expr(message)).alias("k", "m"))
    return folded.select("conv_id", "turn", "k", "m.role", "m.text")


def render(messages: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    """``conv_id``, ``formatted`` and ``mask``: for each turn its start, and start and end of its loss."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    piece = F.concat(F.lit(HEAD), role, F.lit(MIDDLE), text, F.lit(TAIL))
    shaped = messages.select("conv_id", "turn", "k", piece.alias("piece"), F.length(text).alias("n"), (F.col("role") == loss_role).alias("loss"))
    order = Window.partitionBy("conv_id").orderBy("turn", "k")
    ahead = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shaped.withColumn("at", ahead).withColumn("end", F.col("at") + F.length("piece") - len(TAIL))
    start = F.when(F.col("loss"), F.col("end") - F.col("n")).otherwise(F.col("end"))
    turn = F.struct("turn", "k", "piece", F.struct("at", start.alias("start"), "end").alias("mask"))
    return (
        placed.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("t"))
        .select("conv_id", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"), F.transform("t", lambda t: t["mask"]).alias("mask"))
    )


def format_chats(log: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    return render(fold_events(log), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted``, ``turns`` (role and text) and ``loss_text``, from the strings and masks alone."""
    pieces = F.slice(F.split("formatted", TAIL), 1, F.greatest(F.size(F.split("formatted", TAIL)) - 1, F.lit(0)))
    cut = lambda p: F.length(F.substring_index(p, MIDDLE, 1))
    turn = lambda p: F.struct(unescaped(p.substr(F.lit(len(HEAD) + 1), cut(p) - len(HEAD))).alias("role"), unescaped(p.substr(cut(p) + 2, F.length(p))).alias("text"))
    loss = lambda p, m: unescaped(p.substr((m["start"] - m["at"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))
    return formatted.withColumn("p", pieces).select("conv_id", "formatted", F.transform("p", turn).alias("turns"), F.array_join(F.zip_with("p", "mask", loss), "").alias("loss_text"))
