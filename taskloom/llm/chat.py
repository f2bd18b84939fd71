"""Chat formatting with typed content parts.

A turn is a list of parts, struct<type, text, ref, amount>. A visitor turns each
part into text: a text part into its escaped text, an image, audio or document
part into a placeholder, and records the attachment (its place, reference and
the tokens that its placeholder stands for) on the way.

Template: ``<s>[ROLE]role[/ROLE]content</s>``, turn after turn. Inside texts and
roles a backslash is doubled, and a backslash goes in after the first character
of each control string and before a text that follows another part; unescaping
drops a backslash and keeps what follows it.
Other texts stay as they are. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,amount:double>"
PLACEHOLDER = {"image": "<image>", "audio": "<audio>", "document": "<document>"}
CONTROL = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", *PLACEHOLDER.values()]
#: Tokens a placeholder stands for: (fixed, for each unit of ``amount``): pixels of an image in patches of 14 x 14, seconds of audio, pages of a document.
TOKENS = {"image": (2.0, 1 / 196), "audio": (2.0, 25.0), "document": (2.0, 600.0)}
TURN = r"(?s)<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as one part; null is an empty text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def _visit(part: Column, place: Column) -> Column:
    """What a part shows. A text behind another part starts with a backslash, so no control string stands across the border."""
    shown = escape(F.coalesce(part["text"], F.lit("")))
    shown = F.when((place > 0) & (shown != "") & ~shown.startswith("\\"), F.concat(F.lit("\\"), shown)).otherwise(shown)
    for kind, mark in PLACEHOLDER.items():
        shown = F.when(part["type"] == kind, F.lit(mark)).otherwise(shown)
    return shown


def _tokens(part: Column) -> Column:
    amount = F.coalesce(part["amount"], F.lit(0.0))
    out = F.lit(None).cast("long")
    for kind, (fixed, each) in TOKENS.items():
        out = F.when(part["type"] == kind, F.ceil(F.lit(fixed) + F.lit(each) * amount)).otherwise(out)
    return out


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learned: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans, attachments, n_tokens_attached.

    Turns are ordered by turn (null first), then role and content, so ties and
    repeated rows, which all stay, have one order. A null role is an empty role,
    null parts are no parts; a part of unknown or null type counts as text. A
    null conv is one conversation. loss_spans lists (from, to) in code points of
    ``formatted`` for the contents of ``learned`` turns; attachments lists (turn
    number, part number, type, ref, tokens) in order. One conversation is one
    string and so one row; its turns are formatted before they are gathered. An
    empty table gives no rows.
    """
    each = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"))
    each = each.select(
        "conv", "turn", "role",
        F.concat(F.lit("<s>[ROLE]"), escape(F.col("role")), F.lit("[/ROLE]")).alias("head"),
        F.array_join(F.transform("parts", _visit), "").alias("content"),
        F.filter(F.transform("parts", lambda p, i: F.struct(i.cast("int").alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda a: a["tokens"].isNotNull()).alias("found"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    length = F.char_length("head") + F.char_length("content") + F.lit(len("</s>"))
    each = each.withColumn("n", F.row_number().over(order)).withColumn("at", F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - length + F.char_length("head"))
    span = F.when(F.col("role") == learned, F.struct(F.col("at").alias("from"), (F.col("at") + F.char_length("content")).alias("to")))
    gathered = each.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("n", F.concat("head", "content", F.lit("</s>")).alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
        F.array_sort(F.collect_list(F.struct("n", "found"))).alias("found"),
    )
    attachments = F.flatten(F.transform("found", lambda t: F.transform(t["found"], lambda a: F.struct(t["n"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return gathered.select(
        F.col("conv").alias(conv), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans", attachments.alias("attachments")
    ).withColumn("n_tokens_attached", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>, unescaped."""
    roles, texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), "")
