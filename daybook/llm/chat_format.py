"""Chat formatting of typed content parts with DataFrame functions only.

A turn is an ordered array of parts ``struct<type, text, ref, tokens>``. A
visitor per part type renders it: text is escaped; image, audio and document
parts become placeholders numbered through the conversation, whose reference
and expanded token count are recorded. The template is

    <|turn|>ROLE\\nBODY<|end|>

Escaping makes control strings in texts inert and can be undone: ``%`` becomes
``%25`` and the first sign of every control string its percent code, so no
marker can come out of a text (``%0A`` does the same for a line end in a role).

Defined results: a null text is empty, a null role the empty role, a null or
empty array of parts an empty body; a part of an unknown type is rendered as
text. Turns are ordered by (turn, role, text, parts), so ties and repeated rows have
one order, and repeated rows are turns of their own. A null conversation id is
a conversation of its own. A conversation is one row of the result, as its
digest asks for, so its turns do meet in one task; only rendered turns travel,
once, by the conversation id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Strings that act as control strings in common templates.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, END = "<|turn|>", "<|end|>"
ATTACHMENTS = ("image", "audio", "document")
PART = "struct<type:string,text:string,ref:string,tokens:int>"
_CODES = {"<": "%3C", "[": "%5B"}


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("%"), F.lit("%25"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(_CODES[c[0]] + c[1:]))
    return out


def unescape(text: Column) -> Column:
    out = text
    for sign, code in (*_CODES.items(), ("\n", "%0A"), ("%", "%25")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


def _role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("%0A"))


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*ATTACHMENTS), F.lit(False))


def render_part(part: Column, number: Column) -> Column:
    """The visitor: one branch per part type."""
    return F.when(_is_attachment(part), F.concat(F.lit("<|"), part["type"], F.lit(":"), number.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def text_part(text: Column) -> Column:
    """An array of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def format_conversations(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """``turns``: conv_id, turn, role, parts. One row per conversation:
    formatted, loss_turns (per turn), loss_spans (start from 0 and length in
    code points of ``formatted``), attachments (number, type, ref, tokens),
    expanded_tokens."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    flat = turns.select("conv_id", "turn", F.col("role").alias("raw_role"), _role(F.col("role")).alias("role"), parts.alias("parts"))
    flat = flat.withColumn("files", F.size(F.filter("parts", _is_attachment)))
    said = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    order = [F.col("turn"), F.coalesce("raw_role", F.lit("")), said, F.to_json("parts")]
    so_far = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("base", F.coalesce(F.sum("files").over(so_far), F.lit(0)))

    def number(i: Column) -> Column:
        return F.col("base") + F.size(F.filter(F.slice("parts", F.lit(1), i), _is_attachment))

    bodies = F.transform("parts", lambda p, i: render_part(p, number(i)))
    files = F.filter(F.transform("parts", lambda p, i: F.when(_is_attachment(p), F.struct(number(i).cast("int").alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))), lambda x: x.isNotNull())
    flat = flat.withColumn("body", F.array_join(bodies, ""))
    flat = flat.withColumn("head", F.concat(F.lit(TURN), "role", F.lit("\n")))
    flat = flat.withColumn("whole", F.concat("head", "body", F.lit(END)))
    flat = flat.withColumn("at", F.coalesce(F.sum(F.length("whole").cast("long")).over(so_far), F.lit(0)))
    flat = flat.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    loss = F.coalesce(F.col("raw_role") == loss_role, F.lit(False))
    turn = F.struct("place", "whole", loss.alias("loss"), (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("n"), files.alias("files"))
    out = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: x["files"]))
    return out.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["whole"]), "").alias("formatted"),
        F.transform("t", lambda x: x["loss"]).alias("loss_turns"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"))).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["tokens"], F.lit(0))).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``: array of (role, text, loss) parsed from ``formatted``
    and the loss mask; placeholders stay in the text as they are."""
    pieces = F.slice(F.split("formatted", "<\\|turn\\|>", -1), F.lit(2), F.size(F.split("formatted", "<\\|turn\\|>", -1)))
    line = lambda p: F.instr(p, "\n")

    def parsed(p: Column, i: Column) -> Column:
        role = unescape(F.substring(p, F.lit(1), line(p) - 1))
        text = unescape(F.substring(p, line(p) + 1, F.length(p) - line(p) - len(END)))
        return F.struct(role.alias("role"), text.alias("text"), F.get("loss_turns", i).alias("loss"))

    return formatted.withColumn("pieces", pieces).withColumn("turns", F.transform("pieces", parsed)).drop("pieces")


def digests(conversations: DataFrame) -> DataFrame:
    """Format conversations of (conv_id, turn, role, text) and describe what is read back."""
    turns = conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    back = read_back(format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts hold control strings."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
