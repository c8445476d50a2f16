r"""Chat formatting of typed content parts.

A turn is ``<|turn|>ROLE\nBODY<|end|>\n``. A visitor flattens a turn's parts in
order: text as it is, any other part as the placeholder ``<|TYPE:N|>``, N
counting a conversation's attachments from 0; each attachment's reference and
expanded token count are recorded. In roles and texts ``\`` becomes ``\\`` and
``<|`` becomes ``<\|`` (a role's line feed ``\n``), so no text can hold a
control string, and :func:`parse_formatted` undoes it. All of it is DataFrame
functions; offsets come from a running sum over a conversation's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import read_table

TURN, END = "<|turn|>", "<|end|>\n"
#: Expanded tokens: an image's by patches of so many pixels a side, audio's a second, a document's a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?s)((?:^|[^\\])(?:\\\\)*)\\n", "$1\n"))


def text_part(text: Column) -> Column:
    """A turn of one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in none.items())))


def _expanded(p: Column) -> Column:
    image = F.ceil(F.coalesce(p["width"], F.lit(PATCH)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(PATCH)) / PATCH)
    return (
        F.when(p["type"] == "image", image)
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row a conversation of ``turns`` (conv_id, turn, role, parts).

    Returns (conv_id, formatted, n_turns, loss, attachments, n_expanded).
    ``loss`` lists (start, chars) in code points of the bodies that are trained
    on, ``attachments`` (n, turn, type, ref, tokens). Turns are in the order of
    turn, role and body; rows that repeat are turns each. Null roles, texts and
    parts count as empty, a null part type as text; turns of a null conv_id are
    one conversation. A conversation is one string, so it lies in one task.
    """
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    parts = F.coalesce("parts", F.array().cast(PARTS))
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    key = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))), "\n")
    plain = plain.withColumn("key", key).withColumn("files", F.filter("parts", lambda p: kind(p) != "text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = plain.withColumn("n0", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
    at = F.transform("parts", lambda p, i: F.size(F.filter(F.slice(F.col("parts"), F.lit(1), i), lambda q: kind(q) != "text")))
    body = F.array_join(
        F.transform(F.arrays_zip(F.col("parts").alias("part"), at.alias("at")), lambda z: F.when(kind(z["part"]) == "text", escape(F.coalesce(z["part"]["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), z["part"]["type"], F.lit(":"), (F.col("n0") + z["at"]).cast("string"), F.lit("|>")))),
        "",
    )
    seen = seen.withColumn("body", body).withColumn("head", F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit("\n")))
    seen = seen.withColumn("chars", F.length("head") + F.length("body") + len(END))
    placed = seen.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    files = F.transform("files", lambda p, i: F.struct((F.col("n0") + i).alias("n"), F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens")))
    row = F.struct("start", F.concat("head", "body", F.lit(END)).alias("piece"), (F.col("role") == trained_role).alias("trained"), (F.col("start") + F.length("head")).alias("from"), F.length("body").alias("chars"), files.alias("files"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    loss = F.transform(F.filter("t", lambda x: x["trained"]), lambda x: F.struct(x["from"].alias("start"), x["chars"].alias("chars")))
    attachments = F.flatten(F.transform("t", lambda x: x["files"]))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.size("t").cast("long").alias("n_turns"),
        loss.alias("loss"),
        attachments.alias("attachments"),
    ).withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def parse_formatted(formatted: Column) -> Column:
    """Array of (role, text) back from a formatted conversation; placeholders stay in the text."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    shape = r"(?s)^<\|turn\|>([^\n]*)\n(.*)$"
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(_unescape_role(F.regexp_extract(p, shape, 1)).alias("role"), unescape(F.regexp_extract(p, shape, 2)).alias("text")))


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, read back from the formatted strings."""
    nasty = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", nasty), (-7, 1, "assistant", nasty)], "conv_id long, turn int, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text").unionByName(extra)
    done = format_conversations(rows.withColumn("parts", text_part(F.coalesce("text", F.lit("")))))
    turns = parse_formatted(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["chars"]))), "")
    return done.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_TEMPLATE = "12 + length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))"
OP4_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok')
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum({_TEMPLATE} + {len(TURN) + 1 + len(END) - 12})::bigint as formatted_chars
from c group by conv_id
"""
