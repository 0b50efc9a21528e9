"""Conversations as one formatted text each, with a loss mask.

Turns of a conversation are sorted as an array of structs, adjacent turns of one role are merged into one
message by array functions, and the messages are joined into a text by Spark expressions only:

    <|open|>role<|text|>first text<|next|>second text of the same role<|close|>

Control strings inside roles and texts are escaped and can be restored exactly: every backslash is doubled,
then a backslash goes after the first character of every control string (``CONTROL``: those of this
template and those of common others). So a control string of the output is always one of the template.

The mask lists segments of the output in order, as their number of characters and whether they count for the
loss: the texts of ``TRAINED`` roles do, marks and other texts do not.

Edge cases: a null role or text is empty. Turns are ordered by turn (null first), then role and text, so repeated
rows come out as repeated turns. Rows without conv_id form one conversation of their own. A conversation is one
row of the result whatever its length; before that its rows are only sorted. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, sha256_hex

OPEN, TEXT, NEXT, CLOSE = "<|open|>", "<|text|>", "<|next|>", "<|close|>"
#: Control strings of this and other templates.
CONTROL = (
    OPEN, TEXT, NEXT, CLOSE,
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
)
TRAINED = ("assistant",)


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    doubled = _swap(text, "\\", "\\\\")
    return reduce(lambda t, c: _swap(t, c, c[0] + "\\" + c[1:]), CONTROL, doubled)


def unescape(text: Column) -> Column:
    whole = reduce(lambda t, c: _swap(t, c[0] + "\\" + c[1:], c), CONTROL, text)
    return _swap(whole, "\\\\", "\\")


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (the text) and mask: segments (n_chars, loss) that make it up."""
    blank = F.lit("")
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce(F.col("role").cast("string"), blank).alias("role"),
            F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        ).alias("x"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def segments(t: Column) -> Column:
        """Per turn: the mark before its text, the text, and the mark after it."""
        def one(x: Column, i: Column) -> Column:
            goes_on = F.coalesce(F.get(t, i - 1)["role"] == x["role"], F.lit(False))
            followed = F.coalesce(F.get(t, i + 1)["role"] == x["role"], F.lit(False))
            return F.array(
                F.struct(
                    F.when(goes_on, F.lit(NEXT)).otherwise(F.concat(F.lit(OPEN), escape(x["role"]), F.lit(TEXT))).alias("text"),
                    F.lit(False).alias("loss"),
                ),
                F.struct(escape(x["text"]).alias("text"), x["role"].isin(*TRAINED).alias("loss")),
                F.struct(F.when(followed, F.lit("")).otherwise(F.lit(CLOSE)).alias("text"), F.lit(False).alias("loss")),
            )

        return F.flatten(F.transform(t, one))

    def joined(parts: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("formatted"),
            F.transform(parts, lambda p: F.struct(F.length(p["text"]).cast("long").alias("n_chars"), p["loss"].alias("loss"))).alias("mask"),
        )

    made = sorted_turns.select("conv_id", bound(bound(F.col("turns"), segments), joined).alias("made"))
    return made.select("conv_id", "made.formatted", "made.mask")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation, restored."""
    def message(m: Column) -> Column:
        def turns(parts: Column) -> Column:
            role = unescape(F.get(parts, F.lit(0)))
            return F.transform(
                F.split(F.get(parts, F.lit(1)), _pattern(NEXT)),
                lambda x: F.struct(role.alias("role"), unescape(x).alias("text")),
            )

        return bound(F.split(m, _pattern(TEXT)), turns)

    messages = F.filter(F.split(F.replace(text, F.lit(CLOSE), F.lit("")), _pattern(OPEN)), lambda x: x != "")
    return F.flatten(F.transform(messages, message))


def _pattern(mark: str) -> str:
    return mark.replace("|", "\\|")


def read_loss(text: Column, mask: Column) -> Column:
    """All text under the mask, restored and joined. Characters are taken in one pass over the text."""
    chars = F.split(text, "")
    cut = F.aggregate(
        mask,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, n: bigint>>").alias("spans")),
        lambda s, m: F.struct(
            (s["at"] + m["n_chars"]).alias("at"),
            F.when(m["loss"], F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), m["n_chars"].alias("n"))))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    one = lambda c, x: F.array_join(F.slice(c, x["start"].cast("int") + 1, x["n"].cast("int")), "")
    return bound(chars, lambda c: F.array_join(F.transform(cut, lambda x: unescape(one(c, x))), ""))


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts consist of control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(
        F.lit(-1).cast(conversations.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(conversations.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(text).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def read_back(formatted_: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, from its text and mask alone."""
    turns = read_turns(F.col("formatted"))
    read = formatted_.select("conv_id", "formatted", turns.alias("turns"), read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(told).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(column: str) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    return text


READ_SQL = f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m as (
  select *, len({_sql_escape('text')}) as n_text, len({_sql_escape('role')}) as n_role,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before
  from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(len(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(n_text + case when role = before then {len(NEXT)} else {len(OPEN + TEXT + CLOSE)} + n_role end)::bigint as formatted_chars
from m group by conv_id
"""
