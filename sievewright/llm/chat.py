r"""Chat formatting with Spark expressions only.

Template.  A conversation is a row of blocks; a block is a run of adjacent turns
of one role:

    <|im_start|>role\n first text <|im_sep|> second text <|im_end|>\n

Texts and roles are escaped first: a backslash becomes ``\s`` and the i-th control
string becomes ``\`` and the i-th letter of ``CODES``, so no control string of the
template (or of the other listed templates) survives inside a text, and
``unescape`` gives back the very text.  A line feed, which ends a role, becomes ``\n`` inside one.  The loss mask is a list of byte ranges of the
UTF-8 output, one for each assistant text, without separators.

A conversation's turn structs are collected and sorted, and array aggregations merge them into blocks and place the loss ranges.

Cases.  Null text or role: empty.  Null conv_id: one conversation of its own.  Null turn:
before all others.  Equal turns are ordered by role, then text, and equal rows are
all kept.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings of common chat templates, and their one-letter codes.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CODES = "abcdefgh"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for string, code in zip(CONTROL, CODES, strict=True):
        out = F.replace(out, F.lit(string), F.lit("\\" + code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for string, code in zip(CONTROL, CODES, strict=True):
        out = F.replace(out, F.lit("\\" + code), F.lit(string))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


#: Elements of one inner aggregation.
PART = 256


def fold(items: Column, zero: Column, step: Callable, join: Callable) -> Column:
    """Array aggregation in two levels: parts of ``PART`` elements are folded by ``step``, their results by ``join``.

    What an accumulator collects is copied at every append; so long arrays copy a part's worth, and the whole once a part.
    """
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(PART))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(F.transform(starts, lambda at: F.aggregate(F.slice(items, at, PART), zero, step)), zero, join)


def merged(turns: Column) -> Column:
    """Blocks array<struct<role, texts>> of sorted turns: adjacent turns of one role are one block."""

    def join(done: Column, new: Column) -> Column:
        last, first = F.element_at(done, -1), F.element_at(new, 1)
        both = F.struct(last["role"].alias("role"), F.concat(last["texts"], first["texts"]).alias("texts"))
        meet = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both), F.slice(new, 2, F.size(new)))
        return F.when(F.size(done) == 0, new).when(last["role"] == first["role"], meet).otherwise(F.concat(done, new))

    one = lambda t: F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    return fold(turns, F.array().cast("array<struct<role:string,texts:array<string>>>"), lambda done, t: join(done, one(t)), join)


def placed(blocks: Column) -> Column:
    """Byte ranges array<struct<start, length>> of the assistant's texts, from 1."""
    pieces = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda text, i: F.struct(
        F.when(i == 0, len(START) + F.octet_length(b["role"]) + 1).otherwise(len(SEP)).alias("before"),
        F.octet_length(text).alias("length"),
        F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0).alias("after"),
        (b["role"] == "assistant").alias("learn"),
    ))))
    kind = "struct<size:int,ranges:array<struct<start:int,length:int>>>"

    def step(acc: Column, p: Column) -> Column:
        own = F.array(F.struct((acc["size"] + p["before"] + 1).alias("start"), p["length"].alias("length")))
        ranges = F.when(p["learn"], F.concat(acc["ranges"], own)).otherwise(acc["ranges"])
        return F.struct((acc["size"] + p["before"] + p["length"] + p["after"]).alias("size"), ranges.alias("ranges"))

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(part["ranges"], lambda r: F.struct((r["start"] + acc["size"]).alias("start"), r["length"].alias("length")))
        return F.struct((acc["size"] + part["size"]).alias("size"), F.concat(acc["ranges"], moved).alias("ranges"))

    zero = F.struct(F.lit(0).alias("size"), F.array().alias("ranges")).cast(kind)
    return fold(pieces, zero, step, join)["ranges"]


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted string, loss array<struct<start, length>>) for each conversation.

    ``loss`` counts bytes of the UTF-8 form from 1, as ``substring`` of a binary does.
    One shuffle, by conv_id: a conversation is one output string, so its turns meet in one task.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        escape_role(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    blocks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).select("conv_id", merged(F.col("turns")).alias("blocks"))
    text = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END)))
    return blocks.select("conv_id", F.array_join(text, "").alias("formatted"), placed(F.col("blocks")).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns as array<struct<role, text>>, parsed back out of the formatted string."""
    blocks = F.filter(F.split(formatted, re_quote(END)), lambda b: b != F.lit(""))
    head = lambda b: F.substring_index(b, "\n", 1)
    parsed = F.transform(
        blocks,
        lambda b: F.transform(
            F.split(b.substr(F.length(head(b)) + 2, F.length(b)), re_quote(SEP)),
            lambda text: F.struct(unescape_role(head(b).substr(F.lit(len(START) + 1), F.length(b))).alias("role"), unescape(text).alias("text")),
        ),
    )
    return F.flatten(parsed)


def read_loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped: a byte range is cut in time that depends on its own length."""
    raw = F.encode(formatted, "UTF-8")
    return F.array_join(F.transform(loss, lambda x: unescape(F.decode(F.substring(raw, x["start"], x["length"]), "UTF-8"))), "")


def re_quote(string: str) -> str:
    """The string as a Java pattern."""
    return "\\Q" + string + "\\E"
