"""Chat formatting: conversations become one string with a loss mask, by built-in expressions only.

A conversation's turns are collected and sorted, neighbours of the same role share a block, and blocks are
concatenated: ``### role: text</turn>\\n``, with ``<|>`` between the texts of a block. In roles and texts
``\\``, ``#``, ``<`` (and ``:`` in roles) are written ``\\b``, ``\\h``, ``\\l`` (``\\c``), so no control string
can occur inside a text, and replacing them back restores it exactly.

Turns sort by turn, nulls first, then role and text; repeated rows are turns of their own. A null role or
text counts as empty. Rows with a null conv_id form one conversation. An empty table gives no rows. A
conversation is one row of the result, so it must fit a row; aggregation is partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, pick

HEAD, COLON, SEP, END = "### ", ": ", "<|>", "</turn>\n"
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
#: Turns whose spans are summed in one go; keeps long conversations from quadratic copying.
_STRIDE = 256


def escape(text: Column, *, role: bool = False) -> Column:
    for old, new in _ESCAPES + ((":", "\\c"),) * role:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column, *, role: bool = False) -> Column:
    for old, new in reversed(_ESCAPES + ((":", "\\c"),) * role):
        text = F.replace(text, F.lit(new), F.lit(old))
    return text


def format_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, spans (start and end in code points of what the loss covers), n_blocks."""
    rows = pick(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def mark(t: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            first = (i == 0) | (F.get(t, i - 1)["role"] != x["role"])
            last = (i == F.size(t) - 1) | (F.get(t, i + 1)["role"] != x["role"])
            pre = F.when(first, F.concat(F.lit(HEAD), escape(x["role"], role=True), F.lit(COLON))).otherwise(SEP)
            body, post = escape(x["text"]), F.when(last, END).otherwise("")
            piece = F.concat(pre, body, post)
            return F.struct(piece.alias("piece"), first.alias("first"), (x["role"] == learn_role).alias("learn"), F.length(pre).alias("pre"), F.length(body).alias("body"), F.length(piece).alias("all"))

        return F.transform(t, one)

    marked = turns.select("conv_id", mark(F.col("turns")).alias("m"))

    def spans(m: Column) -> Column:
        """Merge in strides: each has its own offsets, and a second aggregation adds what came before."""
        empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def add(acc: Column, x: Column) -> Column:
            span = F.array(F.struct((acc["at"] + x["pre"]).alias("start"), (acc["at"] + x["pre"] + x["body"]).alias("end")))
            return F.struct((acc["at"] + x["all"]).alias("at"), F.when(x["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        strides = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / _STRIDE)), lambda i: F.aggregate(F.slice(m, (i * _STRIDE + 1).cast("int"), F.lit(_STRIDE)), empty, add))

        def join(acc: Column, s: Column) -> Column:
            moved = F.transform(s["spans"], lambda p: F.struct((p["start"] + acc["at"]).alias("start"), (p["end"] + acc["at"]).alias("end")))
            return F.struct((acc["at"] + s["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

        return F.aggregate(strides, empty, join, lambda r: r["spans"])

    return marked.select(
        "conv_id",
        F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("formatted"),
        let(F.col("m"), spans).alias("spans"),
        F.size(F.filter("m", lambda x: x["first"])).cast("long").alias("n_blocks"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as structs of role and text."""
    blocks = F.slice(F.split(formatted, END), 1, F.size(F.split(formatted, END)) - 1)

    def turns(b: Column) -> Column:
        own = F.substring_index(b, COLON, 1)
        role = unescape(F.substr(own, F.lit(len(HEAD) + 1)), role=True)
        body = F.substr(b, F.length(own) + len(COLON) + 1)
        return F.transform(F.split(body, r"<\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def turn_report(formatted: DataFrame) -> DataFrame:
    """What is read back from format_conversations' output, as lengths and digests."""
    back = formatted.select("conv_id", "formatted", "n_blocks", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )
