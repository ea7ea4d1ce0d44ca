"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``### role: text</turn>``, turns are joined by line feeds. The parser cuts at ``</turn>``, drops
the line feed that joins, and reads the role up to the first ``: ``. Each turn is rendered as it is, parsed again and
compared with its source; one that doesn't come back identical is rendered escaped instead, as ``#\\# role: text</turn>``,
with ``\\`` as ``\\\\``, ``<`` as ``\\l``, ``#`` as ``\\h`` and, in the role, ``:`` as ``\\c``. Then no turn mark is left in it. A turn
that holds ``###`` anywhere is escaped as well, though the parser would read it right: to a model, such a text would
look like a turn.
The whole conversation is parsed and compared again; if any turn differs, all its turns are escaped.

The loss mask is an array of (start, length, escaped) in code points of the formatted text, one entry per assistant
turn. The digests are read back from the formatted text, by the parser and by the mask.

Turns come in the order of (turn, role, text), nulls first. A conversation is one row, as its formatted text is one
value; its turns meet in one task after a shuffle by conversation, and conversations are spread by their id.

Defined cases: a null role or text is empty; rows with a null conversation are one conversation; repeated rows are
turns of their own; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, END, LOSS_ROLE = "###", "</turn>", "assistant"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def _unescape(text: Column) -> Column:
    """Between escaped backslashes no escape is cut in two, so the parts are plain replacements."""
    part = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def _head(role: Column, escaped: Column) -> Column:
    return F.when(escaped, F.concat(F.lit("#\\# "), F.replace(_escape(role), F.lit(":"), F.lit("\\c")), F.lit(": "))).otherwise(F.concat(F.lit("### "), role, F.lit(": ")))


def _body(text: Column, escaped: Column) -> Column:
    return F.when(escaped, _escape(text)).otherwise(text)


def _render(turns: Column) -> Column:
    """turns: array of (role, text, escaped)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t.role, t.escaped), _body(t.text, t.escaped), F.lit(END))), "\n")


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    pieces = F.split(formatted, END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    rest = F.transform(pieces, lambda p, i: F.when(i > 0, F.substring(p, 2, 2147483647)).otherwise(p))

    def turn(p: Column) -> Column:
        at, escaped = F.instr(p, ": "), p.startswith("#\\# ")
        role, text = F.substr(p, F.lit(5), at - 5), F.substr(p, at + 2)
        return F.struct(F.when(escaped, _unescape(role)).otherwise(role).alias("role"), F.when(escaped, _unescape(text)).otherwise(text).alias("text"))

    return F.transform(rest, turn)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))


def _with(turns: Column, escaped) -> Column:
    return F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"), escaped(t).alias("escaped")))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row (conv_id, formatted, loss_mask) for each conversation of ``rows`` (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = F.array(F.struct(F.col("t.role").alias("role"), F.col("t.text").alias("text"), F.lit(False).alias("escaped")))
    back = parse(_render(one))
    marked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).withColumn("escaped", ~(back == _plain(one)) | F.col("t.text").contains(MARK) | F.col("t.role").contains(MARK))
    chats = marked.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t.turn", "t.role", "t.text", "escaped"))).alias("turns"))
    chats = chats.withColumn("first", _render(F.col("turns")))
    chats = chats.withColumn("same", parse(F.col("first")) == _plain(F.col("turns")))
    chats = chats.withColumn("turns", _with(F.col("turns"), lambda t: t.escaped | ~F.col("same")))
    chats = chats.withColumn("formatted", F.when(F.col("same"), F.col("first")).otherwise(_render(F.col("turns"))))

    def step(state: Column, t: Column) -> Column:
        start = state.at + F.length(_head(t.role, t.escaped))
        size = F.length(_body(t.text, t.escaped))
        entry = F.array(F.struct(start.alias("start"), size.alias("length"), t.escaped.alias("escaped")))
        return F.struct((start + size + len(END) + 1).alias("at"), F.when(t.role == LOSS_ROLE, F.concat(state.mask, entry)).otherwise(state.mask).alias("mask"))

    nothing = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int,escaped:boolean>>)").alias("mask"))
    return chats.select("conv_id", "formatted", F.aggregate("turns", nothing, step, lambda s: s.mask).alias("loss_mask"))


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Counts and digests, read back from the formatted texts and the loss masks alone."""
    turns = parse(F.col("formatted"))
    masked = F.transform("loss_mask", lambda m: F.when(m.escaped, _unescape(F.substr("formatted", m.start + 1, m.length))).otherwise(F.substr("formatted", m.start + 1, m.length)))
    out = formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
