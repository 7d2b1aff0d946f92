"""Chat formatting of conversations with typed content, with DataFrame functions only.

A conversation becomes one string. Each turn is `<|im_start|>role`, a line feed, its parts, `<|im_end|>`
and a line feed. A visitor goes over a turn's parts in order: text is escaped, an image, a sound or a
document becomes a placeholder such as `<|image|>` and an attachment record with its reference and the
number of tokens that it expands to.

Escaping is reversible: a backslash is doubled, then `<|` becomes `<\\|`; in roles a line feed becomes
`<\\n`. After a `<`, a single backslash appears in no other way, and no escaped text holds `<|`.

Defined results: turns go by (turn, role, content), null turns first, repeated rows are turns of their
own; a null conversation id is a conversation; null roles, texts and part lists are empty; a part of
unknown type is a `<|file|>` of no tokens. A conversation is one output row, so all its turns meet; its
work grows as n log n in turns and characters. A table without rows gives none; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binloom.llm.columns import chunks, cut, let, scanned
from binloom.llm.shared import text_or_empty

START, END = "<|im_start|>", "<|im_end|>"
#: What a content column of parts holds.
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Pixels of an image patch, tokens a second of sound, tokens a page.
PATCH, SOUND_RATE, PAGE_TOKENS = 14, 25, 256


def escape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape_text(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape_text(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape_text(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def part_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to; text has its own."""
    size = lambda n: F.coalesce(n, F.lit(0))
    image = F.ceil(size(part["width"]) / PATCH) * F.ceil(size(part["height"]) / PATCH)
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * SOUND_RATE)).when(part["type"] == "document", size(part["pages"]) * PAGE_TOKENS).otherwise(F.lit(0)).cast("long")


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _visit(part: Column, learned: Column) -> Column:
    """The piece of the string that a part becomes, and whether loss counts on it."""
    known = part["type"].isin("image", "audio", "document")
    holder = F.concat(F.lit("<|"), F.when(known, part["type"]).otherwise(F.lit("file")), F.lit("|>"))
    is_text = part["type"] == "text"
    return F.when(is_text, _piece(escape_text(text_or_empty(part["text"])), learned)).otherwise(_piece(holder, F.lit(False)))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: id, n_turns, formatted, loss_spans (start, end in code points, end exclusive) of the text of
    the roles to learn, attachments (turn, type, ref, tokens) in order, and expanded_tokens, their sum.

    content is a column of strings or of arrays of PART.
    """
    if isinstance(turns.schema[content].dataType, T.ArrayType):
        parts = F.coalesce(F.col(content).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    else:
        null = F.lit(None)
        parts = F.array(F.struct(F.lit("text").alias("type"), text_or_empty(F.col(content)).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))
    rows = turns.select(F.col(conv).alias("__conv"), F.struct(F.col(turn).alias("turn"), text_or_empty(F.col(role)).alias("role"), parts.alias("parts")).alias("__turn"))
    frame = rows.groupBy("__conv").agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))

    def pieces(t: Column) -> Column:
        head = _piece(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")), F.lit(False))
        return F.concat(F.array(head), F.transform(t["parts"], lambda p: _visit(p, t["role"].isin(*learn))), F.array(_piece(F.lit(END + "\n"), F.lit(False))))

    def attached(t: Column, i: Column) -> Column:
        return F.transform(F.filter(t["parts"], lambda p: ~p["type"].eqNullSafe("text")), lambda p: F.struct(i.alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))

    frame = frame.withColumns({"__pieces": F.flatten(F.transform("__turns", pieces)), "attachments": F.flatten(F.transform("__turns", attached))})
    ends = scanned(F.transform("__pieces", lambda p: F.length(p["text"])), lambda a, b: a + b)
    placed = let(ends, lambda e: F.transform("__pieces", lambda p, i: F.when(p["loss"], F.struct((F.get(e, i) - F.length(p["text"])).alias("start"), F.get(e, i).alias("end")))))

    return frame.select(
        F.col("__conv").alias(conv),
        F.size("__turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("__pieces", lambda p: p["text"]), "").alias("formatted"),
        F.array_compact(placed).alias("loss_spans"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """Array of (role, text) that a formatted string says; placeholders stay in the text."""
    parts = F.split(formatted, r"\Q" + START + r"\E", -1)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, "\n", 1)
        body = F.substring(x, F.length(head) + 2, F.length(x) - F.length(head) - 1 - len(END) - 1)
        return F.struct(unescape_role(head).alias("role"), unescape_text(body).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return let(chunks(formatted), lambda c: F.array_join(F.transform(loss_spans, lambda s: unescape_text(cut(c, s["start"], s["end"]))), ""))
