"""Chat formatting: typed content parts become one marked-up string per conversation.

Native only: a visitor over the parts (``transform`` with one branch per type)
yields text and ordered placeholders; another pass keeps attachment references
with their expanded token counts; offsets of assistant texts form the loss mask.

Template, per turn::

    <|im_start|>ROLE \\n CONTENT <|im_end|> \\n

Inside roles and texts a backslash becomes ``\\b`` and ``<|`` becomes ``<\\p``
(a line feed in a role ``\\n``), and plain replacements read it back. ``<|`` is
replaced after a turn's texts are joined, while its attachments are still
backslash codes, so no text can form a control string, wherever it is cut into parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a placeholder expands to where the part itself gives none.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _visit(part: Column) -> Column:
    """Text parts with backslashes escaped, known attachments as a backslash and their first letter, unknown types as nothing."""
    kind = part["type"]
    out = F.when(kind == "text", F.replace(F.coalesce(part["text"], F.lit("")), F.lit("\\"), F.lit("\\b")))
    for name in EXPANDED:
        out = out.when(kind == name, F.lit("\\" + name[0]))
    return out.otherwise(F.lit(""))


def _content(parts: Column) -> Column:
    """A turn's texts and placeholders: joined first, then escaped, so no cut between parts hides a control string."""
    out = F.replace(F.array_join(F.transform(parts, _visit), ""), F.lit("<|"), F.lit("<\\p"))
    for name in EXPANDED:
        out = F.replace(out, F.lit("\\" + name[0]), F.lit(f"<|{name}|>"))
    return out


def _attachment(part: Column) -> Column:
    tokens = F.when(part["type"] == "image", EXPANDED["image"]).when(part["type"] == "audio", EXPANDED["audio"]).otherwise(EXPANDED["document"])
    return F.struct(part["type"].alias("type"), part["ref"].alias("ref"), F.coalesce(part["tokens"], tokens.cast("bigint")).alias("tokens"))


def text_parts(text: Column) -> Column:
    """A plain text as one text part; null counts as empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))).cast(PARTS)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, loss_spans, attachments, n_expanded_tokens.

    Turns are ordered by (turn, role, parts as given); repeated rows stay
    repeated, null turns come first, a null role is empty, null parts and unknown
    part types are empty text. loss_spans are code point ranges [start, stop) of
    formatted, one for each turn of trained_role, its content only. A row without
    a conversation id is a conversation of its own, so such rows meet nowhere.
    An empty table gives no rows; other columns are ignored, whatever their
    names. A conversation is one value, so it meets in one task by nature.
    """
    col = lambda c: F.col(f"`{c}`")
    role = F.coalesce(col(role_col), F.lit(""))
    parts = F.coalesce(col(parts_col).cast(PARTS), F.array().cast(PARTS))
    flat = turns.select(col(conv_col).alias("conv"), F.struct(col(turn_col).alias("turn"), role.alias("role"), parts.alias("parts")).alias("t"))
    held = flat.where("conv is not null").groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    lone = flat.where("conv is null").select("conv", F.array("t").alias("ts"))
    visited = lambda t: F.struct(
        t["turn"].alias("turn"), t["role"].alias("role"), _content(t["parts"]).alias("content"), F.transform(F.filter(t["parts"], lambda p: p["type"].isin(*EXPANDED)), _attachment).alias("attached")
    )
    grouped = held.unionByName(lone).select("conv", F.transform("ts", visited).alias("ts"))
    piece = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), t["content"], F.lit(END + "\n"))
    lead = lambda t: F.length(escape_role(t["role"])) + len(START) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = (acc["at"] + lead(t)).cast("int")
        stop = (begin + F.length(t["content"])).cast("int")
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct((stop + len(END) + 1).cast("int").alias("at"), F.when(t["role"] == trained_role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return grouped.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("ts", piece), "").alias("formatted"),
        F.aggregate("ts", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: F.transform(t["attached"], lambda a: F.struct(t["turn"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("n_expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]))


def parse_chat(formatted: Column) -> Column:
    """Reads the turns back: array of (role, text), unescaped; the inverse of the template for text parts."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p.startswith(START))
    body = lambda p: F.substring(p, len(START) + 1, F.length(p))
    return F.transform(
        F.transform(pieces, body),
        lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b))).alias("text")),
    )


def read_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, joined by nothing."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
