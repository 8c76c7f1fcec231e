"""Chat formatting with DataFrame functions only.

A turn's content is a list of typed parts. A visitor flattens them in order: neighbouring texts are joined and escaped,
an image, audio or document becomes a placeholder; its reference and the tokens it expands to are recorded. Turns are
joined per conversation as segments with a loss flag, and the formatted string can be read back without loss.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|newline|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<kind:string,text:string,ref:string,tokens:int>"


def escape(c: Column) -> Column:
    r"""No ``<|`` survives in a text: one backslash more goes between ``<`` and ``|``, past any already there."""
    return F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")).otherwise(c)


def unescape(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<\\")), F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")).otherwise(c)


def text_parts(text: Column) -> Column:
    """A plain text as a one-part content; null is an empty text."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("tokens"))
    return F.array(part)


RUN = "struct<text:string,own:boolean>"


def visit(parts: Column) -> tuple[Column, Column]:
    """(runs, attachments) of typed parts. A run is a stretch of text, escaped as one after neighbouring text parts have
    been joined, so that no control string comes about where two parts meet; or a placeholder, which isn't the speaker's
    ``own``. Unknown kinds count as documents; a null part as empty text. Attachments keep part order: kind, ref,
    tokens (the placeholder's expanded token count)."""

    def run(c: Column, own: bool) -> Column:
        return F.array(F.struct(c.alias("text"), F.lit(own).alias("own")))

    def mark(kind: Column) -> Column:
        out = F.lit(PLACEHOLDERS["document"])
        for name, placeholder in PLACEHOLDERS.items():
            out = F.when(kind == name, F.lit(placeholder)).otherwise(out)
        return out

    def step(state: Column, p: Column) -> Column:
        is_text = p["kind"].isNull() | (p["kind"] == "text")
        text = F.concat(state["open"], F.coalesce(p["text"], F.lit("")))
        closed = F.concat(state["runs"], run(escape(state["open"]), True), run(mark(p["kind"]), False))
        return F.struct(F.when(is_text, state["runs"]).otherwise(closed).alias("runs"), F.when(is_text, text).otherwise(F.lit("")).alias("open"))

    start = F.struct(F.array().cast(f"array<{RUN}>").alias("runs"), F.lit("").alias("open"))
    runs = F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, step, lambda state: F.concat(state["runs"], run(escape(state["open"]), True)))
    attached = F.filter(parts, lambda p: p["kind"].isNotNull() & (p["kind"] != "text"))
    attachments = F.transform(attached, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens")))
    return runs, F.coalesce(attachments, F.array().cast("array<struct<kind:string,ref:string,tokens:int>>"))


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: the id, segments (array of text and loss, in order; their concatenation is the
    formatted string), attachments (turn order, then part order) and attachment_tokens. Loss lies on the texts of
    ``loss_role``, not on placeholders.

    ``parts`` is an array of ``kind, text, ref, tokens``. Turns are ordered by turn (nulls first), role, content, so
    ties and repeated rows have one order. A null conversation id is a conversation of its own. A null role or content
    is empty. A very long text is one string of its row, as it was before. An empty table gives an empty result. Other
    columns are ignored. The group of a conversation is as large as its one output row.
    """
    runs, attachments = visit(F.col(parts))
    one = turns.select(
        F.col(conv_id),
        F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), runs.alias("runs"), attachments.alias("files")).alias("_turn"),
    )
    grouped = one.groupBy(conv_id).agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))

    def segments(x: Column) -> Column:
        head = F.concat(F.lit(START), F.replace(escape(x["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
        seg = lambda c, loss: F.struct(c.alias("text"), loss.alias("loss"))
        body = F.transform(x["runs"], lambda r: seg(r["text"], r["own"] & (x["role"] == loss_role)))
        return F.concat(F.array(seg(head, F.lit(False))), body, F.array(seg(F.lit(END + "\n"), F.lit(False))))

    files = F.flatten(F.transform("_turns", lambda x: x["files"]))
    return grouped.select(
        F.col(conv_id),
        F.flatten(F.transform("_turns", segments)).alias("segments"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("bigint"), lambda a, f: a + f["tokens"]).alias("attachment_tokens"),
    )


def formatted(segments: Column) -> Column:
    """The formatted string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def under_loss(segments: Column) -> Column:
    """What the loss mask covers, unescaped, as an array of texts."""
    return F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"]))


def parse(text: Column) -> Column:
    """Read a formatted string back: an array of role and text, unescaped. Only control strings mark borders."""
    blocks = F.split(text, F.lit(r"<\|im_start\|>"), -1)

    def block(x: Column) -> Column:
        cut = F.locate("\n", x)
        name = F.replace(F.substring(x, F.lit(1), cut - 1), F.lit(NEWLINE), F.lit("\n"))
        body = F.substring(x, cut + 1, F.char_length(x) - cut - len(END) - 1)
        return F.struct(unescape(name).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), block)


_PLACEHOLDER = "|".join(re.escape(x) for x in PLACEHOLDERS.values())


def parse_parts(text: Column, attachments: Column) -> Column:
    """Read a formatted string back together with its attachments: an array of role and typed parts. Neighbouring text
    parts come back as one, empty ones not at all."""
    blocks = F.split(text, F.lit(r"<\|im_start\|>"), -1)
    marks = lambda x: F.size(F.regexp_extract_all(x, F.lit(f"({_PLACEHOLDER})")))

    def block(x: Column, seen: Column) -> Column:
        cut = F.locate("\n", x)
        name = F.replace(F.substring(x, F.lit(1), cut - 1), F.lit(NEWLINE), F.lit("\n"))
        body = F.substring(x, cut + 1, F.char_length(x) - cut - len(END) - 1)
        texts = F.split(body, F.lit(_PLACEHOLDER), -1)
        said = lambda t: F.struct(F.lit("text").alias("kind"), unescape(t).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("tokens"))
        file = lambda f: F.struct(f["kind"].alias("kind"), F.lit(None).cast("string").alias("text"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))
        parts = F.flatten(F.transform(texts, lambda t, i: F.when(i == 0, F.array(said(t))).otherwise(F.array(file(F.get(attachments, seen + i - 1)), said(t)))))
        return F.struct(unescape(name).alias("role"), F.filter(parts, lambda p: (p["kind"] != "text") | (p["text"] != "")).alias("parts"))

    own = F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.transform(own, lambda x, i: block(x, F.aggregate(F.slice(own, F.lit(1), i), F.lit(0), lambda n, y: n + marks(y))))
