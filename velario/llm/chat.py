"""Chat formatting of typed content parts.

A visitor walks the content parts of each turn. Text becomes escaped text; an image, audio or
document part becomes a placeholder ``<|kind:index|>`` in its place, its reference and the number
of tokens it expands to are recorded as an attachment. Control strings inside texts are escaped
reversibly: the two characters ``<|`` become ``<\\\\|`` and any ``<\\\\`` run gains one backslash.

Template: ``<|im_start|>role\\nbody<|im_end|>\\n`` for each turn, in order of turn. The role is
escaped like a text, with newlines as ``\\\\n``. The loss mask lists (start, end) code-point spans
of the bodies of assistant turns.

Edge cases: null text is empty; null role is the empty role; null turns sort first, ties of turn
by role, then text; repeated rows are repeated turns; an empty table gives an empty result; a null
conversation id is a conversation of its own. A null part is nothing; a part of unknown or null
kind becomes ``<|part:index|>`` of 0 tokens; sizes and pages that are null or under 1 count as 1,
seconds that are null, negative or not finite as 0. Other columns are ignored. One conversation is
one output string, so its rows meet in one task: that is the size of the output row itself.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a part expands to: per image tile and second of audio; documents by page.
IMAGE_TILE, TOKENS_PER_TILE, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 512, 170, 25, 600

PART = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.IntegerType()),
    ]
)
FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("attachments", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", T.LongType())]))),
    ]
)


def escape(text: str) -> str:
    r"""After this, ``<|`` does not occur: ``<`` and a run of backslashes before ``|`` gain one."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _at_least_one(value) -> int:
    return value if value is not None and value > 0 else 1


class PartVisitor:
    """Flattens content parts into text with ordered placeholders."""

    def __init__(self) -> None:
        self.attachments: list[tuple[str, str | None, int]] = []
        self.handlers: dict[str, Callable] = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}

    def visit(self, part) -> str:
        return "" if part is None else self.handlers.get(part["kind"], self.visit_other)(part)

    def visit_text(self, part) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part) -> str:
        tiles = -(-_at_least_one(part["width"]) // IMAGE_TILE) * -(-_at_least_one(part["height"]) // IMAGE_TILE)
        return self._attach("image", part, tiles * TOKENS_PER_TILE)

    def visit_audio(self, part) -> str:
        seconds = part["seconds"]
        heard = seconds if seconds is not None and math.isfinite(seconds) and seconds > 0 else 0
        return self._attach("audio", part, math.ceil(heard * AUDIO_TOKENS_PER_SECOND))

    def visit_document(self, part) -> str:
        return self._attach("document", part, _at_least_one(part["pages"]) * TOKENS_PER_PAGE)

    def visit_other(self, part) -> str:
        return self._attach("part", part, 0)

    def _attach(self, kind: str, part, tokens: int) -> str:
        self.attachments.append((kind, part["ref"], tokens))
        return f"<|{kind}:{len(self.attachments) - 1}|>"


def format_turns(turns: list[tuple[str | None, list]]) -> tuple[str, list[list[int]], list[tuple]]:
    """turns: (role, parts) in order. Returns the text, the loss spans and the attachments."""
    visitor, out, at, spans = PartVisitor(), [], 0, []
    for role, parts in turns:
        head = f"{START}{escape(role or '').replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n')}\n"
        body = "".join(visitor.visit(p) for p in parts or [])
        if role == "assistant":
            spans.append([at + len(head), at + len(head) + len(body)])
        piece = f"{head}{body}{END}\n"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans, visitor.attachments


def parse_formatted(text: str) -> list[tuple[str, str]]:
    """(role, body with placeholders, unescaped) of each turn: the inverse for text parts."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = text.index("\n", at)
        end = text.index(f"{END}\n", line)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text[at + len(START) : line])
        turns.append((unescape(role), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def _parts(value) -> list:
    return [p.asDict() if isinstance(p, Row) else p for p in (value if value is not None else [])]


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """rows: one for each turn, with an array of PART. Returns FORMATTED, one row a conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(parts_col).alias("parts"))
    grouped = rows.groupBy(F.col(conv_col).cast("string").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for conv_id, turns in zip(frame.conv_id, frame.turns, strict=True):
                text, spans, found = format_turns([(t["role"], _parts(t["parts"])) for t in turns])
                made.append((conv_id, text, len(turns), spans, [dict(zip(("kind", "ref", "tokens"), a, strict=True)) for a in found]))
            yield pd.DataFrame(made, columns=FORMATTED.names)

    # Ids pass as strings: pandas would turn nullable longs into doubles.
    as_text = T.StructType([T.StructField("conv_id", T.StringType()), *FORMATTED.fields[1:]])
    return grouped.mapInPandas(run, as_text).withColumn("conv_id", F.col("conv_id").cast("long"))


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]])


def reference_part(kind: str, ref: Column, **sizes: Column) -> Column:
    """An image, audio or document part; ``sizes``: width, height, seconds or pages."""
    given = {"kind": F.lit(kind), "ref": ref, **sizes}
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields])


def with_text_parts(rows: DataFrame, text_col: str = "text", parts_col: str = "parts") -> DataFrame:
    """A plain text column as an array of one text part, in ``parts_col`` (which it replaces)."""
    return rows.withColumn(parts_col, F.array(text_part(F.col(text_col))))


def digest_formatted(conv_id, text: str, spans) -> tuple:
    """What the query reports, all of it read back from the formatted text and the loss mask."""
    turns = parse_formatted(text)
    said = "".join(f"{role}\n{body}\n" for role, body in turns)
    learned = "".join(unescape(text[a:b]) for a, b in spans)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return conv_id, len(turns), sha(said), len(learned), sha(learned), len(text)
