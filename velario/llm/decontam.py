"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may differ by ``e = floor(error_rate * m)`` edits. Cut into
e + 1 pieces, at least one piece stands unchanged in any such copy. An Aho-Corasick automaton over
all pieces finds exact piece hits in whole texts; Myers' bit-parallel recurrence then gives the
least edit distance of the item to any substring around the hit.

Items come in blocks of at most ``BLOCK_CHARS`` characters, so what a task holds is bounded; every
block is one pass over the documents. Normalisation: lower case, white space runs to one space.

An item under ``MIN_CHARS`` characters, which prose holds by chance (``a`` in ``banana``), counts
only where it is a document's whole text. Longer items count anywhere, inside words too.

Edge cases: null or empty items match nothing; null or empty texts hold nothing; repeated items
and repeated documents are each reported, null ids too; an empty documents table gives an empty
result and an empty item table gives documents without hits. Texts are searched whole, in time
linear in the text for each item that shares a piece with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velario.llm.common import slices

ERROR_RATE = 0.05
#: Shorter items, in normalised characters, count only as a whole text.
MIN_CHARS = 20
BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length that make up the item."""
    n = errors + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the first best substring of ``text`` within ``most`` edits, or None."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


class ItemIndex:
    """Automaton over the pieces of all items; items under ``min_chars`` stand in a table of whole texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS):
        self.items = []
        self.whole: dict[str, list[int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normalise(text)
            if len(text) >= min_chars:
                errors = int(error_rate * len(text))
                for offset, piece in pieces(text, errors):
                    found.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, text, errors, masks(text)))
            elif text:
                self.whole.setdefault(text, []).append(item_id)
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, distance, end in the normalised text), at most one for each item.

        Windows of one item that overlap are verified as one, so a text that repeats a piece is
        read once for each item that has the piece.
        """
        text = normalise(text)
        if not text:
            return []
        out = [(item_id, 0, len(text)) for item_id in self.whole.get(text, ())]
        starts: dict[int, set[int]] = {}
        if self.items:
            for last, (length, owners) in self.automaton.iter(text):
                for k, offset in owners:
                    starts.setdefault(k, set()).add(last + 1 - length - offset)
        for k, own in starts.items():
            item_id, item, errors, peq = self.items[k]
            best = None
            for low, high in _merged(sorted(own), errors, len(item) + errors):
                hit = myers(peq, len(item), text[max(0, low) : high], errors)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], max(0, low) + hit[1])
            if best:
                out.append((item_id, *best))
        return sorted(out, key=lambda h: (h[0] is None, h[0] or 0, h[1:]))


def _merged(starts: list[int], before: int, after: int) -> Iterator[tuple[int, int]]:
    """Windows (start - before, start + after), those that overlap as one."""
    low = high = None
    for s in starts:
        if low is None:
            low, high = s - before, s + after
        elif s - before <= high:
            high = s + after
        else:
            yield low, high
            low, high = s - before, s + after
    if low is not None:
        yield low, high


_indexes: dict[str, ItemIndex] = {}


def _index(key: str, items: list[tuple[int, str]], error_rate: float, min_chars: int) -> ItemIndex:
    """The index of one block, built once for each Python worker; a worker keeps the last one only."""
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = ItemIndex(items, error_rate, min_chars)
    return _indexes[key]


HIT = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())]))


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items, each at most ``block_chars`` long (an item is never cut)."""
    block, held = [], 0
    for r in items.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long"), F.col(text_col)).toLocalIterator():
        if block and held + len(r[1]) > block_chars:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1])
    yield block


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, hits_col: str = "hits"
) -> DataFrame:
    """``docs`` with column ``hits_col``: the items that each whole text holds. A map for each block.

    A column of that name in ``docs`` is replaced.
    """
    out = docs.withColumn(hits_col, F.array().cast(HIT))
    for block in item_blocks(items, item_col, item_text_col, block_chars):
        shared, key = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            index = _index(key, shared.value, error_rate, min_chars)
            for batch in batches:
                for part in slices(batch, text_col):
                    before = part.column(hits_col).to_pylist()
                    now = [[dict(zip(("item_id", "distance", "end"), h, strict=True)) for h in index.search(t)] for t in part.column(text_col).to_pylist()]
                    at = part.schema.get_field_index(hits_col)
                    columns = [part.column(i) for i in range(part.num_columns)]
                    columns[at] = pa.array([a + b for a, b in zip(before, now, strict=True)], _ARROW)
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a test item; all columns stay."""
    mark = next(name for name in (f"__hits{i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    return find_leaks(docs, items, hits_col=mark, **options).where(F.size(mark) == 0).drop(mark)
