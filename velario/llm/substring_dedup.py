"""Substring dedup by relative Lempel-Ziv factors against indexed reference blocks.

A window is ``WINDOW`` consecutive words. Texts are cut where their anchors change: a segment is a
maximal run of windows with the same minimiser (the least hash of an 8-word group in the window).
Equal windows have equal minimisers wherever they stand, so all segments that can hold a window
meet in one reference block, the segments with its minimiser; the block's reference is the segment
of the smallest id, indexed by the place of its anchor.

1. Every segment is factored against its block. The longest factor of all, the whole segment, is
   found by hash: a segment that stands whole in a document with a smaller id is duplicate whole.
2. The first occurrences of other segments are parsed greedily against the block's reference: from
   the anchor, which both share, the factor grows word by word to both sides as far as the words
   agree. A factor of ``WINDOW`` words or more is a duplicate span when the reference's id is smaller.
3. Factor boundaries: windows of such segments outside the factor, and the reference's own windows,
   are looked up by hash among each other, since another segment of the block may hold them.
   Equal windows of one document are looked up once.

The spans of the three steps cover exactly the windows whose words also start in a document with a
smaller id. Words are compared by a 64-bit hash each; segments and windows by 64 bits and by 31
more modulo a prime. What is shuffled is one row for each segment (about 1 for 22 words), the words
of first occurrences in blocks with several segments, the windows of step 3, and the texts of
documents that lose words. Groups are minima with map-side combining and the join with references
has one row a block on one side, so a passage in a third of all documents can be split.

Edge cases: null or empty text has no words; texts shorter than a window lose nothing; windows
that repeat inside one document do not count; rows that share an id are one document to each
other, and the spans found for any of them apply to each; a null id loses nothing and is nobody's
source; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.common import Scratch, SlotSet, bits_for, flat, in_bitmap, range_check, range_hash, slices, slot_bitmap, slot_sets, word_hashes, word_spans

WINDOW = 50
ANCHOR = 8


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


@dataclass
class Segments:
    """Segments of all texts of a slice: arrays with one place for each."""

    owner: np.ndarray  # index of the text
    start: np.ndarray  # first word in the text
    at: np.ndarray  # first word in ``words``
    windows: np.ndarray
    block: np.ndarray  # the minimiser
    segment: np.ndarray  # hashes of the words
    check: np.ndarray
    words: np.ndarray
    groups: np.ndarray  # hashes of the 8-word groups

    def window_hashes(self, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        return range_hash(self.words, at, at + window).view(np.int64), range_check(self.words, at, at + window).astype(np.int32)


def parse(texts: pa.Array, window: int = WINDOW, anchor: int = ANCHOR) -> Segments:
    data, off = flat(texts)
    starts, ends, first = word_spans(data, off)
    words = word_hashes(data, starts, ends)
    none = np.zeros(0, np.int64)
    empty = Segments(none, none, none, none, none, none, none.astype(np.int32), words, none)
    n = len(words) - window + 1
    if n <= 0:
        return empty
    at = np.arange(len(words) - anchor + 1)
    groups = range_hash(words, at, at + anchor)
    least = sliding_min(groups, window - anchor + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = np.flatnonzero(owner[:n] == owner[window - 1 :])
    if not len(valid):
        return empty
    new = np.ones(len(valid), bool)
    new[1:] = (least[valid[1:]] != least[valid[:-1]]) | (owner[valid[1:]] != owner[valid[:-1]])
    heads = np.flatnonzero(new)
    at = valid[heads]
    windows = np.diff(np.append(heads, len(valid)))
    last = at + windows + window - 1
    return Segments(owner[at], at - first[owner[at]], at, windows, least[at].view(np.int64), range_hash(words, at, last).view(np.int64), range_check(words, at, last).astype(np.int32), words, groups)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def segments(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, start, windows, block, segment, check) of every segment of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = parse(part.column("text"), window)
                ids = part.column("id").take(pa.array(p.owner))
                columns = [pa.array(p.start, pa.int32()), pa.array(p.windows, pa.int32()), pa.array(p.block), pa.array(p.segment), pa.array(p.check)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "start", "windows", "block", "segment", "check"])

    source = _source(docs, id_col, text_col).where("id is not null")
    return source.mapInArrow(run, "id long, start int, windows int, block long, segment long, check int")


def first_words(docs: DataFrame, id_col: str, text_col: str, firsts: SlotSet, references: SlotSet, window: int, anchor: int = ANCHOR) -> DataFrame:
    """(id, start, block, anchor, reference, words) of the segments in ``firsts``, known by segment and id."""
    shared = docs.sparkSession.sparkContext.broadcast((firsts, references))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, references = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                p = parse(part.column("text"), window)
                ids = part.column("id").to_numpy(zero_copy_only=False)[p.owner]
                hit = np.flatnonzero(firsts.has(p.segment, ids))
                at, size = p.at[hit], p.windows[hit] + window - 1
                place = p.groups[at[:, None] + np.arange(window - anchor + 1)].argmin(1) if len(hit) else at
                ends = np.cumsum(size)
                inside = np.arange(size.sum()) - np.repeat(ends - size, size)
                words = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(p.words[np.repeat(at, size) + inside].view(np.int64)))
                columns = [pa.array(ids[hit], pa.int64()), pa.array(p.start[hit], pa.int32()), pa.array(p.block[hit]), pa.array(place, pa.int32()), pa.array(references.has(p.segment[hit], ids[hit])), words]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "block", "anchor", "reference", "words"])

    source = _source(docs, id_col, text_col).where("id is not null")
    return source.mapInArrow(run, "id long, start int, block long, anchor int, reference boolean, words array<long>")


def _agreeing(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many values agree from ``at_a`` and ``at_b`` on in direction ``step``, at most ``most``."""
    size = most + 1  # one more place, which never agrees
    ends = np.cumsum(size)
    along = np.arange(size.sum()) - np.repeat(ends - size, size)
    stop = along == np.repeat(most, size)
    x, y = np.repeat(at_a, size) + step * along, np.repeat(at_b, size) + step * along
    x[stop], y[stop] = 0, 0
    differ = stop | (a[x] != b[y])
    return np.minimum.reduceat(np.where(differ, along, np.iinfo(np.int64).max), ends - size)


def factors(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) in each row's words of the greedy factor that holds the shared anchor."""
    words, other = batch.column("words"), batch.column("r_words")
    off, off_r = words.offsets.to_numpy().astype(np.int64), other.offsets.to_numpy().astype(np.int64)
    a, b = words.values.to_numpy(), other.values.to_numpy()
    at, at_r = batch.column("anchor").to_numpy().astype(np.int64), batch.column("r_anchor").to_numpy().astype(np.int64)
    left = _agreeing(a, off[:-1] + at - 1, b, off_r[:-1] + at_r - 1, np.minimum(at, at_r), -1)
    right = _agreeing(a, off[:-1] + at, b, off_r[:-1] + at_r, np.minimum(off[1:] - off[:-1] - at, off_r[1:] - off_r[:-1] - at_r), 1)
    return at - left, at + right


_PARSED = "id long, hash long, check int, spans array<struct<a: int, b: int>>"


def _windows(words: pa.ListArray, first: np.ndarray, count: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash, check) of ``count`` windows from ``first`` on in each of the rows."""
    flat_words = words.values.to_numpy().view(np.uint64)
    off = words.offsets.to_numpy().astype(np.int64)
    ends = np.cumsum(count)
    place = np.arange(count.sum()) - np.repeat(ends - count, count) + np.repeat(first, count)
    rows = np.repeat(row, count)
    at = off[rows] + place
    return rows, place, range_hash(flat_words, at, at + window).view(np.int64), range_check(flat_words, at, at + window).astype(np.int32)


def _parsed(batch: pa.RecordBatch, spans: tuple, edges: tuple, window: int) -> pa.RecordBatch:
    """Duplicate spans (with null hashes) and windows still to be looked up, in words of the document.

    Equal windows of one document are one row, whose spans cover all of them.
    """
    ids, start = batch.column("id").to_numpy(), batch.column("start").to_numpy().astype(np.int64)
    (span_row, a, b), (row, place, hashes, checks) = spans, edges
    row = row.astype(np.int64)
    own, at = ids[row], start[row] + place
    order = np.lexsort((at, checks, hashes, own))
    own, at, hashes, checks = own[order], at[order], hashes[order], checks[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])
    cut = new.copy()
    cut[1:] |= at[1:] > at[:-1] + window
    heads, ends = np.flatnonzero(cut), np.flatnonzero(np.append(cut[1:], True)[: len(cut)])
    firsts = np.concatenate([start[span_row] + a, at[heads]]).astype(np.int32)
    lasts = np.concatenate([start[span_row] + b, at[ends] + window]).astype(np.int32)
    n, rows = len(span_row), np.flatnonzero(new)
    offsets = np.concatenate([np.arange(n), n + np.searchsorted(heads, rows), [len(firsts)]]).astype(np.int32)
    null, pad = np.arange(n + len(rows)) < n, np.zeros(n, np.int64)
    found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(firsts), pa.array(lasts)], names=["a", "b"]))
    columns = [pa.array(np.append(ids[span_row], own[rows])), pa.array(np.append(pad, hashes[rows]).astype(np.int64), mask=null), pa.array(np.append(pad, checks[rows]).astype(np.int32), mask=null), found]
    return pa.RecordBatch.from_arrays(columns, names=["id", "hash", "check", "spans"])


def parse_against_references(pairs: DataFrame, window: int) -> DataFrame:
    """_PARSED of segments beside their reference: greedy factors, and the windows outside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = factors(batch, window)
            words = batch.column("words")
            windows = np.diff(words.offsets.to_numpy().astype(np.int64)) - window + 1
            long = (b - a >= window) & (batch.column("r_id").to_numpy() < batch.column("id").to_numpy())
            row = np.arange(batch.num_rows)
            # Windows that start ahead of the factor, and those that end behind it.
            ahead, behind = np.where(long, a, windows), np.where(long, windows - (b - window + 1), 0)
            edges = [_windows(words, first, count, row, window) for first, count in ((np.zeros(len(row), np.int64), ahead), (b - window + 1, behind))]
            yield _parsed(batch, (row[long], a[long], b[long]), tuple(np.concatenate(x) for x in zip(*edges, strict=True)), window)

    return pairs.mapInArrow(run, _PARSED)


def reference_windows(references: DataFrame, window: int) -> DataFrame:
    """_PARSED of all windows of the references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            windows = np.diff(words.offsets.to_numpy().astype(np.int64)) - window + 1
            none = np.zeros(0, np.int64)
            yield _parsed(batch, (none, none, none), _windows(words, np.zeros(batch.num_rows, np.int64), windows, np.arange(batch.num_rows), window), window)

    return references.mapInArrow(run, _PARSED)


def _later(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Rows whose key and check also stand in a row with a smaller id."""
    seen = rows.groupBy(key, "check").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(F.col(key).alias("k"), F.col("check").alias("c"), "least")
    seen = scratch.table(seen)
    bits = bits_for(seen.count())
    bitmap = scratch.table(slot_bitmap(seen, "k", bits=bits))
    marked = in_bitmap(rows.withColumnRenamed(key, "k"), bitmap, "k", bits=bits)
    return marked.join(seen.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & (F.col("check") == F.col("c"))).where("id > least")


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, spans): word ranges of each document whose windows also start in a smaller id's text."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    cut = scratch.table(segments(docs, id_col, text_col, window))
    whole = _later(cut, "segment", scratch).select("id", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + window - 1).alias("b"))).alias("spans"))
    index = scratch.table(cut.groupBy("block", "segment", "check").agg(F.min("id").alias("id")))
    blocks = index.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "segment")).alias("r")).where("n > 1")
    blocks = scratch.table(blocks.select(F.col("block").alias("open"), F.col("r.id").alias("r_id"), F.col("r.segment").alias("r_segment")))
    bits = bits_for(index.count())
    wide = in_bitmap(index, scratch.table(slot_bitmap(blocks, "open", bits=bits)), "block", bits=bits)
    both = [slot_sets(rows, a, [F.lit(True)], b, bits=[bits])[0] for rows, a, b in ((wide, "segment", "id"), (blocks, "r_segment", "r_id"))]
    parsed = scratch.table(first_words(docs, id_col, text_col, *both, window))
    references = parsed.where("reference")
    beside = references.select(F.col("block").alias("r_block"), F.col("id").alias("r_id"), F.col("anchor").alias("r_anchor"), F.col("words").alias("r_words"))
    pairs = parsed.where("not reference").join(beside, F.col("block") == F.col("r_block")).select("id", "start", "anchor", "words", "r_id", "r_anchor", "r_words")
    found = scratch.table(parse_against_references(pairs, window).unionByName(reference_windows(references.select("id", "start", "words"), window)))
    long = found.where("hash is null").select("id", "spans")
    edges = _later(found.where("hash is not null"), "hash", scratch).select("id", "spans")
    # A document's spans are at most as many as its words.
    spans = whole.unionByName(long).unionByName(edges).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"))
    out = scratch.table(spans)
    scratch.drop(cut, index, parsed, found)
    return out


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text): documents without spans pass without a shuffle."""
    scratch = Scratch(docs.sparkSession, "remove-spans")
    bits = bits_for(spans.count())
    bitmap = scratch.table(slot_bitmap(spans, "id", bits=bits))
    rows = _source(docs, id_col, text_col)
    marked = in_bitmap(rows, bitmap, "id", bits=bits).join(spans, "id", "left")
    clear = in_bitmap(rows, bitmap, "id", bits=bits, present=False).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                made = [_without(t, s) for t, s in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)]
                columns = [pa.array([m[k] for m in made], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "n_words", "n_removed", "kept_text"])

    schema = "id long, n_words long, n_removed long, kept_text string"
    return marked.unionByName(clear).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _without(text: str | None, spans: list | None) -> tuple[int, int, str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    keep = np.ones(len(words), bool)
    for s in spans or ():
        keep[s["a"] : s["b"]] = False
    kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    return remove_spans(docs, duplicate_spans(docs, id_col, text_col, window), id_col, text_col)
