"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

1. One scan makes (id, length, hash of a prefix) of each normalised text. Lengths, then length and
   prefix, are counted with map-side combining, so a group that holds a third of all rows costs
   each task one row.
2. The groups with two rows or more become a bit array of 16 slots a group, 16 MB at most: the only
   thing that tasks share. A slot set by chance only adds a row to step 3.
3. A second scan makes the full SHA-256 of the rows whose slot is set, and of no other row. No
   text is ever shuffled.

Texts are equal when they are the same after each run of ``[\\x20\\x09-\\x0D]`` became one space.
Edge cases: null text is empty text; rows with equal text and equal id are separate rows of one
group and all count as kept when theirs is the smallest id; a null id counts in the group's size
and stays if all ids of the group are null; an empty table gives an empty result; other columns
are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.llm.common import Scratch, SlotSet, binary_texts, normal_bytes, slices, slot_sets

#: Bytes of normalised text in the prefix hash.
PREFIX_BYTES = 256


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _prefix_hash(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text[:PREFIX_BYTES], digest_size=8).digest(), "little", signed=True)


def _first_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(t) for t in texts], np.int64), np.array([_prefix_hash(t) for t in texts], np.int64)


def length_and_prefix(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, len, prefix) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lengths, prefixes = _first_keys([normal_bytes(t) for t in binary_texts(part.column("text"))])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lengths), pa.array(prefixes)], names=["id", "len", "prefix"])

    return _source(docs, id_col, text_col).mapInArrow(run, "id long, len long, prefix long")


def full_hashes(docs: DataFrame, id_col: str, text_col: str, slots: SlotSet | None = None) -> DataFrame:
    """(id, full_hash): SHA-256 in hex of the normalised text, of rows whose prefix and length are in ``slots``."""
    shared = None if slots is None else docs.sparkSession.sparkContext.broadcast(slots)  # 16 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [normal_bytes(t) for t in binary_texts(part.column("text"))]
                ids = part.column("id")
                if shared is not None:
                    lengths, prefixes = _first_keys(texts)
                    keep = shared.value.has(prefixes, lengths)
                    texts, ids = [t for t, k in zip(texts, keep, strict=True) if k], ids.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([ids, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["id", "full_hash"])

    return _source(docs, id_col, text_col).mapInArrow(run, "id long, full_hash string")


def survivors(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, full_hash) of the rows that share length and prefix hash with another row."""
    keys = scratch.table(length_and_prefix(docs, id_col, text_col))
    lengths = keys.groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len")
    prefixes = keys.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    prefixes = scratch.table(prefixes.join(lengths, "len", "left_semi"))
    (slots,) = slot_sets(prefixes, "prefix", [F.lit(True)], "len")
    scratch.drop(keys)
    return scratch.table(full_hashes(docs, id_col, text_col, slots))


def _groups(rows: DataFrame) -> DataFrame:
    """(full_hash, keep_id, group_size) of every group of two or more equal texts."""
    grouped = rows.groupBy("full_hash").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return grouped.where("group_size > 1").withColumnRenamed("full_hash", "group_hash")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The groups are read back from a written table, so that both sides of the join are plain
    exchanges and adaptive execution can split the partition of a hot group.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    groups = scratch.table(_groups(survivors(docs, id_col, text_col, scratch)))
    rows = full_hashes(docs, id_col, text_col)
    joined = rows.join(groups, F.col("full_hash") == F.col("group_hash"), "left")
    keep = F.coalesce("keep_id", "id")
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.col("full_hash").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the later copies; every column stays."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = survivors(docs, id_col, text_col, scratch)
    groups = scratch.table(_groups(rows))
    gone = rows.join(groups, F.col("full_hash") == F.col("group_hash")).where("id <> keep_id").select(F.col("id").alias("__gone")).distinct()
    gone = scratch.table(gone)
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
