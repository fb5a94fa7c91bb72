"""Shared pieces of the training-data operators.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes never occur inside a
multi-byte UTF-8 character, so splitting bytes and splitting code points give the same words.
Texts are handled as whole Arrow buffers: every helper works on all texts of a slice at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.operators.lineage import shared_folder

#: Bytes of text handled at once inside a task; one text may exceed it and is then handled alone.
SLICE_BYTES = 512 << 10

_BASE = 0x9E3779B97F4A7C15 | 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACE_BYTES = frozenset(b" \t\n\x0b\x0c\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_BYTES``, so that a task's memory doesn't follow its texts' length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back: lineage ends here and survives lost executors."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        if self._n == 1:
            root, files = self._file(self.root)
            files.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads; what is left goes when the session ends."""
        for df in tables:
            path, files = self._file(df._scratch_path)
            files.delete(path, True)

    def _file(self, path: str):
        context = self.spark.sparkContext
        found = context._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(context._jsc.hadoopConfiguration())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def normal_bytes(text: bytes | None) -> bytes:
    """The text with each whitespace run replaced by one space; null counts as empty."""
    if not text:
        return b""
    words = text.split()  # bytes split at x20 and x09-x0D only
    if not words:
        return b" "
    return (b" " if text[0] in _SPACE_BYTES else b"") + b" ".join(words) + (b" " if text[-1] in _SPACE_BYTES else b"")


def binary_texts(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of each text in it (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the range of its words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    cuts = off[(off > 0) & (off < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        base = np.uint64(_BASE)
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"][:n], _powers["down"][:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[start:end]``, equal wherever the same values stand."""
    n = len(values)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: A Mersenne prime: sums of products below it stay inside 64 bits.
_PRIME, _PRIME_BASE = (1 << 31) - 1, 1_103_515_245


def _prime_power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo the prime."""
    if len(_powers.get("prime_up", ())) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("prime_up", _PRIME_BASE), ("prime_down", pow(_PRIME_BASE, -1, _PRIME))):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)])
            _powers[name] = out[:size]
    return _powers["prime_up"][:n], _powers["prime_down"][:n]


def range_check(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """31-bit hashes of ``values[start:end]`` modulo a prime, independent of ``range_hash``: what
    makes sums modulo a power of two meet, such as long patterns of two values, does not here."""
    n = len(values)
    up, down = _prime_power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values % np.uint64(_PRIME) * up[:n] % np.uint64(_PRIME), out=total[1:])
    return (total[ends] - total[starts]) % np.uint64(_PRIME) * down[starts] % np.uint64(_PRIME)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, made of two independent ones."""
    values = data.astype(np.uint64) + np.uint64(1)
    return mix(range_hash(values, starts, ends) + mix(range_check(values, starts, ends)))


def word_counts(texts: pa.Array) -> np.ndarray:
    data, off = flat(texts)
    return np.diff(word_spans(data, off)[2])


def add_word_count(docs: DataFrame, text_col: str, keep: list[str], out_col: str) -> DataFrame:
    """``keep`` columns plus the number of words of each whole text (null: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                arrays = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(word_counts(part.column("__text")), pa.int64())], names=[*keep, out_col])

    source = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = source.drop("__text").withColumn(out_col, F.lit(0).cast("long")).schema
    return source.mapInArrow(run, schema)


def slot_bitmap(rows: DataFrame, *keys: str, bits: int) -> DataFrame:
    """(bucket, bitmap) with one bit set for the hashed keys of each row; at most 2**bits bits."""
    slot = f"pmod(xxhash64({', '.join(keys)}), {1 << bits})"
    return rows.groupBy(F.expr(f"bitmap_bucket_number({slot})").alias("__bucket")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({slot}))").alias("__bitmap"))


def in_bitmap(rows: DataFrame, bitmap: DataFrame, *keys: str, bits: int, present: bool = True) -> DataFrame:
    """Rows whose keys' slot is set: all that were put in, and others by chance only.

    With ``present=False`` the rows whose slot is not set (null keys have a slot like any other).
    The bitmap has a size bound of its own (16 MB at 27 bits, see bits_for), so it is broadcast.
    """
    slot = f"pmod(xxhash64({', '.join(keys)}), {1 << bits})"
    byte = "cast(conv(hex(substring(__bitmap, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = rows.withColumns({"__bucket": F.expr(f"bitmap_bucket_number({slot})"), "__bit": F.expr(f"bitmap_bit_position({slot})")})
    found = marked.join(F.broadcast(bitmap), "__bucket", "inner" if present else "left")
    bit = F.expr(f"shiftright({byte}, cast(__bit % 8 as int)) & 1")
    return found.where(bit == 1 if present else F.coalesce(bit, F.lit(0)) == 0).select(*rows.columns)


def bits_for(count: int) -> int:
    """log2 of the slots for ``count`` members: about 16 slots each, 64 KB to 16 MB in all."""
    return min(27, max(19, int(count).bit_length() + 4))


class SlotSet:
    """Membership of longs, or pairs of longs, as a bit array: true for all members, for others by chance."""

    def __init__(self, bits: int, array: np.ndarray):
        self.bits, self.array = bits, array

    def has(self, a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
        mask = (1 << self.bits) - 1
        slot = a & mask if b is None else ((a & mask) + 7919 * (b & mask)) & mask
        return (self.array[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def slot_sets(rows: DataFrame, a: str, conditions: list[Column], b: str | None = None, bits: list[int] | None = None) -> list[SlotSet]:
    """For each condition the slot set of the rows that meet it, sized by their number unless ``bits`` says.

    At most 16 MB each reach the driver, whatever the input's size.
    """
    if bits is None:
        counts = rows.agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(conditions)]).first()
        bits = [bits_for(counts[f"c{i}"]) for i in range(len(conditions))]
    slots = []
    for i, (c, n) in enumerate(zip(conditions, bits, strict=True)):
        size = 1 << n
        slot = f"pmod({a}, {size})" if b is None else f"pmod(pmod({a}, {size}) + 7919 * pmod({b}, {size}), {size})"
        slots.append(F.when(c, F.struct(F.lit(i).alias("i"), F.expr(f"{slot} + 1").alias("slot"))))
    each = rows.select(F.inline(F.filter(F.array(*slots), lambda x: x.isNotNull())))
    found = each.groupBy("i", F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))
    arrays = [np.zeros((max(1, (1 << n) // 32768), 4096), np.uint8) for n in bits]
    for r in found.collect():
        arrays[r["i"]][r["bucket"] - 1] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return [SlotSet(n, x.ravel()) for n, x in zip(bits, arrays, strict=True)]
