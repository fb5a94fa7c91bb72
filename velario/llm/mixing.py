"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is dealt into ``BLOCKS`` permuted blocks by a hash of its rows. Its target is a number
of whole passes over all its blocks, then blocks in permuted order while they fit, and one block
that is taken in part. These exact block quotas of all sources are split among the output shards
by a binary tree: at each node a multivariate-hypergeometric draw says how many of each source's
blocks go left, so shards get equal block counts and every drawn block goes to one shard. Each
drawn copy carries its shard and a random sort key; ``mixed_rows`` orders every shard by it.

The block taken in part is split by further bits of the hash, bucket by bucket, until at most
``SPLIT_ROWS`` rows are left; those are taken while they fit, and one more if that comes nearer. So
a source misses its target by at most half of the smallest row left in its split block.

A row is its own unit: its draws follow from its source and hash alone, nothing is grouped by id
and no row is shuffled to be drawn. The driver holds BLOCKS sums, at most 256 bucket sums for each
level and SPLIT_ROWS sizes for each source, whatever the number of rows; sources are the names
that weights are given for. Draws are seeded, so reruns agree.

Edge cases: null text has size 0; a document without words is never taken; null is a source of its
own and comes last; an empty table gives an empty result; rows that share an id are separate
documents; rows equal in id, source and text are drawn alike; a null id is an id like any other;
columns named as in ``MIX_COLUMNS`` give way to the mix's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velario.llm.common import Scratch, slices, word_counts

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix has this share of all words.
SHARE = 1.5
#: No source, and no document, is taken more often.
MAX_REPEATS = 2
#: Blocks of a source: the lowest bits of a row's hash. Buckets of a split block: the next 8 bits.
BLOCK_BITS, SPLIT_BITS = 6, 8
BLOCKS = 1 << BLOCK_BITS
SPLIT_ROWS = 4096
SHARDS = 16
SEED = 7
#: Plan tables with more rows are joined without a broadcast.
BROADCAST_ROWS = 100_000
MIX_COLUMNS = ("size", "source_size", "target", "taken", "copies", "copy", "shard", "sort_key")


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Share ``total`` by weight; what exceeds ``cap * size`` is shared again among the rest."""
    fixed: dict[int, float] = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > cap * sizes[i]] if weight else []
        if not over:
            return [float(fixed[i]) if i in fixed else left * weights[i] / weight for i in range(len(sizes))]
        fixed.update({i: cap * sizes[i] for i in over})


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas[source] -> counts[source, shard]; each shard gets an equal number of blocks, +-1."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(counts: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[:, first] = counts
            return
        middle = (first + last) // 2
        total = int(counts.sum())
        bounds = [total * k // (last - first) for k in (0, middle - first)]
        left = rng.multivariate_hypergeometric(counts, bounds[1] - bounds[0], method="marginals") if total else counts
        split(left, first, middle)
        split(counts - left, middle, last)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def _with_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, columns: list[str]) -> DataFrame:
    """``columns`` of every row as c0, c1, ..., and __source, __key (a hash of id, source and text) and __size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                arrays = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(word_counts(part.column("__text")), pa.int64())], names=[*part.schema.names[:-1], "__size"])

    source = docs[source_col].cast("string")
    own = [docs[c].alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select(*own, source.alias("__source"), F.xxhash64(F.lit(seed), docs[id_col], source, docs[text_col]).alias("__key"), docs[text_col].alias("__text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("__size", T.LongType())]))


def _block(key: str | Column = "__key") -> Column:
    return F.pmod(key, F.lit(BLOCKS)).cast("int")


class Quota:
    """One source's draws: whole blocks by copy, and what is chosen of the block taken in part."""

    def __init__(self, source: str | None, sums: dict[int, tuple[int, int]], goal: float, rng: np.random.Generator):
        self.source, self.size, self.goal = source, sum(w for w, _ in sums.values()), goal
        order = [int(b) for b in rng.permutation(BLOCKS)]
        passes = int((goal + 0.5) // self.size) if self.size else 0
        self.whole = [(b, copy) for copy in range(passes) for b in order]
        self.left, self.copy = goal - passes * self.size, passes
        self.prefixes: list[tuple[int, int]] = []  # (mask, bits): buckets of the split block
        self.keys: list[int] = []  # single rows of it
        self.part: tuple[int, int] | None = None  # (mask, bits) of what is still to be split
        rest = self._fit([(sums[b][0], sums[b][1], b) for b in order if b in sums])
        self.whole += [(b, passes) for b in self.taken]
        self.block = rest
        if rest is not None:
            self.part, self.rows = (BLOCKS - 1, rest), sums[rest][1]

    def _fit(self, parts: list[tuple[int, int, int]]) -> int | None:
        """Take (words, rows, name) in order while they fit; the smallest of the others is split next."""
        self.taken, others = [], []
        for words, _, name in parts:
            if 0 < words <= self.left:
                self.taken.append(name)
                self.left -= words
            elif words:
                others.append((words, name))
        return min(others)[1] if others and self.left > 0.5 else None

    def split(self, buckets: list[tuple[int, int, int]], shift: int) -> None:
        """buckets: (words, rows, bucket) of the part, by the bits from ``shift`` on."""
        mask, bits = self.part
        wider = mask | ((1 << SPLIT_BITS) - 1) << shift
        rest = self._fit(sorted(buckets, key=lambda b: b[2]))
        self.prefixes += [(wider, bits | b << shift) for b in self.taken]
        self.part = None
        if rest is not None:
            self.part, self.rows = (wider, bits | rest << shift), next(n for _, n, b in buckets if b == rest)

    def finish(self, rows: list[tuple[int, int]]) -> None:
        """rows: (key, words of all rows with this key) of the part."""
        self._fit([(words, 1, key) for key, words in sorted(rows)])
        self.keys = list(self.taken)
        near = min(((abs(self.left - w), k) for k, w in rows if k not in self.taken and w), default=None)
        if near and near[0] < self.left:
            self.keys.append(near[1])
        self.part = None


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(spark, quotas: list[Quota]) -> DataFrame:
    rows = [(q.source, _signed(q.part[0]), _signed(q.part[1])) for q in quotas]
    return _small(spark.createDataFrame(rows, "p_source string, mask long, bits long"), len(rows))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MAX_REPEATS, shards: int = SHARDS, seed: int = SEED) -> tuple[list[Quota], list[list[tuple[int, int, int]]]]:
    """Quotas in order of the sources, and for each its draws (block, copy, shard).

    sized: (__source, __key, __size) of every row, a written table.
    """
    sums: dict[str | None, dict[int, tuple[int, int]]] = {}
    for r in sized.groupBy("__source", _block().alias("block")).agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("rows")).collect():
        sums.setdefault(r["__source"], {})[r["block"]] = (int(r["words"]), r["rows"])
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    sizes = [sum(w for w, _ in sums[s].values()) for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(sizes), cap)
    rng = np.random.default_rng(seed)
    quotas = [Quota(s, sums[s], g, rng) for s, g in zip(names, goal, strict=True)]
    inside = (F.col("__source").eqNullSafe(F.col("p_source"))) & (F.col("__key").bitwiseAND(F.col("mask")) == F.col("bits"))
    for shift in range(BLOCK_BITS, 64 - SPLIT_BITS + 1, SPLIT_BITS):
        wide = [q for q in quotas if q.part and q.rows > SPLIT_ROWS]
        if not wide:
            break
        bucket = F.shiftrightunsigned("__key", shift).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
        found: dict[str | None, list] = {}
        for r in sized.join(_parts(sized.sparkSession, wide), inside).groupBy("__source", bucket.alias("bucket")).agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("rows")).collect():
            found.setdefault(r["__source"], []).append((int(r["words"]), r["rows"], r["bucket"]))
        for q in wide:
            q.split(found[q.source], shift)
    last = [q for q in quotas if q.part]
    if last:
        keys: dict[str | None, list] = {}
        # Rows with one key count as one: SPLIT_ROWS at most for each source.
        for r in sized.join(_parts(sized.sparkSession, last), inside).groupBy("__source", "__key").agg(F.sum("__size").alias("words")).collect():
            keys.setdefault(r["__source"], []).append((r["__key"], int(r["words"])))
        for q in last:
            q.finish(keys[q.source])
    units = [q.whole + ([(q.block, q.copy)] if q.prefixes or q.keys else []) for q in quotas]
    counts = split_quotas(np.array([len(u) for u in units], np.int64), shards, rng) if units else np.zeros((0, shards), np.int64)
    draws = []
    for own, row in zip(units, counts, strict=True):
        places = rng.permutation(np.repeat(np.arange(shards), row))
        draws.append([(b, copy, int(place)) for (b, copy), place in zip(own, places, strict=True)])
    return quotas, draws


_SOURCES = "m_source string, source_size long, target double, split_block int, split_copy int, prefixes array<struct<mask: long, bits: long>>, keys array<long>"
_DRAWS = "d_source string, d_block int, draws array<struct<copy: int, shard: int>>"


def drawn_rows(rows: DataFrame, quotas: list[Quota], draws: list[list[tuple[int, int, int]]], seed: int = SEED) -> DataFrame:
    """``rows`` with source_size, target and __draws, the (copy, shard, sort_key) of each time it is taken."""
    spark = rows.sparkSession
    sources = [(q.source, q.size, float(q.goal), q.block, q.copy, [(_signed(m), _signed(b)) for m, b in q.prefixes], q.keys) for q in quotas]
    by_block: dict[tuple[str | None, int], list[tuple[int, int]]] = {}
    for q, own in zip(quotas, draws, strict=True):
        for block, copy, shard in own:
            by_block.setdefault((q.source, block), []).append((copy, shard))
    source_rows = _small(spark.createDataFrame(sources, _SOURCES), len(sources))
    draw_rows = _small(spark.createDataFrame([(s, b, sorted(x)) for (s, b), x in by_block.items()], _DRAWS), len(by_block))
    joined = rows.join(source_rows, F.col("__source").eqNullSafe(F.col("m_source")), "left")
    joined = joined.join(draw_rows, F.col("__source").eqNullSafe(F.col("d_source")) & (_block() == F.col("d_block")), "left")
    chosen = F.array_contains("keys", F.col("__key")) | F.exists("prefixes", lambda p: F.col("__key").bitwiseAND(p["mask"]) == p["bits"])
    split = F.coalesce(_block() == F.col("split_block"), F.lit(False))
    stands = lambda d: ~split | (d["copy"] < F.col("split_copy")) | chosen
    taken = F.when((F.col("__size") > 0) & F.col("draws").isNotNull(), F.filter("draws", stands)).otherwise(F.array().cast("array<struct<copy: int, shard: int>>"))
    keyed = F.transform(taken, lambda d: F.struct(d["copy"].alias("copy"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed + 1), "__key", d["copy"]).alias("sort_key")))
    facts = [F.coalesce("source_size", F.lit(0)).cast("long").alias("__source_size"), F.coalesce("target", F.lit(0.0)).alias("__target")]
    return joined.select(*rows.columns, *facts, keyed.alias("__draws"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, **options) -> tuple[DataFrame, list[Quota], list]:
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.table(_with_sizes(docs, id_col, text_col, source_col, seed, [id_col]))
    return sized, *plan_mix(sized.select("__source", "__key", "__size"), seed=seed, **options)


def _facts() -> list[Column]:
    copies = F.size("__draws").cast("long")
    return [F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * copies).alias("taken"), copies.alias("copies")]


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """One row for each document: id, size, source_size, target, taken, copies, shards (of its copies, comma-joined)."""
    sized, quotas, draws = _planned(docs, id_col, text_col, source_col, seed, **options)
    drawn = drawn_rows(sized, quotas, draws, seed)
    shards = F.array_join(F.transform("__draws", lambda d: d["shard"].cast("string")), ",")
    return drawn.select(F.col("c0").alias(id_col), *_facts(), shards.alias("shards"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The mix itself: one row for each drawn copy with the document's columns, copy, shard and sort_key.

    Beside them stand size, source_size, target, taken and copies of the document, as in
    ``taken_words``. Rows are in order of shard and sort key: every shard is shuffled, and large
    shards spread over several partitions.
    """
    _, quotas, draws = _planned(docs, id_col, text_col, source_col, seed, **options)
    own = [c for c in docs.columns if c == id_col or c not in MIX_COLUMNS]
    drawn = drawn_rows(_with_sizes(docs, id_col, text_col, source_col, seed, own), quotas, draws, seed)
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(own)]
    rows = drawn.where(F.size("__draws") > 0).select(*back, *_facts(), F.inline("__draws"))
    return rows.repartitionByRange("shard", "sort_key").sortWithinPartitions("shard", "sort_key")
