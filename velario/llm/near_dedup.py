"""MinHash near-dedup: bottom-k sketches from one hash function.

1. One scan makes each document's set of 5-word shingles (64-bit hashes of lower-cased words), its
   digest and the ``K`` smallest values, the bottom-k sketch. Equal sets form a class; only one
   representative of each class goes on.
2. Retained values that two or more representatives hold are counted, and their frequency class is
   kept as bitmaps. Two sets with similarity 0.75 share, but for odds under one in ten million, at
   least ``least_overlap`` of their retained values. So a representative with fewer shared values
   is out, and of c shared values the ``c - least_overlap + 1`` first, rare classes before frequent
   ones, go to inverted lists: any linked pair meets in one of them.
3. Lists of rare values give all their pairs. Members of lists of frequent values (over ``LIST``
   representatives) get their full sets first: who shares less than 75 % of its shingles with
   others there has no link there. Of those left, groups by ``STARS`` minimum hashes of frequent
   values give pairs with their most central member only.
4. The union-sketch estimate filters pairs, exact Jaccard on the full sets confirms links, and
   connected components of the links so far label the members.
5. Where a list of a frequent value still holds several labels, members that don't have its most
   common label are compared with all others in it, inside the join. Both show what sets them apart
   from the most central member of that label: two sets are linked if they share enough of these
   differences, so four counts bound what they can share first, and the differences, few in a group
   of near copies, decide exactly. Where one has over ``DIFFERENCES``, the overlap of the sketches
   and then signatures of ``SIGNATURE`` shingles decide (exactly for smaller sets). What passes is
   verified as in step 4, and the labels that new links join are united.

No list is capped and no value is dropped: pairs that step 3 doesn't make, step 5 does. What stays
quadratic is a list's members outside its most common label times all its members, as integers:
only pairs that the counts leave open look at arrays, and only links become rows.
Hot values are counted with map-side combining, joins meet written tables so that adaptive
execution can split their hot partitions, and memberships go through bitmaps, sized by the rows
that they hold up to 16 MB; false hits only cost work. Edge cases: null or empty text, or text
without words, has an empty set and links with nothing; rows that share an id count as one node; a
null id links with nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.llm.common import Scratch, SlotSet, bits_for, flat, in_bitmap, lower_ascii, mix, range_hash, slices, slot_bitmap, slot_sets, word_hashes, word_spans
from velario.llm.components import connected_components

SHINGLE = 5
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 75
K = 64
#: Standard deviations that a sketch may fall short of the threshold.
MARGIN = 5.5
#: Values that more representatives hold are frequent.
LIST = 32
#: Frequency classes of values: above each of these multiples of LIST; 1 holds for any shared value.
CLASSES = (0.125, 1, 8, 64, 512, 4096)
#: Groups that a member of frequent lists joins to be compared with their most central member.
STARS = 3
#: Shingles that a member shows where a list is compared; sets up to this size are compared exactly.
SIGNATURE = 256
#: Differences from a list's centre that a member shows where a list is compared.
DIFFERENCES = 512
#: Longs of the centres' sets that are broadcast: 16 MB. Rows of small tables that are broadcast.
BROADCAST_LONGS, BROADCAST_ROWS = 2 << 20, 500_000


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (as signed longs) of each text."""
    data, off = flat(texts)
    starts, ends, first = word_spans(data, off)
    words = word_hashes(lower_ascii(data), starts, ends)
    m = max(0, len(words) - width + 1)
    at = np.arange(m)
    shingles = range_hash(words, at, at + width).view(np.int64) if m else np.zeros(0, np.int64)
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            yield np.unique(shingles[a : b - width + 1])
        elif b > a:
            yield range_hash(words, np.array([a]), np.array([b])).view(np.int64)
        else:
            yield shingles[:0]


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE, k: int = K) -> DataFrame:
    """(id, n, digest, sketch) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), width))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "n", "digest", "sketch"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n long, digest binary, sketch array<long>")


class Levels:
    """Frequency classes of values as bitmaps, one for each threshold; false hits are possible."""

    def __init__(self, sets: list[SlotSet]):
        self.sets = sets

    def classes(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shared, frequent, class) of each value."""
        hits = [s.has(values) for s in self.sets]
        return hits[0], hits[1 + CLASSES.index(1)], np.sum(hits, axis=0)

    def prefixes(self, values: np.ndarray, row: np.ndarray, n: np.ndarray, k: int, percent: int, margin: float) -> tuple[np.ndarray, ...]:
        """The shared values of each row, rare classes first: (value, row, frequent, whether it is indexed)."""
        shared, frequent, group = self.classes(values)
        value, row, frequent, group = values[shared], row[shared], frequent[shared], group[shared]
        order = np.lexsort((value, group, row))
        value, row, frequent = value[order], row[order], frequent[order]
        held = np.bincount(row, minlength=len(n))
        rank = np.arange(len(row)) - (np.cumsum(held) - held)[row]
        return value, row, frequent, rank < (held - least_overlap(n, k, percent, margin) + 1)[row]


def value_levels(values: DataFrame, scratch: Scratch) -> Levels:
    """values(value), one row for each holder. Only values with two holders or more reach a class."""
    shared = scratch.table(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    steps = [1, *(int(LIST * c) for c in CLASSES)]
    return Levels(slot_sets(shared, "value", [F.col("df") > t for t in steps]))


def least_overlap(n: np.ndarray, k: int = K, percent: int = PERCENT, margin: float = MARGIN) -> np.ndarray:
    """Retained values that a set of n shares at least with any set it is linked to."""
    kept, p = np.minimum(n, k), percent / 100
    return np.maximum(1, np.floor(kept * p - margin * np.sqrt(kept * p * (1 - p)))).astype(np.int64)


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the row of each."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), sizes)


def inverted_lists(reps: DataFrame, levels: Levels, k: int, percent: int, margin: float) -> DataFrame:
    """(value, rep, n, frequent) of the indexed values."""
    shared = reps.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, row = list_values(batch.column("sketch"))
            n = batch.column("n").to_numpy()
            value, row, frequent, indexed = shared.value.prefixes(values, row, n, k, percent, margin)
            at = pa.array(row[indexed])
            yield pa.RecordBatch.from_arrays([pa.array(value[indexed]), batch.column("rep").take(at), batch.column("n").take(at), pa.array(frequent[indexed])], names=["value", "rep", "n", "frequent"])

    return reps.select("rep", "n", "sketch").mapInArrow(run, "value long, rep long, n long, frequent boolean")


def full_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, bits: int, levels: Levels, width: int, k: int, percent: int, margin: float) -> DataFrame:
    """(id, shingles, frequent) of the documents whose id may be in ``wanted`` (a bitmap of ids);
    frequent: whether the document is in a list of a frequent value."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column("text"), width))
                sizes = np.array([len(s) for s in sets], np.int64)
                kept = np.minimum(sizes, k)
                values = np.concatenate([s[:k] for s in sets]) if sets else np.zeros(0, np.int64)
                _, row, frequent, indexed = shared.value.prefixes(values, np.repeat(np.arange(len(sets)), kept), sizes, k, percent, margin)
                flags = np.bincount(row[frequent & indexed], minlength=len(sets)) > 0
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.list_(pa.int64())), pa.array(flags)], names=["id", "shingles", "frequent"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_bitmap(source, wanted, "id", bits=bits).mapInArrow(run, "id long, shingles array<long>, frequent boolean")


def central_members(sets: DataFrame, common: SlotSet, levels: Levels, k: int, percent: int, margin: float) -> DataFrame:
    """(rep, n, c, held, indexed, stars, sig) of members of frequent lists with c >= percent of n.

    c: shingles that another member holds too, at least; held: the shared retained values, rare
    classes first; indexed: how many of them are indexed; stars: the group keys; sig: the smallest
    ``SIGNATURE`` shingles.
    """
    shared = sets.sparkSession.sparkContext.broadcast((common, levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, levels = shared.value
        for batch in batches:
            values, row = list_values(batch.column("shingles"))
            n = np.bincount(row, minlength=batch.num_rows)
            c = np.bincount(row[common.has(values)], minlength=batch.num_rows)
            rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            value, row, frequent, indexed = levels.prefixes(values[rank < k], row[rank < k], n, k, percent, margin)
            out: dict[str, list] = {"held": [], "indexed": [], "stars": [], "sig": []}
            keep = np.flatnonzero((c * 100 >= n * percent) & (np.bincount(row[frequent & indexed], minlength=len(n)) > 0))
            first, whole = np.searchsorted(row, np.arange(len(n) + 1)), np.cumsum(n) - n
            for i in keep:
                own = slice(first[i], first[i + 1])
                hot = value[own][frequent[own]]
                out["held"].append(value[own])
                out["indexed"].append(int(indexed[own].sum()))
                out["stars"].append([int(hot[np.argmin(mix(hot.view(np.uint64) + np.uint64(seed)))]) for seed in range(STARS)])
                out["sig"].append(values[whole[i] : whole[i] + min(n[i], SIGNATURE)])
            columns = [batch.column("id").take(pa.array(keep)), pa.array(n[keep]), pa.array(c[keep]), pa.array(out["held"], pa.list_(pa.int64())), pa.array(out["indexed"], pa.int32()), *[pa.array(out[k], pa.list_(pa.int64())) for k in ("stars", "sig")]]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "c", "held", "indexed", "stars", "sig"])

    return sets.where("frequent").select("id", "shingles").mapInArrow(run, "rep long, n long, c long, held array<long>, indexed int, stars array<long>, sig array<long>")


def open_entries(members: DataFrame, levels: Levels, lists: SlotSet) -> DataFrame:
    """(value, rep, label) of the members of ``lists``, and of some others by chance."""
    shared = members.sparkSession.sparkContext.broadcast((levels, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, lists = shared.value
        for batch in batches:
            values, row = list_values(batch.column("held"))
            held = np.bincount(row, minlength=batch.num_rows)
            rank = np.arange(len(row)) - (np.cumsum(held) - held)[row]
            wanted = (rank < batch.column("indexed").to_numpy()[row]) & levels.classes(values)[1] & lists.has(values)
            at = pa.array(row[wanted])
            yield pa.RecordBatch.from_arrays([pa.array(values[wanted]), batch.column("rep").take(at), batch.column("label").take(at)], names=["value", "rep", "label"])

    return members.select("rep", "held", "indexed", "label").mapInArrow(run, "value long, rep long, label long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def differences(entries: DataFrame, members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, centre, n, c, held, sig, away, lost, own, diff) of each rep and centre in ``entries``.

    away: shingles that only one of the two sets holds; lost: those of the centre; own: those of
    the rep that another member holds too, at least; diff: all of them, null if over ``DIFFERENCES``.
    """
    pairs = scratch.table(entries.select("rep", "centre").distinct())
    bits = bits_for(pairs.count())
    wanted = in_bitmap(sets.select("id", "shingles"), scratch.table(slot_bitmap(pairs, "rep", bits=bits)), "id", bits=bits)
    ids = scratch.table(pairs.select(F.col("centre").alias("id")).distinct())
    centres = scratch.table(sets.join(ids, "id").select(F.col("id").alias("centre"), F.col("shingles").alias("x_c")))
    longs = centres.agg(F.sum(F.size("x_c")).alias("n")).first()["n"] or 0
    lost, own = F.array_except("x_c", "shingles"), F.array_except("shingles", "x_c")
    made = pairs.join(members.select("rep", "n", "c", "held", "sig"), "rep").join(wanted, (F.col("rep") == F.col("id")) & (F.col("n") == F.size("shingles"))).join(F.broadcast(centres) if longs <= BROADCAST_LONGS else centres, "centre")
    made = made.select("rep", "centre", "n", "c", "held", "sig", lost.alias("less"), own.alias("more"))
    away = F.size("less") + F.size("more")
    diff = F.when(away <= DIFFERENCES, F.concat("less", "more"))
    # What the rep and the centre both hold is among the c shared shingles.
    return scratch.table(made.select("rep", "centre", "n", "c", "held", "sig", away.alias("away"), F.size("less").alias("lost"), (F.col("c") - F.col("n") + F.size("more")).alias("own"), diff.alias("diff")))


def estimate(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """(hits, size) of the union sketch of two sketches: similarity is about hits / size."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    hits = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return hits, F.size(union)


def _near(hits: Column, size: Column, percent: int, margin: float) -> Column:
    p = percent / 100
    return hits >= size * p - margin * F.sqrt(size * p * (1 - p))


def _is_link(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return common * 100 >= (n_a + n_b - common) * percent


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def confirmed(pairs: DataFrame, sets: DataFrame, k: int, percent: int, margin: float) -> DataFrame:
    """The pairs (a, b, ...) whose union sketch may and whose full sets do reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("x_b"))
    hits, size = estimate(F.slice("x_a", 1, k), F.slice("x_b", 1, k), k)
    common = F.size(F.array_intersect("x_a", "x_b"))
    link = _is_link(common, F.size("x_a"), F.size("x_b"), percent)
    return pairs.join(left, "a").join(right, "b").where(F.when(_near(hits, size, percent, margin), link).otherwise(False)).select(*pairs.columns)


def near_components(docs: DataFrame, reps: DataFrame, scratch: Scratch, id_col: str, text_col: str, k: int, percent: int, margin: float, width: int) -> DataFrame:
    """(node, component) of every linked representative but the components' smallest."""
    count = reps.count()
    levels = value_levels(reps.select(F.explode("sketch").alias("value")), scratch)
    entries = scratch.table(inverted_lists(reps, levels, k, percent, margin))
    short = entries.where("not frequent").select("value", "rep", "n")
    other = short.select("value", F.col("rep").alias("rep2"), F.col("n").alias("n2"))
    pairs = scratch.table(short.join(other, "value").where((F.col("rep") < F.col("rep2")) & _sizes_fit("n", "n2", percent)).select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct())

    # Full sets of all who are in a pair or in a list of a frequent value.
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(entries.where("frequent").select("rep"))
    bits = bits_for(count)
    sets = scratch.table(full_sets(docs, id_col, text_col, scratch.table(slot_bitmap(ids, "id", bits=bits)), bits, levels, width, k, percent, margin))
    held = sets.where("frequent").agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n")).first()["n"]
    twice = sets.where("frequent").select(F.explode("shingles").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = slot_sets(twice, "value", [F.lit(True)], bits=[bits_for(held // 2)])[0]
    members = scratch.table(central_members(sets, common, levels, k, percent, margin))

    # Stars: each member with the most central one of its groups.
    grouped = members.select(F.explode("stars").alias("star"), "rep", "n", "c").distinct()
    centre = grouped.groupBy("star").agg(F.min(F.struct((-F.col("c") / F.col("n")).alias("order"), F.col("rep").alias("rep2"), F.col("n").alias("n2"))).alias("p")).select(F.col("star").alias("star2"), "p.rep2", "p.n2")
    near = grouped.join(scratch.table(centre), F.col("star") == F.col("star2")).where((F.col("rep") != F.col("rep2")) & _sizes_fit("n", "n2", percent))
    stars = near.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
    links = scratch.table(confirmed(pairs.unionByName(stars), sets, k, percent, margin).select(F.col("a").alias("u"), F.col("b").alias("v")))
    first = connected_components(links, scratch)

    # Lists of frequent values that hold several labels.
    labels = first.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    members = scratch.table(members.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")).select("rep", "n", "c", "held", "indexed", "label", "sig"))
    by_label = members.select(F.explode(F.slice("held", 1, F.col("indexed"))).alias("value"), "label").groupBy("value", "label").agg(F.count(F.lit(1)).alias("n"))
    listed = by_label.groupBy("value").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most")).where("labels > 1").select(F.col("value").alias("open"), F.col("most.label").alias("most"))
    listed = scratch.table(listed)
    lists = listed.count()
    if not lists:
        return first
    most = listed.select(F.col("most").alias("label")).distinct()
    centres = members.join(_small(most, lists), "label").groupBy("label").agg(F.min(F.struct((-F.col("c") / F.col("n")).alias("order"), "rep")).alias("p")).select(F.col("label").alias("most"), F.col("p.rep").alias("centre"))
    listed = scratch.table(listed.join(_small(scratch.table(centres), lists), "most"))
    entries = open_entries(members, levels, slot_sets(listed, "open", [F.lit(True)], bits=[bits_for(lists)])[0])
    entries = entries.join(_small(listed, lists), F.col("value") == F.col("open")).withColumn("minor", F.col("label") != F.col("most"))
    entries = scratch.table(entries.select("value", "rep", "label", "minor", "centre"))
    shared = scratch.table(entries.join(differences(entries, members, sets, scratch), ["rep", "centre"]))
    twin = shared.select(*[F.col(c).alias(f"{c}2") for c in shared.columns])
    # The overlap is at most the shared shingles of either, and must be 3/7 of both sizes together.
    bound = F.least("c", "c2") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    cheap = (F.col("label") != F.col("label2")) & _sizes_fit("n", "n2", percent) & bound & (~F.col("minor2") | (F.col("rep") < F.col("rep2")))
    both = F.array_intersect("held", "held2")
    least = F.least("n", "n2", F.lit(k))
    need = F.greatest(F.lit(1), F.floor(least * (percent / 100) - margin * F.sqrt(least * (percent / 100 * (1 - percent / 100)))))
    # All lists of a pair show the same first common value: there it is compared.
    once = (F.size(both) >= need) & (F.try_element_at(both, F.lit(1)) == F.col("value"))
    overlap = F.size(F.array_intersect("sig", "sig2"))
    small = (F.col("n") <= SIGNATURE) & (F.col("n2") <= SIGNATURE)
    close = F.when(small, _is_link(overlap, F.col("n"), F.col("n2"), percent)).otherwise(_near(*estimate(F.col("sig"), F.col("sig2"), SIGNATURE), percent, margin))
    sketched = F.when(once, close).otherwise(False)
    # Linked: (100 + percent) times what only one of both holds is at most (100 - percent) times both sizes together.
    gap = (F.col("away") + F.col("away2")) * (100 + percent) - (F.col("n") + F.col("n2")) * (100 - percent)
    can = (F.least("lost", "lost2") + F.least("own", "own2")) * (2 * (100 + percent)) >= gap
    exact = F.size(F.array_intersect("diff", "diff2")) * (2 * (100 + percent)) >= gap
    near = F.when(F.col("diff").isNotNull() & F.col("diff2").isNotNull(), exact).otherwise(sketched)
    found = shared.where("minor").join(twin, (F.col("value") == F.col("value2")) & cheap & can & near)
    rest = scratch.table(found.select(F.col("rep").alias("a"), F.col("rep2").alias("b"), "label", "label2").distinct())
    joined = scratch.table(confirmed(rest, sets, k, percent, margin).select(F.col("label").alias("u"), F.col("label2").alias("v")).distinct())
    if joined.isEmpty():
        return first
    # New links join labels: nodes and the labels themselves move to the united label.
    second = connected_components(joined, scratch)
    moved = second.select(F.col("node").alias("label"), F.col("component").alias("united"))
    known = first.join(moved, F.col("component") == F.col("label"), "left").select("node", F.coalesce("united", "component").alias("component"))
    return known.unionByName(second)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, k: int = K, percent: int = PERCENT, margin: float = MARGIN) -> DataFrame:
    """One row for each document: id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    made = scratch.table(sketches(docs, id_col, text_col, width, k))
    reps = made.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = scratch.table(reps)
    grouped = scratch.table(near_components(docs, reps, scratch, id_col, text_col, k, percent, margin, width))
    # Classes are as many as there are different sets; their component comes by a join on the rep.
    classes = reps.select("rep", F.col("digest").alias("d"))
    of_class = scratch.table(classes.join(grouped, classes.rep == grouped.node, "left").select("d", F.coalesce("component", "rep").alias("component")))
    joined = made.select("id", "n", "digest").join(of_class, (F.col("digest") == F.col("d")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component; every column stays."""
    gone = near_dedup(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("__id"))
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
