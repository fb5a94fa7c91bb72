"""Which names stand in which texts: the one join between a list of names and a corpus.

Both forms give the same rows, every name that a text contains and how often without overlap:

- scan: for lists of up to ``SHARED_CHARS`` characters, measured first. An Aho-Corasick automaton of
  all names is built once for each Python worker and reads every text once; texts don't move.
- join: beyond that size. Every name is known by its rarest gram, the one that the fewest names
  hold, so no gram is hot because many names begin alike. Names of 8 characters or more have grams
  of 8, since hundreds of thousands of names share each gram of 4. Text keys and gram hashes are joined, after
  a bitmap of the names' grams has passed them; texts are fetched by key last and only then searched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velario.operators.lineage import sorted_side

GRAM, LONG_GRAM = 4, 8
SHARED_CHARS = 2_000_000
#: log2 of the slots of the gram bitmap: 2 MB, whatever the number of names.
BITMAP_BITS = 24

_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, names: list[str]) -> ahocorasick.Automaton:
    """Built once for each Python worker, which keeps the last one only."""
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for i, name in enumerate(names):
            made.add_word(name, (i, len(name)))
        if names:
            made.make_automaton()
        _automata[key] = made
    return _automata[key]


def _scan(texts: DataFrame, names: list[str], text_col: str, name_col: str, keep: list[str]) -> DataFrame:
    shared, key = texts.sparkSession.sparkContext.broadcast(names), uuid.uuid4().hex  # SHARED_CHARS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value)
        for batch in batches:
            rows, found, hits = [], [], []
            for row, text in enumerate(batch.column("__text").to_pylist()):
                seen: dict[int, list[int]] = {}
                for end, (i, n) in automaton.iter(text) if text and shared.value else ():
                    own = seen.setdefault(i, [0, -1])
                    if end - n >= own[1]:
                        own[0], own[1] = own[0] + 1, end
                rows += [row] * len(seen)
                found += [shared.value[i] for i in seen]
                hits += [n for n, _ in seen.values()]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(len(keep))], pa.array(found, pa.string()), pa.array(hits, pa.int64())], names=[*keep, name_col, "hits"])

    source = texts.select(*keep, F.col(text_col).alias("__text"))
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(name_col, T.StringType()), T.StructField("hits", T.LongType())]))


def grams(text: Column, width: int) -> Column:
    """Distinct substrings of ``width`` characters; none of a shorter text."""
    at = F.sequence(F.lit(1), F.length(text) - width + 1)
    return F.when(F.length(text) >= width, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(width))))).otherwise(F.array().cast("array<string>"))


def _slot(column: str) -> str:
    return f"pmod({column}, {1 << BITMAP_BITS}) + 1"


def _join(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, keep: list[str]) -> DataFrame:
    long = F.length("name") >= LONG_GRAM
    widths = [r["w"] for r in names.select(F.when(long, LONG_GRAM).otherwise(F.least(F.length("name"), F.lit(GRAM))).alias("w")).distinct().collect()]  # GRAM + 1 rows at most
    own_grams = F.when(long, grams(F.col("name"), LONG_GRAM)).when(F.length("name") >= GRAM, grams(F.col("name"), GRAM)).otherwise(F.array("name"))
    each = names.select("name", F.explode(own_grams).alias("gram"))
    rare = each.join(sorted_side(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))), "gram").groupBy("name").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    keyed = rare.select("name", F.xxhash64("gram").alias("g"))
    bitmap = keyed.groupBy(F.expr(f"bitmap_bucket_number({_slot('g')})").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({_slot('g')}))").alias("bitmap"))
    low = texts.where(F.length(text_col) > 0).select(F.col(text_col).alias("t")).distinct().select("t", *text_key(F.col("t")))
    exploded = low.select("k1", "k2", F.explode(F.array_distinct(F.transform(F.concat(*[grams(F.col("t"), w) for w in widths] or [F.array().cast("array<string>")]), lambda g: F.xxhash64(g)))).alias("g"))
    marked = exploded.withColumns({"bucket": F.expr(f"bitmap_bucket_number({_slot('g')})"), "bit": F.expr(f"bitmap_bit_position({_slot('g')})")}).join(F.broadcast(bitmap), "bucket")
    byte = "cast(conv(hex(substring(bitmap, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
    kept = marked.where(F.expr(f"shiftright({byte}, cast(bit % 8 as int)) & 1") == 1).select("k1", "k2", "g")
    pairs = kept.join(sorted_side(keyed), "g").select("k1", "k2", "name").distinct()
    rows = texts.where(F.length(text_col) > 0).select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("__text"))
    rows = rows.select("*", *[c.alias(f"__{k}") for k, c in zip(("k1", "k2"), text_key(F.col("__text")), strict=True)])
    hits = (F.length("__text") - F.length(F.replace("__text", F.col("name"), F.lit("")))) / F.length("name")
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(keep)]
    met = rows.join(sorted_side(pairs), (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2"))).where(F.contains("__text", F.col("name")))
    return met.select(*own, F.col("name").alias(name_col), hits.cast("long").alias("hits"))


def text_key(text: Column | str) -> list[Column]:
    """128 bits that stand for a text; a chance meeting would only cost work."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def name_hits(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, keep: list[str], form: str | None = None) -> DataFrame:
    """(keep columns, name, hits): a row for each row of ``texts`` and each name that its text contains.

    names(name_col); ``hits`` counts from the left without overlap. Null and empty names or texts
    have no hits; repeated names count once, repeated texts each give their rows. The form follows
    the measured length of the names unless ``form`` names one.
    """
    wanted = names.where(F.length(name_col) > 0).select(F.col(name_col).alias("name")).distinct()
    if form is None:
        chars = wanted.agg(F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars")).first()["chars"]
        form = "scan" if chars <= SHARED_CHARS else "join"
    if form == "join":
        return _join(texts, wanted, text_col, name_col, keep)
    return _scan(texts, sorted(r["name"] for r in wanted.collect()), text_col, name_col, keep)
