"""One-pass replacement, leak finding and rehydration.

mapping(original, codename, ...). A text is scanned once, left to right, longest name first, in any
case; inserted codenames are never scanned again. Three forms give the same result:

- native: one alternation inside whole-stage code, for up to ``NATIVE_NAMES`` names;
- trie: one regular expression shared with Python workers, up to ``SHARED_CHARS`` characters of names;
- join: beyond that size. Names and texts meet as in ``occurrence``, and each text is scanned for the
  names that it contains. Nothing that grows with the mapping is held by the driver or a task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velario.operators.lineage import sorted_side
from velario.operators.occurrence import name_hits, text_key

NATIVE_NAMES = 300
SHARED_CHARS = 2_000_000
MIN_LEAK = 4
#: What may not stand next to a leaked name; fixed value.
_LETTER = "[0-9a-zñáéíóú]"


def unique_names(mapping: DataFrame) -> DataFrame:
    """One (low, original, codename) for each name in lower case: the longest original's, and of
    equally long ones the last entry's."""
    order = [c for c in ("kind_ord", "entry_ord") if c in mapping.columns]
    rank = F.struct(F.lit(0) - F.length("original"), *[F.col(c) for c in order], F.col("codename"))
    rows = mapping.where(F.length("original") > 0)
    return rows.groupBy(F.lower("original").alias("low")).agg(F.max_by("original", rank).alias("original"), F.max_by("codename", rank).alias("codename"))


def _bounded(name: str) -> str:
    left = r"\b" if name[0].isalnum() else ""
    right = r"\b" if name[-1].isalnum() else ""
    return f"{left}{re.escape(name)}{right}"


def java_pattern(names: list[str]) -> str:
    parts = []
    for n in sorted(names, key=lambda n: (-len(n), n)):
        quoted = "\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        parts.append(("\\b" if n[0].isalnum() else "") + quoted + ("\\b" if n[-1].isalnum() else ""))
    return "(?iU)(?:" + "|".join(parts) + ")"


def replace_native(text: Column, pairs: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(new text, number of replacements) for a short list of (name in lower case, codename)."""
    if not pairs:
        return text, F.lit(0)
    pattern = java_pattern([n for n, _ in pairs])
    table = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    new = F.transform(found, lambda m: F.coalesce(F.try_element_at(table, F.lower(m)), m))
    out = F.array_join(F.zip_with(gaps, new, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    hits = F.size(F.filter(found, lambda m: F.try_element_at(table, F.lower(m)).isNotNull()))
    return F.when(text.isNull(), text).otherwise(out), F.when(text.isNull(), 0).otherwise(hits)


def trie_pattern(names: list[str]) -> str:
    """One regular expression for all names, longest match first, factored by common beginnings."""
    root: dict = {}
    for name in names:
        node = root.setdefault(name[0].isalnum(), {})
        for c in name:
            node = node.setdefault(c, {})
        node[""] = name[-1].isalnum()

    def write(node: dict) -> str:
        # Runs without a branch are written in a loop: depth grows with branches, not with length.
        run = []
        while len(node) == 1 and "" not in node:
            ((c, node),) = node.items()
            run.append(re.escape(c))
        branches = [re.escape(c) + write(child) for c, child in sorted(node.items()) if c != ""]
        end = None if "" not in node else (r"\b" if node[""] else "")
        if end is not None:
            branches.append(end)
        return "".join(run) + (branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})")

    parts = [(r"\b" if bounded else "") + write(node) for bounded, node in root.items()]
    return f"(?:{'|'.join(parts)})" if parts else r"(?!)"


def substitute(text: str | None, pattern: re.Pattern, table: dict[str, str]) -> tuple[str | None, int]:
    if not text:
        return text, 0
    n = 0

    def one(m: re.Match) -> str:
        nonlocal n
        code = table.get(m[0].lower())
        n += code is not None
        return m[0] if code is None else code

    return pattern.sub(one, text), n


_patterns: dict[str, tuple[dict[str, str], re.Pattern]] = {}


def _compiled(key: str, pairs: list[tuple[str, str]]) -> tuple[dict[str, str], re.Pattern]:
    """The pattern of one mapping, compiled once for each Python worker, which keeps the last one only."""
    if key not in _patterns:
        _patterns.clear()
        table = dict(pairs)
        _patterns[key] = table, re.compile(trie_pattern(list(table)), re.IGNORECASE)
    return _patterns[key]


def _trie_columns(rows: DataFrame, text_col: str, pairs: list[tuple[str, str]]) -> DataFrame:
    shared, key = rows.sparkSession.sparkContext.broadcast(pairs), uuid.uuid4().hex  # SHARED_CHARS at most

    @F.pandas_udf("text string, n int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table, pattern = _compiled(key, shared.value)
        for s in parts:
            yield pd.DataFrame([substitute(t, pattern, table) for t in s], columns=["text", "n"])

    return rows.withColumn("__r", run(text_col))


def _join_columns(rows: DataFrame, text_col: str, names: DataFrame) -> DataFrame:
    texts = rows.where(F.length(text_col) > 0).select(F.col(text_col).alias("t")).distinct().select("t", F.lower("t").alias("low_t"), *text_key("t"))
    met = name_hits(texts, names, "low_t", "low", ["k1", "k2"], form="join")
    # A text's names are at most as many as its characters times the lengths of names.
    lists = met.join(sorted_side(names.select("low", "codename")), "low").groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "codename")).alias("names"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            out = []
            for t, found in zip(batch.column("t").to_pylist(), batch.column("names").to_pylist(), strict=True):
                table = {f["low"]: f["codename"] for f in found}
                pattern = re.compile("|".join(_bounded(n) for n in sorted(table, key=lambda n: (-len(n), n))), re.IGNORECASE)
                out.append(dict(zip(("text", "n"), substitute(t, pattern, table), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int32())]))], names=["t", "__r"])

    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])
    done = texts.join(sorted_side(lists), ["k1", "k2"]).select("t", "names").mapInArrow(run, T.StructType([T.StructField("t", T.StringType()), T.StructField("__r", result)])).select("t", "__r", *text_key("t"))
    own = rows.select("*", *[c.alias(f"__{n}") for n, c in zip(("k1", "k2"), text_key(text_col), strict=True)])
    same = (own["__k1"] == done["k1"]) & (own["__k2"] == done["k2"]) & (own[text_col] == done["t"])
    joined = own.join(sorted_side(done), same, "left").drop("t", "k1", "k2", "__k1", "__k2")
    return joined.withColumn("__r", F.coalesce("__r", F.struct(F.col(text_col).alias("text"), F.lit(0).alias("n"))))


def replace_names(rows: DataFrame, mapping: DataFrame, text_col: str = "text", out_col: str = "replaced", count_col: str = "n_replaced", form: str | None = None) -> DataFrame:
    """``rows`` with the replaced text and the number of replacements.

    The form follows the measured size of the mapping unless ``form`` names one.
    """
    names = unique_names(mapping)
    if form is None:
        size = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("low") + F.length("codename")), F.lit(0)).alias("chars")).first()
        form = "native" if size["n"] <= NATIVE_NAMES else "trie" if size["chars"] <= SHARED_CHARS else "join"
    if form == "join":
        out = _join_columns(rows, text_col, names)
    else:
        pairs = [(r["low"], r["codename"]) for r in names.orderBy("low").collect()]
        if form == "native":
            new, n = replace_native(F.col(text_col), pairs)
            return rows.withColumn(out_col, new).withColumn(count_col, n.cast("int"))
        out = _trie_columns(rows, text_col, pairs)
    return out.withColumn(out_col, F.col("__r.text")).withColumn(count_col, F.coalesce("__r.n", F.lit(0)).cast("int")).drop("__r")


def find_surviving(rows: DataFrame, mapping: DataFrame, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(id columns, original): names of 4 or more characters that still stand in a text as a word."""
    names = mapping.select("original").where(F.length(F.trim("original")) >= MIN_LEAK).distinct().withColumn("name", F.lower(F.trim("original")))
    texts = rows.select(*id_cols, F.lower(text_col).alias("low"))
    met = name_hits(texts, names, "low", "name", [*id_cols, "low"])
    quoted = F.concat(F.lit(f"(?<!{_LETTER})\\Q"), F.replace("name", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?!{_LETTER})"))
    return met.where(F.regexp_like("low", quoted)).join(names, "name").select(*id_cols, "original").distinct()


def verify_report(rows: DataFrame, outputs: DataFrame, mapping: DataFrame, min_chars: int = 20, big_bytes: int = 10_000) -> DataFrame:
    """rows(doc_id, length): sources; outputs(doc_id, text): rewritten fragments.

    One row for each source: surviving names sorted, verifiable, warnings, is_clean. A document
    whose output has almost no text while its source is large can't be verified.
    """
    left = find_surviving(outputs, mapping).groupBy("doc_id").agg(F.array_sort(F.collect_set("original")).alias("surviving"))
    size = outputs.groupBy("doc_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    joined = rows.join(size, "doc_id", "left").join(left, "doc_id", "left")
    verifiable = ~((F.coalesce("chars", F.lit(0)) < min_chars) & (F.col("length") > big_bytes))
    surviving = F.coalesce("surviving", F.array().cast("array<string>"))
    warnings = F.when(~verifiable, F.array(F.lit("no text to verify"))).otherwise(F.array().cast("array<string>"))
    return joined.select("doc_id", surviving.alias("surviving"), verifiable.alias("verifiable"), warnings.alias("warnings"), (verifiable & (F.size(surviving) == 0)).alias("is_clean"))


def invert_mapping(mapping: DataFrame) -> DataFrame:
    """(original: codename, codename: the longest original, the first of equals)."""
    order = F.struct(F.length("original"), F.lit(0) - F.coalesce("kind_ord", F.lit(0)), F.lit(0) - F.coalesce("entry_ord", F.lit(0)))
    return mapping.groupBy(F.col("codename").alias("name")).agg(F.max_by("original", order).alias("restored")).select(F.col("name").alias("original"), F.col("restored").alias("codename"))


def rehydrate(rows: DataFrame, mapping: DataFrame, text_col: str = "text", out_col: str = "restored", **options) -> DataFrame:
    return replace_names(rows, invert_mapping(mapping), text_col, out_col, **options)
