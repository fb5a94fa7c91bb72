"""Detector quality against labelled names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detector_quality(truth: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """truth(key, name), found(key, text) -> hits, missed, false positives, coverage percent by key.

    A truth name is hit when a found text contains it or it contains the text, in any case.
    """
    t = truth.select(key, F.lower("name").alias("name")).distinct()
    f = found.select(F.col(key).alias("k"), F.lower("text").alias("text")).distinct()
    met = t.join(f, (F.col(key) == F.col("k")) & (F.contains("name", "text") | F.contains("text", "name")))
    hits = met.groupBy(key).agg(F.count_distinct("name").alias("hits"), F.count_distinct("text").alias("useful"))
    total, offered = t.groupBy(key).agg(F.count(F.lit(1)).alias("truth")), f.groupBy("k").agg(F.count(F.lit(1)).alias("offered"))
    out = total.join(hits, key, "left").join(offered, F.col(key) == F.col("k"), "left")
    n = F.coalesce("hits", F.lit(0))
    return out.select(key, "truth", n.alias("hits"), (F.col("truth") - n).alias("missed"), (F.coalesce("offered", F.lit(0)) - F.coalesce("useful", F.lit(0))).alias("false_positives"), (n * 100.0 / F.col("truth")).alias("coverage"))


def compare_detectors(truth: DataFrame, base: DataFrame, more: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document: truth, hits and false positives of both detectors, and whether ``more`` is worth it."""
    columns = lambda rows, name: rows.select(key, "truth", F.col("hits").alias(f"{name}_hits"), F.col("false_positives").alias(f"{name}_false"))
    both = columns(detector_quality(truth, base, key), "base").join(columns(detector_quality(truth, more, key), "more").drop("truth"), key)
    gain = F.col("more_hits") - F.col("base_hits")
    advice = F.when(gain > F.greatest(F.col("more_false") - F.col("base_false"), F.lit(0)), "use").when(gain > 0, "review").otherwise("skip")
    return both.select("*", gain.alias("gain"), advice.alias("advice"))


def write_report(rows: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Write compare_detectors rows as CSV and JSON lines and their totals as Markdown; returns the totals."""
    root = path.rstrip("/")
    rows.write.mode("overwrite").option("header", True).csv(f"{root}/csv")
    rows.write.mode("overwrite").json(f"{root}/json")
    counts = [c for c, kind in rows.dtypes if kind == "bigint" and c != key]
    totals = rows.agg(F.count(F.lit(1)).alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    heads = ["documents", *counts]
    table = F.concat(F.lit("| " + " | ".join(heads) + " |\n|" + "---|" * len(heads) + "\n| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in heads]), F.lit(" |"))
    totals.select(table.alias("value")).write.mode("overwrite").text(f"{root}/markdown")
    return totals
