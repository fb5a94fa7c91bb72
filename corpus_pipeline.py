"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns documents; ``run`` writes each stage's result to
the shared folder and reads it back as the next one's input.

Edge cases: null texts and texts without letters go in the first stage, whose model rejects them; a
table without labelled rows teaches no language, so nothing stays; an empty table, or a stage that
keeps nothing, gives an empty result; rows that share an id stay or go together in the copies
stages and are mixed as separate documents; extra columns stay, but for those that the mix names
itself; a missing benchmark table is an error, an empty one removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velario.llm import decontam, exact_dedup, lang_id, mixing, near_dedup
from velario.llm.common import Scratch, documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    return lang_id.filter_rejected(docs, lang_id.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return near_dedup.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontam.decontaminate(docs, items)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for each drawn copy, with the document's columns, copy, shard and sort_key."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("mixing", source_mix),
]

#: A trained model decides the first stage, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
