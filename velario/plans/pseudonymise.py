"""End-to-end plans: files to a review table, review table to rewritten files and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velario.operators import cluster, codenames, detect, doctype, ledger, models
from velario.operators.lineage import cut
from velario.operators.store import MappingStore
from velario.sources import ooxml

FORCED = ("auto", "accounting", "teaser_im", "legal", "generic")


@dataclass
class Analysis:
    """What one analysis found; all are DataFrames over one scan of the files."""

    files: DataFrame
    fragments: DataFrame
    cells: DataFrame
    types: DataFrame
    batch_type: DataFrame
    candidates: DataFrame
    clusters: DataFrame
    review: DataFrame


def in_order(files: DataFrame) -> DataFrame:
    """(doc_id, file_ord): files in order of their paths; one row for each file."""
    return files.select("doc_id", F.row_number().over(Window.orderBy("path", "doc_id")).alias("file_ord"))


def document_types(files: DataFrame, fragments: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, doctype, confidence, signals) of every file."""
    counts = entities.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_entities"), F.count_distinct("sheet_ord").cast("int").alias("n_sheets"))
    words = doctype.document_keywords(fragments)
    readable = fragments.groupBy("doc_id").agg(F.bool_and(F.col("error").isNull()).alias("readable"))
    empty = F.array().cast("array<string>")
    rows = files.select("doc_id", "suffix").join(counts, "doc_id", "left").join(words, "doc_id", "left").join(readable, "doc_id", "left")
    return doctype.guess_doctype(rows.select("doc_id", "suffix", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_sheets", F.lit(0)).alias("n_sheets"), F.coalesce("legal", empty).alias("legal"), F.coalesce("teaser", empty).alias("teaser"), F.coalesce("readable", F.lit(True)).alias("readable")))


def analyse(spark: SparkSession, path: str | list[str], store: MappingStore, project: str, forced: str = "auto", mode: str = "account_full", main_company: str = "", layers: tuple = (), settings: models.Settings | None = None) -> Analysis:
    """Read files once; ledgers give their counterparties, other documents their names.

    ``settings`` switch on model layers and OCR; those of the environment hold where none are given.
    """
    if forced not in FORCED:
        raise ValueError(f"forced must be one of {FORCED}")
    settings = settings or models.Settings.from_env()
    layers = (*layers, *models.layers(settings))
    tagger = models.tagged_names(models.tagger_extract(settings)) if settings.tagger else None
    files = ooxml.read_files(spark, path)
    order = cut(in_order(files))
    cells = cut(ooxml.extract_cells(files).join(order, "doc_id"))
    fragments = cut(ooxml.extract_fragments(files, ocr=models.ocr_reader(settings)))
    layout = ledger.ledger_layout(cells)
    entities = cut(ledger.ledger_entities(ledger.ledger_rows(cells, layout)))
    if forced in ("teaser_im", "legal"):
        entities = entities.where(F.lit(False))
    types = cut(document_types(files, fragments, entities))
    texts = fragments.where("text is not null").select(F.lit(project).alias("batch_id"), "doc_id", "seq", "channel", "text").join(order, "doc_id")
    shown = cut(detect.with_previous_text(texts))
    with_type = shown.join(types.select("doc_id", "doctype"), "doc_id")
    free = cut(with_type.where(doctype.uses_ner(F.col("doctype"), forced)).drop("doctype"))
    structured = cut(detect.structured_candidates(shown))
    found = ledger.ledger_candidates(entities).unionByName(ledger.named_column_candidates(cells)).unionByName(structured)
    found = found.unionByName(detect.name_candidates(free, layers, structured, tagger))
    # Each step below is read several times.
    found = cut(found)
    clusters = cut(cluster.cluster_variants(found))
    review = codenames.assign_codenames(clusters, store.load(project), project, mode, main_company)
    review = cut(review)
    names = review.select(F.explode(F.concat(F.array("canonical"), "variants")).alias("name")).select(F.lower("name").alias("name_lower"))
    review = ledger.attach_contexts(review, cut(ledger.row_contexts(cells, names)))
    return Analysis(files, fragments, cells, types, doctype.batch_vote(types.withColumn("batch_id", F.lit(project))), found, clusters, review)


def apply_mapping(files: DataFrame, store: MappingStore, project: str, inverse: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(rewritten files, verification report); with ``inverse`` originals come back, without a report."""
    from velario.operators.replace import invert_mapping

    mapping = store.load(project)
    if inverse:
        return ooxml.rewrite_files(files, invert_mapping(mapping), "rehidratado"), None
    done = cut(ooxml.rewrite_files(files, mapping, project))
    report = ooxml.verify_files(files, done, mapping)
    return done, report
