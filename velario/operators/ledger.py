"""Ledger operators over cells(doc_id, sheet_ord, sheet, row, col, vtype, value).

Every step is a grouping by sheet or row; cells are read once and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velario.functions import names
from velario.operators.lineage import sorted_side
from velario.operators.occurrence import name_hits

SHEET = ("doc_id", "sheet_ord", "sheet")
HEADER_ROWS, CONTENT_ROWS = 40, 100


def header_rows(cells: DataFrame, max_scan: int = HEADER_ROWS) -> DataFrame:
    """First row of each sheet with an account, a description and a numeric heading."""
    top = cells.where((F.col("row") <= max_scan) & F.col("value").isNotNull())
    per_row = top.groupBy(*SHEET, "row").agg(
        F.min(F.when(names.is_account_head(F.col("value")), F.col("col"))).alias("col_account"),
        F.min(F.when(names.is_description_head(F.col("value")), F.col("col"))).alias("col_desc"),
        F.bool_or(names.is_numeric_head(F.col("value"))).alias("numeric"),
    )
    found = per_row.where("col_account is not null and col_desc is not null and numeric")
    best = found.groupBy(*SHEET).agg(F.min(F.struct("row", "col_account", "col_desc")).alias("h"))
    return best.select(*SHEET, F.col("h.row").alias("header_row"), "h.col_account", "h.col_desc", F.lit("headers").alias("mode"))


def content_columns(cells: DataFrame, max_scan: int = CONTENT_ROWS) -> DataFrame:
    """Fallback: the column with most account-like codes and the text column right of it."""
    top = cells.where((F.col("row") <= max_scan) & F.col("value").isNotNull())
    value = F.trim("value")
    code = value.rlike(r"^\d{3,10}$")
    text = (F.col("vtype") == "s") & (value != "") & ~code
    per_col = top.groupBy(*SHEET, "col").agg(
        F.count_if(code & value.rlike("^[456]")).alias("codes"),
        F.count_if(text).alias("texts"),
        F.min(F.when(code & value.rlike("^[456]"), F.struct("row", "col"))).alias("first"),
    )
    account = per_col.where("codes >= 5").groupBy(*SHEET).agg(F.max_by("col", F.struct("codes", -F.col("first.row"), -F.col("first.col"))).alias("col_account"))
    desc = per_col.where("texts >= 5").select(*SHEET, F.col("col").alias("col_desc"))
    near = account.join(desc, list(SHEET)).where("col_desc between col_account + 1 and col_account + 4")
    return near.groupBy(*SHEET, "col_account").agg(F.min("col_desc").alias("col_desc")).select(*SHEET, F.lit(1).alias("header_row"), "col_account", "col_desc", F.lit("content").alias("mode"))


def ledger_layout(cells: DataFrame) -> DataFrame:
    by_head = header_rows(cells)
    return by_head.unionByName(content_columns(cells).join(by_head.select(*SHEET), list(SHEET), "left_anti"))


def ledger_rows(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """(sheet key, row, code, description) of the rows below the header with either of them."""
    below = cells.join(layout, list(SHEET)).where("row > header_row and (col = col_account or col = col_desc)")
    value = F.trim(F.coalesce("value", F.lit("")))
    paired = below.groupBy(*SHEET, "row").agg(F.max(F.when(F.col("col") == F.col("col_account"), value)).alias("code"), F.max(F.when(F.col("col") == F.col("col_desc"), value)).alias("description"))
    return paired.select(*SHEET, "row", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("description", F.lit("")).alias("description"))


def ledger_entities(rows: DataFrame) -> DataFrame:
    """Rows whose account code names a counterparty, with kind and the bare name."""
    kind = names.classify_account(F.col("code"))
    return rows.withColumn("kind", kind).where("kind is not null and description <> ''").withColumn("name", names.clean_description(F.col("kind"), F.col("description")))


def ledger_findings(rows: DataFrame, entities: DataFrame, layout: DataFrame) -> DataFrame:
    """One row for each ledger sheet: layout, rows scanned and rows matched."""
    scanned = rows.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows_scanned"))
    matched = entities.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("rows_matched"))
    return layout.join(scanned, list(SHEET)).join(matched, list(SHEET))


def ledger_candidates(entities: DataFrame) -> DataFrame:
    """Candidates (text, kind, count, source, account_code): first code in row order."""
    found = entities.where("name <> ''")
    order = [c for c in ("doc_id", "sheet_ord", "row") if c in found.columns]
    key = F.struct(*order, "code") if order else F.struct("code")
    grouped = found.groupBy("kind", F.col("name").alias("text")).agg(F.count(F.lit(1)).alias("count"), F.min_by(F.when(F.col("code") != "", F.col("code")), F.when(F.col("code") != "", key)).alias("account_code"))
    return grouped.select("text", "kind", "count", F.lit("pgc").alias("source"), "account_code")


def kind_buckets(entities: DataFrame) -> DataFrame:
    """(kind, name, description, count), most frequent first within a kind."""
    counts = entities.where("name <> ''").groupBy("kind", "name", "description").count()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "name", "description"))
    return counts.withColumn("rank", rank)


def name_columns(cells: DataFrame, max_scan: int = HEADER_ROWS) -> DataFrame:
    """(sheet key, header_row, col, kind) of the row with most name headings, the first of equals."""
    heads = cells.where(F.col("row") <= max_scan).withColumn("kind", names.name_head_kind(F.col("value"))).where("kind is not null")
    per_row = heads.groupBy(*SHEET, "row").agg(F.count(F.lit(1)).alias("n"))
    best = per_row.groupBy(*SHEET).agg(F.max_by("row", F.struct("n", -F.col("row"))).alias("row"))
    return heads.join(best, [*SHEET, "row"]).select(*SHEET, F.col("row").alias("header_row"), "col", "kind")


def named_column_candidates(cells: DataFrame) -> DataFrame:
    """Whole cells of name columns; the count of a name is the number of documents with it."""
    heads = name_columns(cells)
    below = cells.join(heads, [*SHEET, "col"]).where("row > header_row and vtype = 's'").select("doc_id", F.trim("value").alias("text"), "kind")
    found = below.where(names.is_cell_name(F.col("text"))).distinct()
    return found.groupBy("text", "kind").agg(F.count(F.lit(1)).alias("count")).select("text", "kind", "count", F.lit("column").alias("source"), F.lit(None).cast("string").alias("account_code"))


def row_contexts(cells: DataFrame, wanted: DataFrame, max_len: int = 120) -> DataFrame:
    """wanted(name_lower) -> (name_lower, snippet): the first row that holds the name.

    Rows come in order of ``file_ord`` where the cells have it, then document, sheet and row. Only
    the keys of rows go through the join and the grouping; the line is fetched for the first one.
    """
    from velario.functions.identifiers import redact_id

    value = F.trim("value")
    order = [c for c in ("file_ord", "doc_id", "sheet_ord", "row") if c in cells.columns]
    own = list(dict.fromkeys([*order, *SHEET]))
    lined = cells.where(value.isNotNull() & (value != "")).groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", redact_id(value).alias("v")))), lambda s: s["v"]), " · ").alias("line"))
    rows = lined.withColumn("low", F.lower(F.regexp_replace("line", r"(?U)\s+", " ")))
    hits = name_hits(rows, wanted, "low", "name_lower", order)
    first = hits.groupBy("name_lower").agg(F.min(F.struct(*order)).alias("at")).select("name_lower", "at.*")
    snippet = F.when(F.length("line") <= max_len, F.col("line")).otherwise(F.concat(F.rtrim(F.substring("line", 1, max_len - 1)), F.lit("…")))
    return first.join(sorted_side(lined), order).select("name_lower", snippet.alias("snippet"))


def attach_contexts(clusters: DataFrame, contexts: DataFrame) -> DataFrame:
    """Snippet of the canonical name, else of the first variant that has one, else a dash."""
    keyed = clusters.select("kind", "canonical", F.posexplode(F.concat(F.array("canonical"), "variants")).alias("pos", "name"))
    found = keyed.join(contexts, F.lower("name") == F.col("name_lower"))
    best = found.groupBy("kind", "canonical").agg(F.min_by("snippet", "pos").alias("context"))
    return clusters.join(best, ["kind", "canonical"], "left").withColumn("context", F.coalesce("context", F.lit("—")))
