"""Document types by ledger entities, file suffix and key phrases, and the vote over a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.functions import lexicon as lex

TYPES = ("accounting", "teaser_im", "legal", "datapack", "generic")
EXCEL = ("xlsx", "xlsm")


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """The key phrases that occur in the text, in list order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words]), lambda w: w.isNotNull())


def document_keywords(fragments: DataFrame) -> DataFrame:
    """(doc_id, legal, teaser): phrases found in any fragment; found per fragment, then united."""
    found = fragments.select("doc_id", keyword_hits(F.col("text"), lex.LEGAL_KEYWORDS).alias("legal"), keyword_hits(F.col("text"), lex.TEASER_KEYWORDS).alias("teaser"))
    return found.groupBy("doc_id").agg(*[F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("legal", "teaser")])


def guess_doctype(docs: DataFrame) -> DataFrame:
    """docs(doc_id, suffix, n_entities, n_sheets, legal array, teaser array, readable) -> doctype, confidence, signals."""
    n_legal, n_teaser = F.size("legal"), F.size("teaser")
    ledger = F.col("suffix").isin(*EXCEL) & (F.col("n_entities") > 0)
    legal = (n_legal >= 2) & (n_legal > n_teaser)
    slides = F.col("suffix") == "pptx"
    teaser = (n_teaser >= 2) | (slides & (n_teaser >= 1))
    kind = F.when(ledger, "accounting").when(~F.col("readable"), "generic").when(legal, "legal").when(teaser | slides, "teaser_im").otherwise("generic")
    score = (
        F.when(ledger, F.least(F.lit(1.0), F.lit(0.7) + F.col("n_entities") / 1000))
        .when(~F.col("readable"), 0.3)
        .when(legal, F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * n_legal))
        .when(teaser, F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.1) * n_teaser))
        .when(slides, 0.4)
        .otherwise(0.3)
    )
    signals = (
        F.when(ledger, F.array(F.concat(F.col("n_entities").cast("string"), F.lit(" account entities"))))
        .when(~F.col("readable"), F.array(F.lit("no text")))
        .when(legal, F.slice("legal", 1, 5))
        .when(teaser, F.slice("teaser", 1, 5))
        .otherwise(F.array().cast("array<string>"))
    )
    return docs.select("doc_id", kind.alias("doctype"), score.cast("double").alias("confidence"), signals.alias("signals"))


def batch_vote(guesses: DataFrame, batch_cols: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """One doctype for each batch: its only file's, all files' type, a 70 % majority, or datapack."""
    per_type = guesses.groupBy(*batch_cols, "doctype").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))
    votes = per_type.groupBy(*batch_cols).agg(F.sum("n").alias("files"), F.count(F.lit(1)).alias("types"), F.max("n").alias("top"), F.max_by("doctype", F.struct("n", "doctype")).alias("main"), F.max("confidence").alias("confidence"))
    kind = F.when((F.col("types") == 1) | (F.col("top") / F.col("files") >= 0.7), F.col("main")).otherwise("datapack")
    score = F.when(F.col("files") == 1, F.col("confidence")).when(F.col("types") == 1, 0.9).when(F.col("top") / F.col("files") >= 0.7, 0.7).otherwise(0.6)
    return votes.select(*batch_cols, "files", kind.alias("doctype"), score.alias("confidence"))


def uses_ner(doctype: Column, forced: str = "auto") -> Column:
    """Names are looked for in all documents but ledgers; a forced type overrules the guess."""
    return F.lit(forced != "accounting") if forced != "auto" else doctype != "accounting"
