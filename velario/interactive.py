"""Questions about new names on the command line: the answers are edits of the review table.

Only companies and persons without a codename yet are asked for, one after the other; all other kinds
keep their running placeholders unless ``ask_all``. ``ask(question, default)`` gives an answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from velario.operators import codenames

Ask = Callable[[str, str], str]
EDITS = "row_id long, anonymise boolean, type string, codename string"


def prompt(question: str, default: str) -> str:
    return input(f"{question} [{default}] ").strip() or default


def _yes(ask: Ask, question: str) -> bool:
    return ask(question, "y").lower().startswith("y")


def company_answers(row: Row, project: str, ask: Ask) -> tuple[str | None, list[str]]:
    """(codename or None to skip, variants that don't belong)."""
    if not _yes(ask, f"Anonymise company {row['canonical']}?"):
        return None, []
    codename = ask("Codename", project.capitalize())
    wrong = []
    if len(row["variants"]) > 1 and not _yes(ask, f"Do all of these belong: {', '.join(row['variants'])}?"):
        wrong = [v for v in row["variants"] if not _yes(ask, f"Keep {v}?")]
    return codename or None, wrong


def person_answers(row: Row, ask: Ask) -> str | None:
    choice = ask(f"Person {row['canonical']}: 1 role, 2 codename, 3 skip", "1")
    if choice == "3":
        return None
    return f"[{ask('Role', 'Persona')}]" if choice == "1" else ask("Codename", "") or None


def other_answers(row: Row, ask: Ask) -> str | None:
    return ask("Placeholder", row["codename"]) or None if _yes(ask, f"Anonymise {row['type']} {row['canonical']}?") else None


def pending(review: DataFrame, mapping: DataFrame, ask_all: bool = False) -> Iterator[Row]:
    """Rows none of whose variants has a codename, companies first, then persons, then the others."""
    known = mapping.select(F.lower("original").alias("low")).distinct()
    seen = review.select("row_id", F.explode("variants").alias("v")).join(known, F.lower("v") == F.col("low")).select("row_id").distinct()
    rows = review.join(seen, "row_id", "left_anti")
    if not ask_all:
        rows = rows.where(F.col("kind").isin("ORG", "PER"))
    order = F.when(F.col("kind") == "ORG", 0).when(F.col("kind") == "PER", 1).otherwise(2)
    return rows.orderBy(order, "row_id").toLocalIterator()


def resolve(review: DataFrame, mapping: DataFrame, project: str, ask: Ask = prompt, ask_all: bool = False) -> DataFrame:
    """The review table with the answers in it; a person at the prompt bounds how many there are."""
    edits, wrong = [], []
    for row in pending(review, mapping, ask_all):
        if row["kind"] == "ORG":
            codename, drop = company_answers(row, project, ask)
            wrong += [(row["row_id"], v) for v in drop]
        else:
            codename = person_answers(row, ask) if row["kind"] == "PER" else other_answers(row, ask)
        edits.append((row["row_id"], codename is not None, None, codename))
    spark = review.sparkSession
    answered = codenames.apply_edits(review, spark.createDataFrame(edits, EDITS))
    return codenames.drop_variants(answered, spark.createDataFrame(wrong, "row_id long, variant string"))
