"""What large tables need of the plans, shown on small ones."""

from __future__ import annotations

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from velario.functions.similarity import Pattern, indel_ratio_py, token_sort_ratio_py
from velario.operators import cluster, occurrence
from velario.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("large")
    spark.range(120).select(F.col("id").alias("c_custkey")).write.parquet(f"{path}/customer.parquet")
    spark.range(12).select(F.col("id").alias("s_suppkey")).write.parquet(f"{path}/supplier.parquet")
    spark.range(300).selectExpr("id div 3 as conv_id", "id % 3 as turn", "'user' as role", "concat('dice ', id) as text").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def broadcasts(frame) -> int:
    """Broadcast hash joins that the plan holds, without those of the bitmap of grams."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return sum("bucket" not in line for line in re.findall(r"BroadcastHashJoin.*", plan))


@pytest.fixture
def by_join(monkeypatch):
    """Lists of names take the form for large ones."""
    monkeypatch.setattr(occurrence, "SHARED_CHARS", 0)
    monkeypatch.setattr("velario.operators.replace.NATIVE_NAMES", 0)
    monkeypatch.setattr("velario.operators.replace.SHARED_CHARS", 0)


def test_replace_by_join_broadcasts_no_table(spark, tables):
    assert broadcasts(catalogue.QUERIES["replace_by_join"](spark, tables)) == 0


def test_long_names_meet_few_texts(spark):
    """Names that share each gram of 4 with many others meet the texts that hold them, not all."""
    names = spark.range(400).selectExpr("concat('[Cliente-430', lpad(cast(id * 37 as string), 7, '0'), ']') as name")
    short = spark.createDataFrame([(n,) for n in ("a", "ab", "abc", "abcd", "abcdefg", "abcdefgh", "abcdefghi")], "name string")
    texts = spark.range(400).selectExpr("id", "concat('de [Cliente-430', lpad(cast(id * 37 as string), 7, '0'), '] a abcdefghi') as text")
    listed = names.unionByName(short)
    got = {tuple(r) for r in occurrence.name_hits(texts, listed, "text", "name", ["id"], "join").collect()}
    assert got == {tuple(r) for r in occurrence.name_hits(texts, listed, "text", "name", ["id"], "scan").collect()} and len(got) == 400 * 8
    frame = occurrence.name_hits(texts, names, "text", "name", ["id"], "join")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    assert "substring(name" in plan.toString() and f", {occurrence.LONG_GRAM})" in plan.toString()


def test_ner_dedup_anti_broadcasts_no_table(spark, tables):
    assert broadcasts(catalogue.QUERIES["ner_dedup_anti"](spark, tables)) == 0


def plain_leaders(frame: pd.DataFrame, threshold: float) -> list[list[str]]:
    """Every name is compared with every leader so far."""
    heads: list[tuple[str, list[str]]] = []
    for row in frame.sort_values(["length", "count", "text"], ascending=[False, False, True]).itertuples():
        near = lambda norm: abs(len(norm) - len(row.norm)) <= 6 and token_sort_ratio_py(row.norm, norm) >= threshold and indel_ratio_py(row.norm, norm) >= threshold - 10  # noqa: B023, E731
        home = next((own for norm, own in heads if near(norm)), None)
        if home is None:
            heads.append((row.norm, home := []))
        home.append(row.text)
    return [own for _, own in heads]


def block(names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"kind": "ORG", "text": names, "norm": names, "count": 1, "count_": 1, "length": [len(n) for n in names], "codes": [[] for _ in names]})


def test_leaders_equal_those_of_all_comparisons():
    r = random.Random(7)
    for trial in range(150):
        letters, size = r.choice(["ab", "abc d", "abcdefgh "]), r.choice([1, 4, 9, 20, 50])
        names = {""}
        for _ in range(40):
            name = list(r.choice(sorted(names))) if r.random() < 0.7 else [r.choice(letters) for _ in range(size)]
            for _ in range(r.randint(0, 3)):
                at = r.randint(0, len(name))
                name[at : at + r.randint(0, 1)] = r.choice(["", r.choice(letters)])
            names.add("".join(name))
        frame, threshold = block(sorted(names)), r.choice([60, 82, 90, 90, 95, 100])
        assert cluster.leaders(frame, threshold)["variants"].tolist() == plain_leaders(frame, threshold), (trial, threshold)


def test_leaders_compare_few_pairs(monkeypatch):
    """A block of 2,000 different names and their variants: comparisons follow the names, not their square."""
    done = []
    monkeypatch.setattr(Pattern, "ratio", lambda self, other, own=Pattern.ratio: done.append(1) or own(self, other))
    names = ["ab" + "".join(random.Random(i).choices("bcdfghjklmnprstv", k=14)) for i in range(2000)]
    found = cluster.leaders(block(names + [n[:5] + "x" + n[6:] for n in names]))
    assert len(found) == 2000 and found["variants"].map(len).eq(2).all()
    assert len(done) < 50 * len(names)


def test_assign_codenames_broadcasts_kinds_alone(spark, tables):
    plan = catalogue.QUERIES["assign_codenames"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert all("[kind" in line for line in re.findall(r"BroadcastHashJoin.*", plan))


def test_rehydrating_broadcasts_no_table(spark, tables, by_join):
    for name in ("conversation_rehydrate", "round_trip"):
        assert broadcasts(catalogue.QUERIES[name](spark, tables)) == 0, name


def test_row_context_broadcasts_no_table(spark, tables, by_join):
    assert broadcasts(catalogue.QUERIES["row_context"](spark, tables)) == 0


def test_detect_candidates_broadcasts_no_table(spark, tables, by_join):
    assert broadcasts(catalogue.QUERIES["detect_candidates"](spark, tables)) == 0
