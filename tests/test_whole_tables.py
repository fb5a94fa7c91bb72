"""The registered queries read every row of their tables, whatever its key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from velario.functions.similarity import indel_ratio_py
from velario.plans import catalogue
from velario.plans import fixtures as fx


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """2,100 clients and 30 suppliers; of both tables the derived ones read the key alone."""
    path = tmp_path_factory.mktemp("whole")
    spark.range(2100).select(F.col("id").alias("c_custkey")).write.parquet(f"{path}/customer.parquet")
    spark.range(30).select(F.col("id").alias("s_suppkey")).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_variants_of_all_clients(spark, tables):
    rows = {r["k"]: r for r in catalogue.QUERIES["indel_pairs"](spark, tables).collect()}
    assert set(rows) == set(range(2100))
    assert all(r["ratio"] == pytest.approx(indel_ratio_py(r["a"], r["b"]), abs=1e-6) for r in rows.values())
    for name in ("normalize_org", "strip_prefix", "docref_filter", "artefact_filter", "formula_filter", "word_filters"):
        assert catalogue.QUERIES[name](spark, tables).select("k").distinct().count() == 2100, name


def test_clusters_of_all_clients(spark, tables):
    want = {v for r in fx.frame(spark, tables, fx.VARIANTS).collect() for v in (r["original"], r["variant"])}
    found = catalogue.QUERIES["cluster_variants"](spark, tables).select(F.explode(F.split("variants", "[|]")).alias("v")).collect()
    assert {r["v"] for r in found} == want and len(want) > 2100


def test_cells_of_all_clients(spark, tables):
    assert catalogue.QUERIES["ledger_scan"](spark, tables).select("code").distinct().count() == 2100
    names = {r["name"] for r in fx.frame(spark, tables, fx.CLIENTS).select("name").collect()}
    assert {r["text"] for r in catalogue.QUERIES["named_columns"](spark, tables).collect()} == names
    found = catalogue.QUERIES["row_context"](spark, tables).collect()
    assert {r["name_lower"] for r in found} == {n.lower() for n in names} and all(r["name_lower"] in r["snippet"].lower() for r in found)


def test_inverts_the_whole_mapping(spark, tables):
    names = {r["code"]: r["name"] for r in fx.frame(spark, tables, fx.IDS).select("code", "name").collect()}
    want = {}
    for code in sorted(names):
        short = f"[{'Cliente' if code.startswith('430') else 'Proveedor'}-{code[:-1]}]"
        if len(names[code]) > len(want.get(short, "")):
            want[short] = names[code]
    got = catalogue.QUERIES["mapping_invert"](spark, tables).collect()
    assert {r["original"]: r["codename"] for r in got} == want and len(got) == len(want) == 213


def test_reports_every_note(spark, tables):
    names = {r["id"]: r["name"] for r in fx.frame(spark, tables, fx.NOTES).select("id", "name").collect()}
    got = {r["doc_id"]: (r["surviving"], r["verifiable"], r["is_clean"]) for r in catalogue.QUERIES["verify_report"](spark, tables).collect()}
    assert got == {i: ("", False, False) if i % 7 == 1 else (n, True, False) if i % 5 == 0 else ("", True, True) for i, n in names.items()}
