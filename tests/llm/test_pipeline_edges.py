"""The corpus pipeline on odd tables."""

from __future__ import annotations

import corpus_pipeline
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits int, copy string, __text string, __gone int, __id int, spans string"


def tables(spark, path, rows, items=()):
    full = [(i, t, lang, s, len(t or ""), 1, "c", "t", 2, 3, "p") for i, t, lang, s in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def text(k):
    return " ".join(f"the{(k * 7 + j) % 97} and{(k * 13 + j) % 89} thing{j}" for j in range(20))


def test_nothing_stays(spark, tmp_path):
    for name, rows in (("empty", []), ("unlabelled", [(1, text(1), None, "s")]), ("blank", [(1, None, "en", "s"), (2, "", "en", "s"), (3, "12 !", None, None)])):
        out = corpus_pipeline.run(spark, tables(spark, tmp_path / name, rows))
        assert out.collect() == [] and {"doc_id", "text", "copy", "shard"} <= set(out.columns)


def test_repeated_ids_and_clashing_columns(spark, tmp_path):
    rows = [(k % 40, text(k % 60), "en", ("a", None)[k % 2]) for k in range(120)] + [(None, text(200), "en", "a"), (None, None, None, None)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, rows, [(1, text(3)), (2, None)]))
    got = out.collect()
    assert got and all(r["__text"] == "t" and r["__gone"] == 2 and r["__id"] == 3 and r["hits"] == 1 and r["spans"] == "p" for r in got)
    assert text(3) not in {r["text"] for r in got} and all(r["taken"] <= 2 * r["size"] for r in got)


def test_a_missing_benchmark_is_an_error(spark, tmp_path):
    path = tables(spark, tmp_path, [(1, text(1), "en", "s")])
    (tmp_path / "benchmark.parquet").rename(tmp_path / "other.parquet")
    with pytest.raises(Exception, match="benchmark"):
        corpus_pipeline.run(spark, path)
