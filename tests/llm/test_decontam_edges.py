"""Decontamination: short items, repeated pieces, long texts and clashing columns."""

from __future__ import annotations

import time

from velario.llm import decontam

ITEM = "the quick brown fox jumps over the lazy dog near the river bank"


def test_short_items_need_the_whole_text():
    index = decontam.ItemIndex([(1, "a"), (2, ITEM), (None, ITEM)])
    assert index.search("banana") == [] and index.search(" A ") == [(1, 0, 1)]
    assert [h[0] for h in index.search(f"xx{ITEM}yy")] == [2, None]


def test_repeated_pieces_take_linear_time():
    index = decontam.ItemIndex([(1, "abc" * 40)])
    took = []
    for n in (50_000, 200_000):
        began = time.time()
        index.search("abca" * (n // 4) + "x")
        took.append(time.time() - began)
    assert took[1] < 12 * max(took[0], 0.05)
    assert index.search("abc" * 100_000)[0][:2] == (1, 0)


def test_columns_stay(spark):
    rows = spark.createDataFrame([(1, ITEM, 7, 8, "u"), (2, "clean text", 7, 8, "u"), (2, None, 7, 8, "u")], "doc_id long, text string, hits int, __hits0 int, spans string")
    items = spark.createDataFrame([(5, ITEM), (5, ITEM)], "item_id long, text string")
    left = decontam.decontaminate(rows, items)
    assert left.columns == rows.columns and sorted(map(str, left.collect())) == sorted(map(str, rows.collect()[1:]))
    found = decontam.find_leaks(rows, items).collect()
    assert sorted([h["item_id"] for h in r["hits"]] for r in found) == [[], [], [5, 5]]


def test_long_text_is_read_to_its_end(spark):
    rows = spark.createDataFrame([(1, "word " * 700_000 + ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    assert [h["item_id"] for h in decontam.find_leaks(rows, items).first()["hits"]] == [5]
