"""Near dedup against all pairs on groups that fill lists of frequent values: a hub passage, large sets, long texts."""

from __future__ import annotations

import random

import brute
import pytest

from velario.llm import common, near_dedup


def edited(rng, words, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def grouped_docs():
    rng = random.Random(17)
    docs, base = {}, [[f"b{g}w{rng.randrange(5000)}" for _ in range(n)] for g, n in enumerate((120, 300, 900))]
    passage = [f"p{k}" for k in range(60)]
    for g, words in enumerate(base):
        for _ in range(40):
            docs[len(docs)] = edited(rng, words, rng.choice([0, 0.01, 0.02, 0.03, 0.06]))
    for _ in range(60):  # a passage in a third of all rows, beside more or less text of their own
        docs[len(docs)] = " ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([0, 4, 8, 12, 16, 60]))])
    for _ in range(20):  # truncated passages link in chains
        docs[len(docs)] = " ".join(passage[: rng.randint(30, 60)])
    return docs


DOCS = grouped_docs()


@pytest.mark.parametrize("limit", [32, 8])
def test_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(near_dedup, "LIST", limit)
    rows = spark.createDataFrame(list(DOCS.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(rows).collect()}
    assert got == brute.near(DOCS)


@pytest.mark.parametrize("signature", [256, 64])
def test_lists_with_several_labels(spark, monkeypatch, signature):
    """One star a member and small signatures leave most links to the comparison inside lists."""
    monkeypatch.setattr(near_dedup, "LIST", 2)
    monkeypatch.setattr(near_dedup, "STARS", 1)
    monkeypatch.setattr(near_dedup, "SIGNATURE", signature)
    docs = {i: t for i, t in DOCS.items() if i % 3 != 2}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(rows).collect()}
    assert got == {i: c for i, (_, c, _) in brute.near(docs).items()}


def test_long_texts(spark, monkeypatch):
    """Texts longer than a slice are handled alone and whole."""
    monkeypatch.setattr(common, "SLICE_BYTES", 1000)
    long = " ".join(f"l{k}" for k in range(400_000))
    docs = {1: long, 2: long + " tail", 3: "short text of a few words", 4: None}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(rows).collect()}
    assert got == {1: (399_996, 1), 2: (399_997, 1), 3: (2, 3), 4: (0, 4)}


def test_lists_make_rows_of_links_only(spark, monkeypatch):
    """Members of a list that come near each other, but not near enough, don't become candidate pairs."""
    rng = random.Random(23)
    base = [f"w{k}" for k in range(400)]
    # Similarity 0.70 to the base: not linked, but close.
    parents = [[f"q{g}x{k}" if k % 28 == 7 + g else w for k, w in enumerate(base)] for g in range(4)]
    docs = {}
    for words in [base] * 40 + parents * 5:
        at = rng.randrange(400)
        docs[len(docs)] = " ".join([*words[:at], f"e{len(docs)}", *words[at + 1 :]])
    made = []

    def confirmed(pairs, *args):
        made.append((pairs.count(), (out := kept(pairs, *args)).count()))
        return out

    kept = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", confirmed)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(rows).collect()}
    assert got == {i: c for i, (_, c, _) in brute.near(docs).items()}
    assert len(set(got.values())) == 5
    assert len(made) == 2 and made[1][0] == made[1][1]
