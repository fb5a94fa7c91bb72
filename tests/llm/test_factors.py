"""Relative Lempel-Ziv factors: greedy extension, boundaries, hot passages and long texts."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa

from velario.llm import common, substring_dedup


def checked(spark, docs):
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept_text"])) for r in substring_dedup.substring_dedup(rows).collect()}
    assert got == brute.substring(docs)
    return got


def lists(values):
    return pa.array([[int(x) for x in v] for v in values], pa.list_(pa.int64()))


def test_factors_grow_from_the_anchor():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        core = rng.integers(0, 10**6, 20)
        pads = [rng.integers(0, 2, rng.integers(0, 12)) for _ in range(4)]
        a, b = np.concatenate([pads[0], core, pads[1]]), np.concatenate([pads[2], core, pads[3]])
        rows.append((a, b, len(pads[0]), len(pads[2])))
    batch = pa.RecordBatch.from_arrays([lists([r[0] for r in rows]), lists([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], names=["words", "r_words", "anchor", "r_anchor"])
    first, end = substring_dedup.factors(batch, 50)
    for (a, b, at, at_r), x, y in zip(rows, first, end, strict=True):
        left = right = 0
        while at - left > 0 and at_r - left > 0 and a[at - left - 1] == b[at_r - left - 1]:
            left += 1
        while at + right < len(a) and at_r + right < len(b) and a[at + right] == b[at_r + right]:
            right += 1
        assert (x, y) == (at - left, at + right)


def test_passages_in_changing_surroundings(spark):
    """A passage in a third of all rows, whole, cut and edited, beside copies of a variant that is no reference."""
    rng = random.Random(4)
    own = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    passage, variant = [f"p{k}" for k in range(140)], [f"p{k}" if k % 70 else "q" for k in range(140)]
    docs = {}
    for i in range(120):
        a, b = sorted(rng.sample(range(141), 2))
        body = rng.choice([passage, variant, passage[a:b], variant[a:], own(30)])
        docs[i * 3 % 361] = " ".join(own(rng.randint(0, 60)) + body + own(rng.randint(0, 60)) + rng.choice([[], body]))
    got = checked(spark, docs)
    assert sum(r[1] > 0 for r in got.values()) > 60


def test_repeats_inside_texts(spark):
    """Few words, so anchors repeat inside a segment and don't align."""
    rng = random.Random(6)
    docs = {i: " ".join(rng.choices(["a", "b"], k=rng.randint(40, 160)) + ["a"] * rng.randint(0, 120) + ["a", "b"] * rng.randint(0, 60)) for i in range(60)}
    docs |= {100 + i: docs[i] + " tail" for i in range(0, 60, 5)}
    checked(spark, docs)


def test_structured_words_differ():
    """Long patterns that meet in sums modulo a power of two don't meet here."""
    t = np.array([bin(k).count("1") & 1 for k in range(4096)], np.uint8)
    data = np.concatenate([97 + t, 98 - t]).astype(np.uint8)
    starts, ends = np.array([0, 4096]), np.array([4096, 8192])
    assert common.range_hash(data.astype(np.uint64) + np.uint64(1), starts, ends)[0] == common.range_hash(data.astype(np.uint64) + np.uint64(1), starts, ends)[1]
    assert len(set(common.word_hashes(data, starts, ends).tolist())) == 2
    words = np.concatenate([t, 1 - t]).astype(np.uint64) + np.uint64(7)
    assert len(set(common.range_check(words, starts, ends).tolist())) == 2


def test_long_texts(spark):
    long = [f"l{k % 9973}x{k // 9973}" for k in range(300_000)]
    checked(spark, {1: " ".join(long), 2: " ".join(["head", *long[1000:]]), 3: None, 4: " ".join(long[:49])})


def test_repeated_windows_are_looked_up_once(spark, monkeypatch):
    """A line that texts repeat makes one row for each of its windows and documents, however often it stands there."""
    line = " ".join(f"c{k}" for k in range(7))
    docs = {i: f"own{i} " + " ".join([line] * (100 + i)) + f" end{i}" for i in range(6)}
    made = {}

    def later(rows, key, scratch):
        made[key] = rows.count()
        return kept(rows, key, scratch)

    kept = substring_dedup._later
    monkeypatch.setattr(substring_dedup, "_later", later)
    checked(spark, docs)
    assert 0 < made["hash"] <= 6 * (7 + 2 * 50)
