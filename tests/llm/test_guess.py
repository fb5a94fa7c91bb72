"""Values after credential cues."""

from __future__ import annotations

import pytest

from velario.llm import secrets


def guessed(text):
    return [text[a:b] for kind, a, b, _ in secrets.find_spans(text) if kind == "guess"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("pwd: QxZvBnRtYpLkWs", ["QxZvBnRtYpLkWs"]),
        ("passphrase=correct-Mauve!Tundra", ["correct-Mauve!Tundra"]),
        ("auth: Bearer eyJ0eXAiOiJKV1QiLCJh", ["eyJ0eXAiOiJKV1QiLCJh"]),
        ("credentials: pwd: Zx9$kQ7!pL", ["Zx9$kQ7!pL"]),
        ("auth: bearer pwd=password", []),
        ("the bearer documentation", []),
        ("bearer x9Kq7Zp3Lw and pwd : x9Kq7Zp3Lw", ["x9Kq7Zp3Lw", "x9Kq7Zp3Lw"]),
    ],
)
def test_cost_decides_after_a_cue(text, want):
    assert guessed(text) == want


def test_long_values_are_costed_whole():
    cost = secrets.guess_cost
    for unit in ("x", "ab", "abc", "q7Zp"):
        assert cost(unit * 200) < cost(unit * 16) + 2, unit
    assert [k for k, *_ in secrets.find_spans("token=" + "x" * 200)] == ["assign"]
    assert cost("asdf" + "x9Kq7Zp3Lw" * 10) > 8 and cost("") == 0


def test_dictionary_words_are_cheap():
    words = secrets.ranked_words(secrets.DEFAULT_DICTIONARY)
    assert len(words) > 10_000 and words["password"] == 1 and "giraffe" not in secrets.RANK
    assert secrets.guess_cost("elephanthouse", words) < 9 < secrets.guess_cost("elephanthouse")
    assert secrets.guess_cost("x9Kq7Zp3Lw", words) > 12 and secrets.ranked_words(None) == secrets.RANK


def test_long_texts(spark):
    text = "f" * 24 + " " + "word " * 600_000 + "token=x9Kq7Zp3Lw"
    rows = spark.createDataFrame([(1, text, "s", 3), (1, text, "s", 3), (None, None, None, None)], "doc_id long, text string, spans string, __text int")
    got = secrets.secret_spans(rows).collect()
    assert len(got) == 3 and sorted(len(r["spans"]) for r in got) == [0, 3, 3]
