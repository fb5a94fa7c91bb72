"""IBANs in ordinary text."""

from __future__ import annotations

import random

import brute
import pytest

from velario.llm import pii

ES, BE, PL, NO = "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "PL61 1090 1014 0000 0712 1981 2874", "NO93 8601 1117 947"


@pytest.mark.parametrize(
    "text, want",
    [
        (f"{ES} BIC CAIXESBB", [ES]),
        ("ES9121000418450200051332 EUR 100", ["ES9121000418450200051332"]),
        (f"{ES}, {PL} PKO", [ES, PL]),
        (f"{BE} {ES} {NO} EUR", [BE, ES, NO]),
        (f"REF AB12 3456 7890 {ES} BANCO", [ES]),
        ("ES91 2100 0418 4502 0005 1333 BIC", []),
        ("ES91 2100 0418 4502 0005 1332X", []),
    ],
)
def test_iban_ends_where_its_country_says(text, want):
    assert [text[a:b] for kind, a, b, _ in pii.find_spans(text) if kind == "iban"] == want


def test_long_texts_and_runs(spark):
    text = "a" * 1_500_000 + "@ " + "word " * 300_000 + "x.y@z.co"
    rows = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (None, None, None)], "doc_id long, text string, spans string")
    got = pii.pii_spans(rows).collect()
    at = len(text)
    assert sorted(str([(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in got) == sorted(["[]"] + [str([("email", at - 8, at)])] * 2)


def test_emails_as_the_whole_text_search_finds_them():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices("ab1.@%+- é", k=rng.randint(1, 25)))
        assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == brute.pii(text), text
