"""Personal data: patterns propose, checksums confirm, nearby words move the score.

Regular expressions propose spans for each kind. A validator decides: IP parts up to 255, Luhn for
cards, digit counts for phones, mod-97 for IBANs, area rules for social-security numbers. The base
kinds (email, ip, card, phone) stand by their validator alone; the further kinds (iban, ssn) also
need a score of ``MIN_SCORE``, which context words within ``CONTEXT`` code points raise or lower.

Speed: a text is only searched for a kind when the character that every match must hold occurs in
it, and e-mail addresses are found from each @ in time linear in the text, whatever stands before
it; that gives exactly the matches of the whole-text search.

An IBAN is cut to its country's length before mod-97 decides, so words behind it do no harm; for a
country code without a known length each group border is tried, the last first.

Edge cases: null text is empty and has no spans; repeated rows give repeated results; an empty
table gives an empty result; texts of any length are searched whole; positions are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velario.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
CONTEXT = 40
MIN_SCORE = 0.5

#: Characters before the @ of an e-mail address, and what follows it; fixed values.
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Characters of an IBAN by country; fixed values.
IBAN_LENGTHS = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")

#: Words that raise the score of a kind when they stand near a span; fixed values.
CUES = {
    "email": ("mail", "contact", "@", "write to", "correo"),
    "ip": ("ip", "host", "server", "address", "connect"),
    "card": ("card", "visa", "credit", "payment", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "tax id"),
}
#: Words that lower it.
DOUBTS = ("version", "order", "invoice", "example", "serial", "sku")
#: Score of a confirmed span without context.
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.45}


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    """Digits only; every second digit from the right counts double, digit-wise."""
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    packed = iban.replace(" ", "")
    if not 15 <= len(packed) <= 34:
        return False
    moved = packed[4:] + packed[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def valid_ip(text: str) -> bool:
    return all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in text.split("."))


def valid_card(text: str) -> bool:
    found = digits(text)
    return 16 <= len(found) <= 19 and luhn(found)


def valid_phone(text: str) -> bool:
    return 8 <= len(digits(text)) <= 15


def valid_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, @ and a domain, found from each @ in one pass.

    All starts before one @ meet the same domain, so only the first of them can decide.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(EMAIL_LOCAL))
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _iban_ends(text: str, m: re.Match) -> list[int]:
    """Where the number may end: at its country's length, for other codes at any group border, the last first."""
    length = IBAN_LENGTHS.get(m[0][:2])
    if length is None:
        return [m.end(), *(m.start() + i for i in reversed(range(len(m[0]))) if m[0][i] == " ")]
    places = [i for i in range(m.start(), m.end()) if text[i] != " "]
    if len(places) < length or (len(places) > length and places[length] == places[length - 1] + 1):
        return []
    return [places[length - 1] + 1]


def _ibans(text: str) -> list[tuple[int, int]]:
    """Spans of right numbers. A match may hold another number behind its own, so the search goes on at the next place."""
    spans, m = [], IBAN.search(text)
    while m:
        end = next((e for e in _iban_ends(text, m) if mod97(text[m.start() : e])), None)
        if end:
            spans.append((m.start(), end))
        m = IBAN.search(text, end or m.start() + 1)
    return spans


def score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}".lower()
    value = START_SCORE[kind] + 0.2 * any(c in near for c in CUES[kind]) - 0.2 * any(c in near for c in DOUBTS)
    return round(min(1.0, max(0.0, value)), 4)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind in the order of KINDS, then by start."""
    if not text:
        return []
    found, ibans = [], []
    if "." in text or "+" in text or re.search("[0-9]", text):
        found += [("ip", m) for m in IP.finditer(text) if valid_ip(m[0])]
        found += [("card", m) for m in CARD.finditer(text) if valid_card(m[0])]
        if "+" in text:
            found += [("phone", m) for m in PHONE.finditer(text) if valid_phone(m[0])]
        ibans = _ibans(text)
        if "-" in text:
            found += [("ssn", m) for m in SSN.finditer(text) if valid_ssn(m[0])]
    ends = [("email", *span) for span in _emails(text)] + [(kind, m.start(), m.end()) for kind, m in found] + [("iban", *span) for span in ibans]
    spans = [(kind, a, b, score(text, kind, a, b)) for kind, a, b in sorted(ends, key=lambda s: KINDS.index(s[0]))]
    return [s for s in spans if s[0] in BASE_KINDS or s[3] >= MIN_SCORE]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, find, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) with ``find(text)`` run once on every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(t)] for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _ARROW)], names=[id_col, "spans"])

    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("spans", T.ArrayType(SPAN))])
    return source.mapInArrow(run, schema)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scan(docs, find_spans, id_col, text_col)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by ``[kind]``; of overlapping spans the first stands."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])
