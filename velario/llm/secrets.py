"""Secret scans: patterns, and guess-cost dynamic programming on credential values.

The base kinds (assign, access, hex) are patterns with length rules. The method adds kind
``guess``: values after a credential cue (``pwd:``, ``passphrase =``, ``auth ...``) and values that
``assign`` found are segmented at least cost into dictionary words, dates, repeats, keyboard walks
and brute-force characters; a value whose cheapest segmentation costs ``MIN_GUESSES_LOG10`` or more
is hard to guess, so it is a real secret and not a placeholder. After a cue and ``:`` or ``=`` the
cost alone decides; after a cue and bare blanks, where prose goes on, the value must hold a digit
too. Words are ranked by a dictionary: a short list of common passwords, then the words of a public
tokenizer's vocabulary in its order. A value that is itself a cue is none. Behind a value that fails, the search resumes at its start.

Edge cases: null text is empty and has no spans; repeated rows give repeated results; an empty
table gives an empty result; texts are searched whole; positions are code points. Values of any
length are costed whole, in time linear in their length.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from velario.llm.pii import scan

KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]
MIN_GUESSES_LOG10 = 8.0

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CUE = re.compile(r"""(?i:(?<![a-z])(?:pwd|passphrase|credentials?|private_?key|auth|bearer))["']?\x20*([:=\x20])\x20*["']?([^\s"']{6,})""", re.ASCII)
LONE_CUE = re.compile("(?i:pwd|passphrase|credentials?|private_?key|auth|bearer)[:=]*", re.ASCII)

#: A vocabulary file whose whole words, in order of rank, follow WORDS.
DEFAULT_DICTIONARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Common passwords and words, most common first; fixed values.
WORDS = (
    "password 123456 qwerty admin welcome login letmein monkey dragon master secret token changeme example default test "
    "root user guest public private key api access abc love hello football baseball shadow sunshine princess summer winter "
    "spring autumn system server local host company demo sample your here value string none null true false the and with pass word"
).split()


class Ranks(dict):
    """Rank of each word, and the first three letters that a word can have."""

    def __init__(self, words: Iterable[str]):
        super().__init__()
        for w in words:
            self.setdefault(w, len(self) + 1)
        self.starts = {w[:3] for w in self}


RANK = Ranks(WORDS)
#: Letters of the longest and the shortest word that the dictionary gives.
LONGEST, SHORTEST = 24, 4
#: Rows of a keyboard; fixed values.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i + 0.5 * r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
LEET = str.maketrans("013457@$", "oieastas")
DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12][0-9]|3[01]))?)?|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)[0-9]{2}")


def _near(a: str, b: str) -> bool:
    p, q = PLACE.get(a), PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _alphabet(text: str) -> int:
    return sum(n for n, pattern in ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]"), (33, "[^A-Za-z0-9]")) if re.search(pattern, text))


def _runs(n: int, same) -> list[int]:
    """How many places in a row, from each on, ``same`` holds for."""
    out = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        out[i] = out[i + 1] + 1 if same(i) else 0
    return out


def ranked_words(path: str | None) -> Ranks:
    """WORDS first, then the file's tokens that begin a word and are letters only."""
    words = list(WORDS)
    if path:
        with open(path, "rb") as f:
            tokens = [base64.b64decode(line.split()[0]) for line in f]
        words += [t[1:].decode("ascii").lower() for t in tokens if t[:1] == b" " and t[1:].isalpha() and SHORTEST <= len(t) - 1 <= LONGEST]
    return Ranks(words)


def guess_cost(value: str, words: Ranks = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation takes."""
    n = len(value)
    per_char = math.log10(max(10, _alphabet(value)))
    plain = value.lower()
    leet = plain.translate(LEET)
    # Places that equal the one ``unit`` further on; keys near the next one.
    cycles = {unit: _runs(n - unit, lambda i, unit=unit: value[i] == value[i + unit]) for unit in (1, 2, 3, 4) if n >= 2 * unit}
    walks = _runs(n - 1, lambda i: _near(plain[i], plain[i + 1])) if n else []
    best = [0.0] + [math.inf] * n
    for i in range(n):
        pieces = [(i + 1, per_char)]
        known = plain[i : i + 3] in words.starts or leet[i : i + 3] in words.starts
        for j in range(i + 3, min(n, i + LONGEST) + 1) if known else ():
            rank = words.get(plain[i:j])
            if rank:
                pieces.append((j, math.log10(rank + 1) + (0 if value[i:j] == plain[i:j] else math.log10(2))))
            elif leet[i:j] in words:
                pieces.append((j, math.log10(words[leet[i:j]] + 1) + math.log10(4)))
        m = DATE.match(value, i)
        if m:
            pieces.append((m.end(), math.log10(365 * 120)))
        for unit, run in cycles.items():
            times = run[i] // unit + 1 if i < len(run) else 1
            if times >= (3 if unit == 1 else 2):
                pieces.append((i + unit * times, unit * per_char + math.log10(times)))
        if i < n - 1 and walks[i] >= 3:
            pieces.append((i + walks[i] + 1, math.log10(len(PLACE)) + 0.35 * (walks[i] + 1)))
        for j, cost in pieces:
            best[j] = min(best[j], best[i] + cost)
    return best[n]


def find_spans(text: str | None, words: Ranks = RANK) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in the order of KINDS; score: log10 guesses."""
    if not text:
        return []
    low = text.lower()
    found: list[tuple[str, int, int, float]] = []
    values: set[tuple[int, int]] = set()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                cost = guess_cost(m[2], words)
                found.append(("assign", m.start(), m.end(), cost))
                values.add(m.span(2))
                if cost >= MIN_GUESSES_LOG10:
                    found.append(("guess", *m.span(2), cost))
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), guess_cost(m[0], words)) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), guess_cost(m[0], words)) for m in HEX.finditer(text)]
    if any(w in low for w in ("pwd", "passphrase", "credential", "private", "auth", "bearer")):
        m = CUE.search(text)
        while m:
            hard = not LONE_CUE.fullmatch(m[2]) and (m[1] != " " or re.search("[0-9]", m[2])) and (cost := guess_cost(m[2], words)) >= MIN_GUESSES_LOG10
            if hard and m.span(2) not in values:
                found.append(("guess", *m.span(2), cost))
            # A value that fails may be the next cue, as in "auth: Bearer ...".
            m = CUE.search(text, m.end() if hard else m.start(2))
    return sorted(((k, a, b, round(c, 4)) for k, a, b, c in found), key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: str | None = DEFAULT_DICTIONARY) -> DataFrame:
    """(id, spans) of every whole text. The driver reads the dictionary; without one WORDS stand alone."""
    shared = docs.sparkSession.sparkContext.broadcast(ranked_words(dictionary))  # some 25,000 words
    return scan(docs, lambda text: find_spans(text, shared.value), id_col, text_col)
