"""Plain single-process versions of the training-data operators."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def chat(rows):
    """rows: (conv_id, turn, role, text) -> conv_id -> (n_turns, turns, loss_chars, loss)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role, text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def substring(docs, window=50):
    """docs: id -> text; windows that also start in a smaller id's text lose their words."""
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    seen: dict[tuple, int] = {}
    out = {}
    for i in sorted(words):
        w = words[i]
        keep = [True] * len(w)
        own = []
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if seen.get(key, i) < i:
                keep[p : p + window] = [False] * window
            own.append(key)
        for key in own:
            seen.setdefault(key, i)
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[i] = (len(w), len(w) - len(kept), sha(" ".join(kept)))
    return out


def near(docs, width=5, percent=75):
    """docs: id -> text; every pair is compared."""
    sets, parent = {}, {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in docs.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = WORD.findall(low)
        sets[i] = {tuple(w[p : p + width]) for p in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                lo, hi = sorted((len(sets[a]), len(sets[b])))
                if lo * 100 >= hi * percent:
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def pii(text: str):
    text, out = text or "", []
    only = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only(s)) <= 19 and luhn(only(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only(s)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return out


def secrets(text: str):
    text, out = text or "", []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.ASCII) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def distance_in(item: str, text: str) -> int:
    """Least edit distance of ``item`` to any substring of ``text``, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best
