"""Similarity of names: the normalised indel ratio, 200 * LCS / (length a + length b).

``indel_ratio`` is a Column for composing with joins and filters: pairs go to Python in Arrow
batches. ``indel_ratio_py`` is the same measure for Python code that holds a block of names; both
use one bit-parallel LCS, linear in the longer name for names of usual length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from velario.functions.names import normalize_org


def indel_ratio(a: Column, b: Column) -> Column:
    """Null where one of the two is null."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio_py(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def sorted_tokens(a: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(a, r"(?U)\s+"), lambda t: t != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def may_be_same(a: Column, b: Column) -> Column:
    """Names (normalised) worth a merge suggestion: a prefix of 4 or more, or a near spelling."""
    ratio = token_sort_ratio(a, b)
    return F.when(is_prefix(a, b), True).when(may_be_near(a, b), (ratio >= 82) & (ratio < 95)).otherwise(False)


def is_prefix(a: Column, b: Column) -> Column:
    return (F.least(F.length(a), F.length(b)) >= 4) & (a != b) & (a.startswith(b) | b.startswith(a))


def may_be_near(a: Column, b: Column) -> Column:
    """What a ratio of 82 needs at least, by lengths alone: sorting tokens only takes blanks away."""
    short = F.least(F.length(a), F.length(b))
    return (a != b) & (short >= 6) & (short * 200 >= (F.length(a) + F.length(b)) * 82)


def may_be_same_names(a: Column, b: Column) -> Column:
    return may_be_same(normalize_org(a), normalize_org(b))


class Pattern:
    """One name to be compared with many: its character table is made once."""

    def __init__(self, name: str):
        self.name, self.size, self.places = name, len(name), {}
        for i, c in enumerate(name):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.full = (1 << self.size) - 1

    def ratio(self, other: str) -> float:
        if other == self.name:
            return 100.0
        if not other or not self.size:
            return 0.0
        row, full, places = self.full, self.full, self.places
        for c in other:
            hit = row & places.get(c, 0)
            row = (row + hit | row - hit) & full
        return 200.0 * (self.size - row.bit_count()) / (self.size + len(other))

    def may_reach(self, other: str, ratio: float) -> bool:
        """What lengths alone allow: two names share the shorter one's characters at most."""
        return 200 * min(self.size, len(other)) >= ratio * (self.size + len(other))


class NameBlock:
    """Many names to be compared with one at a time: a step of the LCS goes over all of them at once."""

    def __init__(self, names: list[str]):
        self.names, self.sizes = names, np.array([len(n) for n in names], np.int64)
        letters = sorted(set("".join(names)))
        self.code = {c: i + 1 for i, c in enumerate(letters)}
        self.codes = np.zeros((max(map(len, names), default=0), len(names)), np.int64)
        for k, name in enumerate(names):
            self.codes[: len(name), k] = [self.code[c] for c in name]

    def ratios(self, name: str) -> np.ndarray:
        """The indel ratio of ``name`` with every name of the block."""
        pattern = Pattern(name)
        if not 0 < pattern.size < 64:
            return np.array([pattern.ratio(n) for n in self.names])
        places = np.zeros(len(self.code) + 1, np.uint64)
        for c, bits in pattern.places.items():
            if c in self.code:
                places[self.code[c]] = bits
        full = np.uint64(pattern.full)
        row = np.full(len(self.names), full)
        for step in self.codes:  # shorter names go on with code 0, which changes nothing
            hit = row & places[step]
            row = (row + hit | row - hit) & full
        return 200.0 * (pattern.size - np.bitwise_count(row).astype(np.int64)) / (pattern.size + self.sizes)


class NearNames:
    """Names added one by one, and which of them may reach a ratio with another name: none that does is left out.

    A ratio allows so many indels, by lengths. A name is cut into one piece more than any name allows
    it, so with ``most`` indels to another name, of any ``most`` + 1 of its pieces one stands in that
    name, moved by the indels ahead of it at most. The pieces with the fewest names are looked up.
    """

    def __init__(self, ratio: float):
        self.ratio = ratio
        self.count = 0
        self.by_size: dict[int, tuple[list[tuple[int, int]], list[dict[str, list[int]]]]] = {}
        self.whole = ratio <= 0 or ratio > 100  # nothing to go by: all are given

    def _most(self, m: int, n: int) -> int:
        """Indels between names of these lengths that the ratio allows; rounding only lets more through."""
        return int((m + n) * (100 - self.ratio) / 100 + 1e-6)

    def _pieces(self, n: int) -> list[tuple[int, int]]:
        longest = int(n * (200 - self.ratio) / self.ratio + 1e-6)
        k = self._most(longest, n) + 1
        # Names of a block begin alike: the first piece has those two characters beside its share.
        cuts = [0, *(2 + (n - 2) * i // k for i in range(1, k)), n] if n > k + 2 else [*range(max(n, 1)), n]
        return list(zip(cuts, cuts[1:]))

    def add(self, name: str) -> None:
        place, n = self.count, len(name)
        self.count += 1
        if self.whole:
            return
        if n not in self.by_size:
            pieces = self._pieces(n)
            self.by_size[n] = pieces, [{} for _ in pieces]
        pieces, lists = self.by_size[n]
        for (a, b), found in zip(pieces, lists):
            found.setdefault(name[a:b], []).append(place)

    def places(self, name: str) -> list[int]:
        """Places of the added names that may reach the ratio, in the order in which they were added."""
        if self.whole:
            return list(range(self.count))
        out: set[int] = set()
        m = len(name)
        for n, (pieces, lists) in self.by_size.items():
            most = self._most(m, n)
            if abs(m - n) > most:
                continue
            fewer, more = (most + n - m) // 2, (most + m - n) // 2  # characters that go from the other name, that come
            met = []
            for (a, b), found in zip(pieces, lists):
                moved = {name[at : at + b - a] for at in range(max(0, a - fewer), min(m - b + a, a + more) + 1)}
                met.append([x for s in moved if (x := found.get(s))])
            if len(met) > most + 1:
                met = sorted(met, key=lambda own: sum(map(len, own)))[: most + 1]
            elif len(met) <= most:  # a short name with fewer characters than pieces
                met = [list(found.values()) for found in lists[:1]]
            for own in met:
                for x in own:
                    out.update(x)
        return sorted(out)


def indel_ratio_py(a: str, b: str) -> float:
    return Pattern(a).ratio(b)


def tokens_sorted(a: str) -> str:
    return " ".join(sorted(a.split()))


def token_sort_ratio_py(a: str, b: str) -> float:
    return indel_ratio_py(tokens_sorted(a), tokens_sorted(b))
