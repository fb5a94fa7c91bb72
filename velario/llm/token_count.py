"""Count-only Viterbi over a unigram vocabulary.

The vocabulary is a SentencePiece model file (pieces and scores), whose path is a parameter. A text
is cut into words that start at a space (the metaspace rule: spaces become U+2581, one is put in
front). For each word an Aho-Corasick automaton enumerates every vocabulary match and a dynamic
programme over end positions keeps the best score and the piece count of the best path, never the
pieces. Tie rule of the unigram tokenizer: for one end position the candidates come in order of
their start, and a later one wins only with a strictly higher score, so the longest last piece
wins a tie. A character that no one-character piece covers costs the lowest score less 10 and
becomes one piece for each of its UTF-8 bytes when the vocabulary has byte pieces, otherwise
adjacent unknown characters fuse into one piece.

Word results are kept in a dictionary of bounded size for each worker; a line feed ends a word too
when no piece holds one. Edge cases: null or empty text has 0 tokens; repeated rows give repeated
results; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velario.llm.common import slices

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker keeps.
CACHE_WORDS = 400_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: varints, 4-byte floats and byte strings."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[i]
            out |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return out, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            width = 4 if kind == 5 else 8
            value, i = struct.unpack("<f" if kind == 5 else "<d", data[i : i + width])[0], i + width
        yield key >> 3, value


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) in order of id; types: 1 normal, 2 unknown, 3 control, 6 byte."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out.append((piece[1].decode(), float(piece.get(2, 0.0)), int(piece.get(3, 1))))
    return out


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        normal = [(p, s) for p, s, kind in pieces if kind in (1, 4)]
        self.byte_fallback = sum(kind == 6 for _, _, kind in pieces) == 256
        self.unknown = min((s for _, s in normal), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, s in normal:
            self.automaton.add_word(p, (len(p), s))
        if normal:
            self.automaton.make_automaton()
        self.single = {p for p, _ in normal if len(p) == 1}
        self.lines = not any("\n" in p for p, _ in normal)
        self.cache: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(" ", " " + SPACE).split(" ")
        words = words[1:] if not words[0] else [SPACE + words[0] if not words[0].startswith(SPACE) else words[0], *words[1:]]
        total, cache = 0, self.cache
        for word in words:
            n = cache.get(word)
            if n is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                n = self._split(word)
                if len(word) <= 200:
                    cache[word] = n
            total += n
        return total

    def _split(self, word: str) -> int:
        if SPACE in word[1:]:  # the text holds the metaspace character itself
            cuts = [i for i, c in enumerate(word) if c == SPACE and i] + [len(word)]
            return sum(self._split(word[a:b]) for a, b in zip([0, *cuts], cuts, strict=False))
        if self.lines and self.byte_fallback and "\n" in word:
            parts = word.split("\n")
            return len(parts) - 1 + sum(self.cache.get(p) or self._viterbi(p) for p in parts if p)
        return self._viterbi(word)

    def _viterbi(self, word: str) -> int:
        n = len(word)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if len(self.automaton):
            for last, (length, score) in self.automaton.iter(word):
                ends[last + 1].append((last + 1 - length, score))
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        ended_unknown = [False] * (n + 1)
        for end in range(1, n + 1):
            c = word[end - 1]
            found, score, unknown = -1, 0.0, False
            # The automaton gives longer matches first, so starts ascend.
            for start, s in ends[end]:
                if found < 0 or best[start] + s > score:
                    found, score = start, best[start] + s
            if c not in self.single and (found < 0 or best[end - 1] + self.unknown > score):
                found, score, unknown = end - 1, best[end - 1] + self.unknown, True
            if not unknown:
                pieces = 1
            elif self.byte_fallback:
                pieces = len(c.encode("utf-8", "surrogatepass"))
            else:
                pieces = 0 if ended_unknown[found] else 1
            best[end], count[end], ended_unknown[end] = score, count[found] + pieces, unknown
        return count[n]


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(read_vocabulary(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens, n_chars) of every document; a map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column("__text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([one.count(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], names=[id_col, "n_tokens", "n_chars"]
                )

    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("n_chars", T.LongType())])
    return source.mapInArrow(run, schema)
