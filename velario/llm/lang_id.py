"""Language ID: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Character 2- to 4-grams inside words (with a boundary mark) are hashed into ``BUCKETS`` rows of an
embedding table; a text is the mean of its rows, and a linear softmax gives the language. The
table and the softmax are trained by stochastic gradient descent in numpy on a sample of at most
about ``MAX_TRAIN_ROWS`` labelled rows (one for each language where there are more languages),
spread evenly over all languages and picked by a hash of the id. Temperature and rejection threshold come from a calibration fifth of that sample.
Because the mean and the softmax are linear, prediction sums one row of ``embedding @ weights``
for each n-gram of the whole text.

Nothing but the text is an input of a prediction. Edge cases: text that is null or has no letter
is ``und`` with score 0 and rejected; without any labelled row every text is ``und``; rows with a
null language are predicted, not learned from; a null id is not held out and not learned from;
repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velario.llm.common import bounded_batches, slices

BUCKETS = 8192
DIMENSION = 16
#: Bound of the training sample, in rows over all languages.
MAX_TRAIN_ROWS = 4000
#: Gradient steps of a training, in at most EPOCHS passes over the sample.
STEPS, EPOCHS = 1500, 30
BATCH = 64
SEED = 11
#: Label counts with more rows are joined without a broadcast.
BROADCAST_LABELS = 10_000
#: Share of right calibration texts that the rejection threshold may cost, and its upper bound.
REJECT_SHARE, REJECT_CEILING = 0.001, 0.5
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its text's index, letters in each text)."""
    lowered = [(t or "").lower() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in lowered])])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
    n_letters = np.bincount(owner[letter], minlength=len(texts))
    c = np.where(letter, points, np.uint32(32))
    buckets, owners = [], []
    for n in (2, 3, 4):
        if len(c) < n:
            continue
        m = len(c) - n + 1
        valid = owner[:m] == owner[n - 1 :]
        if n == 2:
            valid &= letter[:m] | letter[1:]
        for k in range(1, n - 1):
            valid &= letter[k : k + m]
        h = c[:m] * np.uint32(31) + np.uint32(n)
        for k in range(1, n):
            h = (h ^ c[k : k + m]) * np.uint32(0x01000193 * (2 * k + 1) & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2654435761)
        buckets.append((h >> np.uint32(32 - 13))[valid])
        owners.append(owner[:m][valid])
    if not buckets:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32), n_letters
    return np.concatenate(buckets), np.concatenate(owners), n_letters


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        h, owner, letters = grams(texts)
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        sums = [np.bincount(owner, weights=self.table[:, k][h], minlength=len(texts)) / n for k in range(len(self.languages))]
        return (np.stack(sums, 1) if sums else np.zeros((len(texts), 0))) + self.bias, letters

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, calibrated probability, rejected) of each text."""
        logits, letters = self.logits(texts)
        if not self.languages:
            return [(UNKNOWN, 0.0, True)] * len(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        out = []
        for i, k in enumerate(best):
            if not letters[i]:
                out.append((UNKNOWN, 0.0, True))
            else:
                out.append((self.languages[k], float(p[i, k]), bool(p[i, k] < self.threshold)))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def views(text: str) -> list[str]:
    """What is learned from one text: all of it, a line's worth and a few words."""
    n = len(text)
    return [text, text[n // 3 : n // 3 + 60], text[n // 2 : n // 2 + 20]]


def fit(rows: list[tuple[str, bool, np.ndarray, np.ndarray]], dimension: int = DIMENSION, steps: int = STEPS, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """rows: (language, for calibration, bucket indices, shares of the n-grams), in a fixed order."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model()
    at = {name: k for k, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    train = [r for r in rows if not r[1]] or rows
    embedding = rng.uniform(-1, 1, (BUCKETS, dimension)) / dimension
    weights, bias = np.zeros((dimension, len(languages))), np.zeros(len(languages))

    each = -(-len(train) // BATCH)
    epochs = max(1, min(epochs, -(-steps // each)))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(train))
        for start in range(0, len(train), BATCH):
            part = [train[i] for i in order[start : start + BATCH]]
            x = np.zeros((len(part), BUCKETS))
            x[np.repeat(np.arange(len(part)), [len(r[2]) for r in part]), np.concatenate([r[2] for r in part])] = np.concatenate([r[3] for r in part])
            rate = 1 - done / steps
            done += 1
            hidden = x @ embedding
            error = softmax(hidden @ weights + bias)
            error[np.arange(len(part)), [at[r[0]] for r in part]] -= 1
            error /= len(part)
            back = error @ weights.T
            # Steps are scaled by what they act on, so short and long texts, whose shares differ
            # a hundredfold, learn at one pace and neither diverges.
            weights -= 2 * rate / (0.1 + (hidden**2).sum(1).mean()) * (hidden.T @ error)
            bias -= 0.1 * rate * error.sum(0)
            scaled = x / np.maximum((x**2).sum(1, keepdims=True), 1e-12)
            embedding -= 4 * rate / (1 + (weights**2).sum()) * (scaled.T @ back)
    model = Model(languages, embedding @ weights, bias)
    calibrate(model, [r for r in rows if r[1]] or rows, at)
    return model


def calibrate(model: Model, rows, at: dict[str, int]) -> None:
    logits = np.array([share @ model.table[index] + model.bias for _, _, index, share in rows])
    truth = np.array([at[r[0]] for r in rows])
    grid = np.geomspace(0.25, 16, 49)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(rows)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    model.threshold = float(min(REJECT_CEILING, right[int(REJECT_SHARE * len(right))])) if len(right) else 0.0


def picked(id_: Column, n: Column, quota: int) -> Column:
    """About ``quota`` of n rows by a hash of the id, whose full 64 bits count: right for any n."""
    place = (F.xxhash64(F.lit(SEED), id_).cast("double") / F.lit(2.0**64)) + 0.5
    return place * n < quota


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on labelled rows that are not held out; n-gram shares are made on the executors."""
    bounded_batches(docs.sparkSession)
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    usable = docs.where((crc % 5 != 0) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    counts = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    languages = counts.count()
    if not languages:
        return Model()
    counts = counts.withColumnRenamed("label", "l")
    rows = usable.join(F.broadcast(counts) if languages <= BROADCAST_LABELS else counts, F.col("label") == F.col("l"))
    sample = rows.where(picked(F.col("id"), F.col("n"), max(1, max_rows // languages))).withColumn("order", F.xxhash64(F.lit(SEED + 1), "id"))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {"label": [], "order": [], "view": [], "index": [], "share": []}
                for label, order, text in zip(*(part.column(c).to_pylist() for c in ("label", "order", "text")), strict=True):
                    for k, view in enumerate(views(text or "")):
                        h, _, _ = grams([view])
                        if len(h):
                            index, n = np.unique(h, return_counts=True)
                            values = (label, order, k, index.astype(np.uint16).tobytes(), (n / n.sum()).astype(np.float32).tobytes())
                            for name, value in zip(out, values, strict=True):
                                out[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out["label"], pa.string()), pa.array(out["order"], pa.int64()), pa.array(out["view"], pa.int32()), pa.array(out["index"], pa.binary()), pa.array(out["share"], pa.binary())], names=list(out))

    made = sample.select("label", "order", "text").mapInArrow(shares, "label string, order long, view int, index binary, share binary").collect()
    rows = sorted((r["label"], r["order"], r["view"], bytes(r["index"]), bytes(r["share"])) for r in made)
    return fit([(label, order % 5 == 0, np.frombuffer(i, np.uint16), np.frombuffer(s, np.float32)) for label, order, _, i, s in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every whole text; a map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = shared.value.predict(part.column("__text").to_pylist())
                columns = [pa.array([f[k] for f in found], kind) for k, kind in ((0, pa.string()), (1, pa.float64()), (2, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, "lang_pred", "score", "rejected"])

    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return source.mapInArrow(run, T.StructType([source.schema[0], *fields]))


def filter_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that the model rejects; every column and row order of a task stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = shared.value.predict(part.column(text_col).to_pylist())
                yield part.filter(pa.array([not f[2] for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
