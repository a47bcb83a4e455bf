"""Operator 12: a quality classifier, ridge regression on random Fourier features with isotonic calibration.

Each whole text is measured by the statistics named in STATISTICS: sizes, shares of kinds of characters, repetition of words
and lines, lengths of words and sentences. Standardised, they pass through WAVES cosines of random frequencies, whose products approximate a
Gaussian kernel of width WIDTH (1 for statistics one standard deviation apart in each). Tasks sum the normal equations of their rows, fold by fold; the sums of tasks are added in
Spark, and the driver solves systems of WAVES + 1 unknowns. Each fold is scored by the ridge fitted without it; these scores, counted in
BINS steps, are made monotone in the share of label 1 by pooling adjacent violators. All labelled rows take part: nothing is sampled.

Null and empty texts have the statistics of an empty text and are scored as such. Rows without an id are scored and never learned from.
Rows that repeat an id are scored each, and learned from each; a label given twice counts once, and labels that
disagree count as 0. Without labels of both kinds the score is the share of label 1 (0 without labels). Empty tables give empty
results. Extra columns are kept; the added ``score`` and ``predicted`` replace columns of those names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.llm.common import materialize, slices, text_buffer

WAVES = 160
WIDTH = 3.0
RIDGE = 1e-3
FOLDS = 4
BINS = 1024
CUT = 0.7

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "letters", "upper", "digits", "spaces", "points", "commas", "marks", "brackets", "bars", "symbols",
    "beyond_ascii", "word_length", "word_length_spread", "long_words", "distinct_words", "top_word", "repeats_next", "capital_words", "upper_words",
    "marked_words", "words_a_line", "distinct_lines", "words_a_sentence", "ends_in_point", "byte_entropy",
)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BREAKS = re.compile(rb"[.!?]+")
# The kind of each byte. Bytes from 128 on are parts of letters.
_KINDS = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)),
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" \t\n\v\f\r", "points": b".", "commas": b",;:", "marks": b"!?",
    "brackets": b"()[]{}<>", "bars": b"|", "symbols": b"#$%&*+/=@\\^_~`", "beyond_ascii": bytes(range(128, 256)),
}
_KIND = np.array([[b in kind for b in range(256)] for kind in _KINDS.values()], float)
_MARKED = re.compile(rb"[#$%&*+/=@\\^_~`|!]")


def statistics(text: bytes) -> list[float]:
    """STATISTICS of one text."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / len(text)
    words = _WORD.findall(text)
    lines = [x for x in text.split(b"\n") if x]
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    next_same = sum(map(bytes.__eq__, words, words[1:]))
    sentences = max(1, len(_BREAKS.findall(text)))
    held = share[share > 0]
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), *(_KIND @ share), lengths.mean(), lengths.std(), (lengths > 20).mean(),
        len(seen) / n, max(seen.values(), default=0) / n, next_same / n, sum(w[:1].isupper() for w in words) / n, sum(w.isupper() for w in words) / n,
        sum(_MARKED.search(w) is not None for w in words) / n, np.log1p(len(words) / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words) / sentences), float(text.rstrip()[-1:] in (b".", b"!", b"?")), -float(held @ np.log2(held)),
    ]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__stats``, the statistics of the whole text."""
    schema, place = StructType([*docs.schema, StructField("__stats", ArrayType(DoubleType()))]), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            raw, bounds = text_buffer(batch.column(place))
            whole = raw.tobytes()
            found = [statistics(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def stack(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), len(STATISTICS))


@dataclass
class Waves:
    """Standardised statistics to cosines of random frequencies and phases, and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    waves: int = WAVES

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(12)
        frequency = rng.normal(size=(len(STATISTICS), self.waves)) / (WIDTH * np.sqrt(len(STATISTICS)))
        phase = rng.uniform(0, 2 * np.pi, self.waves)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack((np.sqrt(2 / self.waves) * np.cos(z @ frequency + phase), np.ones(len(x))))


def fit_ridge(gram: np.ndarray, moment: np.ndarray, n: float) -> np.ndarray:
    """Weights from the sums z'z and z'y; the constant, last, is not shrunk."""
    penalty = np.full(len(gram), RIDGE * max(n, 1.0))
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), moment)


def pooled(total: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Per bin the share of ones, made non-decreasing by pooling adjacent violators; empty bins go with the one before."""
    blocks: list[list[float]] = []
    for n, y in zip(total.tolist(), ones.tolist(), strict=True):
        blocks.append([y, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * max(blocks[-1][1], 1e-12) >= blocks[-1][0] * max(blocks[-2][1], 1e-12) and (blocks[-1][1] or blocks[-2][1]):
            y1, n1, k1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + n1, blocks[-1][2] + k1]
    return np.concatenate([np.full(k, y / n if n else 0.0) for y, n, k in blocks])


@dataclass
class Model:
    waves: Waves | None
    weights: np.ndarray
    steps: np.ndarray
    share: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.waves is None:
            return np.full(len(x), self.share)
        raw = self.waves(x) @ self.weights
        return calibrated(raw, self.steps)


def bin_of(raw: np.ndarray) -> np.ndarray:
    """Ridge scores lie around 0 and 1; the bins span -0.5 to 1.5, the outer ones take the rest."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def calibrated(raw: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The calibrated share, interpolated between middles of bins."""
    return np.interp((raw + 0.5) / 2 * BINS - 0.5, np.arange(BINS), steps)


def sums(rows: DataFrame, run, width: int) -> np.ndarray:
    """What tasks sum up in arrays of ``width``, added over tasks: one row a cell, pre-summed in each task."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += run(batch)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["cell", "v"])

    found = rows.mapInArrow(cells, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width)
    out[found["cell"].to_numpy()] = found["v"].to_numpy()
    return out


def fit(measured: DataFrame, labels: DataFrame, training: Column | None = None, key: str = "doc_id", label: str = "quality", waves: int = WAVES) -> Model:
    """Learn from the rows of ``measured`` (id, __stats) whose label the condition on the labels' id lets through."""
    training = F.lit(True) if training is None else training
    clean = labels.where(training & F.col(key).isNotNull() & F.col(label).isNotNull())
    one = clean.groupBy(key).agg((F.min(label) > 0).cast("double").alias("y"))
    fold = F.pmod(F.xxhash64(key, F.lit(12)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = materialize(measured.select(key, F.col("__stats").alias("x")).join(one, key).select("x", "y", fold))
    d = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = stack(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        return np.concatenate(([len(y), y.sum()], x.sum(0), (x * x).sum(0)))

    first = sums(rows, moments, 2 + 2 * d)
    n, ones = first[:2]
    if not ones or ones == n:
        return Model(None, np.zeros(0), np.zeros(0), float(ones / n) if n else 0.0)
    mean = first[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(first[2 + d :] / n - mean**2, 0))
    made = Waves(mean, np.where(scale > 1e-9, scale, 1.0), waves)
    size = waves + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y, f = made(stack(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        out = np.zeros((FOLDS, size + 2, size))
        for k in np.unique(f):
            part, own = z[f == k], y[f == k]
            out[k, :size], out[k, size], out[k, size + 1, 0] = part.T @ part, part.T @ own, len(own)
        return out.ravel()

    by_fold = sums(rows, equations, FOLDS * (size + 2) * size).reshape(FOLDS, size + 2, size)
    solve = lambda a: fit_ridge(a[:size], a[size], a[size + 1, 0])
    weights = solve(by_fold.sum(0))
    without = [solve(by_fold.sum(0) - by_fold[k]) for k in range(FOLDS)]

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        z, y, f = made(stack(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        raw = np.sum(z * np.array(without)[f], axis=1)
        at = bin_of(raw)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)))

    counted = sums(rows, binned, 2 * BINS)
    return Model(made, weights, pooled(counted[:BINS], counted[BINS:]), float(ones / n))


def apply(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with ``score`` and ``predicted`` instead of ``__stats``."""
    kept = measured.drop("score", "predicted")
    place = kept.columns.index("__stats")
    schema = StructType([*kept.drop("__stats").schema, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.clip(model(stack(batch.column(place))), 0, 1)
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p, pa.float64())], names=schema.names)

    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def score(docs: DataFrame, labels: DataFrame, training: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from CUT)."""
    stats = materialize(measure(docs.select(key, text), text).drop(text))
    return apply(measure(docs, text), fit(stats, labels, training, key))
