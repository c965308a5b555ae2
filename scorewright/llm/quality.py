"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of the whole text (lengths, character classes, repetition) are standardised; cosines of random projections
approximate a Gaussian kernel. Each partition sums its part of the normal equations; their sum gives the ridge
weights. Isotonic regression (pool adjacent violators) maps scores to probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import batch, checkpointed

#: Labelled rows used at most; random features; ridge; partitions that sum normal equations.
SAMPLE, FEATURES, RIDGE, SUMS = 20_000, 256, 1e-3, 8
NAMES = ("log_chars", "log_words", "word_length", "long_words", "short_words", "unique_words", "next_repeats", "unique_pairs", "top_word", "upper", "digits", "marks", "odd_marks", "bars", "blank", "other_bytes", "line_words", "unique_lines", "end_marks")
STATS = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
SUM = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])
ROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def statistics(text: str | None) -> list[float]:
    """One number for each of NAMES; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    lens = np.fromiter(map(len, words), np.int64, n)
    codes = np.fromiter(map(zlib.crc32, words), np.int64, n)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    ends = c[ord(".")] + c[ord(",")]
    unique, often = np.unique(codes, return_counts=True)
    pairs = len(np.unique(codes[:-1] * 4294967291 + codes[1:])) / (n - 1) if n > 1 else 1.0
    repeats = float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0
    return [
        np.log1p(size), np.log1p(n), float(lens.mean()), float((lens > 12).mean()), float((lens < 4).mean()), len(unique) / n, repeats, pairs, often.max() / n,
        c[65:91].sum() / size, c[48:58].sum() / size, marks / size, (marks - ends) / size, c[ord("|")] / size, (c[32] + c[9:14].sum()) / size, c[128:].sum() / size,
        np.log1p(n / len(lines)), len(set(lines)) / len(lines), ends / n,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(STATS, b.column(0).to_pylist(), [[float(v) for v in statistics(t.as_py())] for t in b.column(1)])


@dataclass
class Kernel:
    """Standardisation and random Fourier features."""

    mean: np.ndarray
    scale: np.ndarray
    seed: int = 11

    def features(self, x: np.ndarray) -> np.ndarray:
        d, rng = x.shape[1], np.random.default_rng(self.seed)
        w, phase = rng.normal(0, np.sqrt(1 / d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + phase), np.ones((len(x), 1))])


def pool(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: block starts (scores) and values."""
    blocks: list[list[float]] = []
    u, inverse = np.unique(score, return_inverse=True)
    sums, counts = np.bincount(inverse, label), np.bincount(inverse)
    for s, y, n in zip(u.tolist(), sums.tolist(), counts.tolist(), strict=True):
        blocks.append([s, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, y, n = blocks.pop()
            blocks[-1][1] += y
            blocks[-1][2] += n
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray
    starts: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated by interpolation between block starts, in 0..1."""
        return np.clip(np.interp(self.raw(x), self.starts, self.values), 0, 1)


def _normal(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = shared.value
        a, b, n = np.zeros((FEATURES + 1,) * 2), np.zeros(FEATURES + 1), 0
        for rows in batches:
            if not rows.num_rows:
                continue
            z, y = kernel.features(np.array(rows.column(0).to_pylist())), np.array(rows.column(1).to_pylist(), float)
            a += z.T @ z
            b += z.T @ y
            n += len(y)
        yield batch(SUM, [a.tobytes()], [b.tobytes()], [n])

    return run


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most about `sample` labelled rows chosen by a hash of doc_id, among those where `train` holds.

    Rows without quality label, document or doc_id are left out; of repeated labels the largest counts. Without any
    label every score is 0.5.
    """
    spark = docs.sparkSession
    own = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(train)
    total = own.count()
    rate = F.lit(int(min(1.0, sample / max(1, total)) * (1 << 30)))
    chosen = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate).groupBy("doc_id").agg(F.max("quality").alias("quality")).limit(2 * sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id", "left_semi")
    x = texts.mapInArrow(_statistics, "doc_id long, x array<double>").join(F.broadcast(chosen), "doc_id").select("x", "quality")
    x = checkpointed(x.repartition(SUMS))  # at most 2 x sample rows of a few numbers; the scan keeps its own tasks
    moments = x.select(*(f(F.element_at("x", i + 1)).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(len(NAMES)))).first()
    if moments[0] is None:
        kernel = Kernel(np.zeros(len(NAMES)), np.ones(len(NAMES)))
        return Model(kernel, np.zeros(FEATURES + 1), np.zeros(1), np.array([0.5]))
    m = np.array(moments[:], float)
    kernel = Kernel(m[: len(NAMES)], 1 / np.maximum(m[len(NAMES) :], 1e-6))
    sums = x.mapInArrow(_normal(spark.sparkContext.broadcast(kernel)), "a binary, b binary, n long").collect()
    a = sum(np.frombuffer(r["a"]).reshape(FEATURES + 1, -1) for r in sums)
    b, n = sum(np.frombuffer(r["b"]) for r in sums), sum(r["n"] for r in sums)
    weights = np.linalg.solve(a + RIDGE * n / FEATURES * np.eye(FEATURES + 1), b)
    rows = x.collect()
    raw = kernel.features(np.array([r["x"] for r in rows])) @ weights
    return Model(kernel, weights, *pool(raw, np.array([r["quality"] for r in rows], float)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            if b.num_rows:
                s = model.scores(np.array([statistics(t.as_py()) for t in b.column(1)]))
                yield batch(ROW, b.column(0).to_pylist(), s, (s >= 0.5).astype(np.int32))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: quality 1 likelier), predicted (score >= 0.5) for every row, from whole texts.

    Null and empty texts get the score of all-zero statistics. Repeated rows and null ids are kept; an empty table gives
    an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double, predicted int")
