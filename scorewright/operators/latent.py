"""Latent semantic vectors of texts: a truncated singular value decomposition of their TF-IDF matrix by block Krylov iteration.

The matrix stays in Spark, a row for each text with its term numbers and weights. One iteration multiplies it with a dense matrix of (terms x
width) numbers, and with its own transpose: a task adds up (terms x width) numbers over its rows, and only these sums leave it, in
blocks of terms. The driver orthogonalises that tall matrix (QR), and in the end solves the small problem in the span of all iterates, for which tasks add up its (width x width)
numbers only. What is broadcast and what comes back is bounded by the terms and the width, and what is shuffled also by the tasks that run at a time,
whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed

#: Terms at most (those in the most texts), columns beside those asked for, terms of a block of sums.
TERMS, EXTRA, BLOCK = 20_000, 10, 1024
TOKEN = r"[\p{L}\p{N}_]{2,}"


@dataclass
class Space:
    """rows: (key, at, w) of each text with a term; terms: (term, number, idf); directions (terms x k) and singular values, descending."""

    rows: DataFrame
    terms: DataFrame
    directions: np.ndarray
    values: np.ndarray


def weighed(texts: DataFrame, key: str, text: str, terms: int = TERMS, token: str = TOKEN) -> tuple[DataFrame, DataFrame, int]:
    """(key, at, w) and (term, number, idf): smooth idf ln((1 + n) / (1 + df)) + 1 times counts, each text of length 1; number of terms.

    Terms are the `terms` most frequent by texts that have them, ties in alphabetical order; others don't count.
    """
    n = texts.count()
    counts = texts.select(F.col(key).alias("_k"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(0))).alias("term")).groupBy("_k", "term").agg(F.count("*").alias("tf"))
    top = counts.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(terms)
    names = top.collect()  # at most `terms` rows
    spark = texts.sparkSession
    table = spark.createDataFrame([(r["term"], i, r["df"]) for i, r in enumerate(names)], "term string, number int, df long")
    table = table.select("term", "number", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    one = F.struct(F.col("number").alias("at"), (F.col("tf") * F.col("idf")).alias("w"))
    rows = counts.join(F.broadcast(table), "term").groupBy("_k").agg(F.array_sort(F.collect_list(one)).alias("x"))  # a text's different terms
    length = F.sqrt(F.aggregate("x.w", F.lit(0.0), lambda s, w: s + w * w))
    rows = rows.select("_k", F.explode(F.array(F.struct("x", length.alias("length")))).alias("r"))  # a generator: in the lambda below the length would be added up anew for each term
    return rows.select(F.col("_k").alias(key), F.col("r.x.at").alias("at"), F.transform("r.x.w", lambda w: w / F.col("r.length")).alias("w")), table, len(names)


def _sparse(b: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and weight of every entry of a batch."""
    sizes = np.diff(b.column(first).offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), sizes), b.column(first).flatten().to_numpy(), b.column(first + 1).flatten().to_numpy()


def _times(b: pa.RecordBatch, first: int, m: np.ndarray) -> np.ndarray:
    """The rows of a batch times a matrix."""
    row, at, w = _sparse(b, first)
    out = np.zeros((b.num_rows, m.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[starts]] = np.add.reduceat(m[at] * w[:, None], starts)
    return out


def _gram(shared):
    """(block, sums): A^T (A m) of a task's rows, in blocks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = None
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], names=part.schema.names)
                row, at, w = _sparse(part, 0)
                if not len(row):
                    continue
                y = _times(part, 0, m)
                order = np.argsort(at, kind="stable")
                at, add = at[order], (y[row] * w[:, None])[order]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                total = np.zeros_like(m) if total is None else total
                total[at[starts]] += np.add.reduceat(add, starts)
        if total is not None:
            blocks = range(0, len(total), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([s // BLOCK for s in blocks], pa.int32()), pa.array([total[s : s + BLOCK].tobytes() for s in blocks], pa.binary())], names=["block", "sums"])

    return run


def _square(shared):
    """(sums): (A m)^T (A m) of a task's rows, width x width numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total = np.zeros((m.shape[1], m.shape[1]))
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                y = _times(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], names=part.schema.names), 0, m)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blocks of equal number within a task."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(raw, np.float64)
            total[k] = total[k] + x if k in total else x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])


def decomposed(texts: DataFrame, key: str, text: str, k: int, rounds: int = 4, terms: int = TERMS, seed: int = 1, token: str = TOKEN) -> Space:
    """The k greatest singular values and directions of the TF-IDF matrix of texts; fewer where it has not so many rows or terms."""
    rows, table, width = weighed(texts, key, text, terms, token)
    rows = checkpointed(rows)
    size = min(k + EXTRA, width)
    if not width:
        return Space(rows, table, np.zeros((0, 0)), np.zeros(0))
    context = rows.sparkSession.sparkContext
    few = rows.select("at", "w").coalesce(context.defaultParallelism)  # each task gives a whole matrix of sums: as many as run at a time

    def gram(m: np.ndarray) -> np.ndarray:
        shared = context.broadcast(m)  # terms x width numbers
        sums = few.mapInArrow(_gram(shared), "block int, sums binary").repartition("block").mapInArrow(_added, "block int, sums binary").collect()  # as many
        shared.destroy()
        return np.concatenate([np.frombuffer(bytes(r["sums"]), np.float64).reshape(-1, m.shape[1]) for r in sorted(sums, key=lambda r: r["block"])])

    iterates = [np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]]
    for _ in range(rounds):
        iterates.append(np.linalg.qr(gram(iterates[-1]))[0])
    m = np.linalg.qr(np.concatenate(iterates, axis=1))[0]
    shared = context.broadcast(m)
    parts = few.mapInArrow(_square(shared), "sums binary").collect()  # width x width numbers of each task
    shared.destroy()
    square, turn = np.linalg.eigh(sum((np.frombuffer(bytes(r["sums"]), np.float64).reshape(m.shape[1], -1) for r in parts), np.zeros((m.shape[1],) * 2)))
    order = np.argsort(-square)[:k]
    directions = m @ turn[:, order]
    flip = np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    return Space(rows, table, directions * flip, np.sqrt(np.maximum(square[order], 0)))


def vectors(s: Space, key: str) -> DataFrame:
    """(key, vector): each text's row times the directions, of length 1; texts without a term of the space are left out, as are those at its origin."""
    shared = s.rows.sparkSession.sparkContext.broadcast(s.directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _times(b, 1, shared.value)
            n = np.sqrt((v * v).sum(1))
            keep = np.flatnonzero(n > 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([x.tolist() for x in v[keep] / n[keep, None]], pa.list_(pa.float64()))], names=[key, "vector"])

    kind = s.rows.schema[key].dataType.simpleString()
    return s.rows.select(key, "at", "w").mapInArrow(run, f"`{key}` {kind}, vector array<double>")
