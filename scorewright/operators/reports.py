"""Report building blocks: aliases, partial means, resume, upsert, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(name: str, aliases: dict[str, str]) -> Column:
    """The canonical form of a name; unknown names stay."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[F.col(name)], F.col(name))


def mean_present(dims: list[str]) -> Column:
    """Mean of the values that are not null; null if none is."""
    there = F.filter(F.array(*(F.col(d).cast("double") for d in dims)), lambda x: x.isNotNull())
    return F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(there), F.lit(0))


def pending(work: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Work whose key is not done yet."""
    return work.join(done.select(*key), key, "left_anti")


def upsert(old: DataFrame, fresh: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Old rows with the values of fresh ones of the same key; `redone` marks those."""
    new = fresh.select(*key, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    rows = old.join(new, key, "left")
    return rows.select(*key, *(F.coalesce(f"_{v}", v).alias(v) for v in values), F.coalesce("_there", F.lit(False)).alias("redone"))


#: Mixing multiplier below 2^27, so that products of 32-bit numbers fit 64 bits in any engine, and the numbers below 2^32.
MIX, WORD = 73244475, (1 << 32) - 1
#: A uniform 32-bit number counts the thresholds that it reaches: a Poisson variable of mean 1.
POISSON = [round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * (1 << 32)) for k in range(10)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A scrambled 32-bit number for each one, by steps that any SQL engine has."""
    x = x.astype(np.uint64)
    for _ in range(2):
        x = (x ^ x >> np.uint64(16)) * np.uint64(MIX) & np.uint64(WORD)
    return x ^ x >> np.uint64(16)


#: Groups whose sums a task holds at a time; rows drawn at a time, each in all resamples.
HELD, ROWS = 64, 64


def _resampled(resamples: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, levels = mixed(np.arange(resamples) + (seed * resamples + 1)), np.array(POISSON, np.uint64)
        sums: dict = {}

        def flush():
            for k, (s, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([s.tolist()]), pa.array([n.tolist()])], names=["g", "s", "n"])
            sums.clear()

        for b in batches:
            groups, d = b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            keys = mixed(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & np.uint64(WORD))
            for s in range(0, len(groups), ROWS):
                w = np.searchsorted(levels, mixed(keys[s : s + ROWS, None] ^ turn), "right")
                for g in dict.fromkeys(groups[s : s + ROWS]):
                    mine = np.array([x == g for x in groups[s : s + ROWS]])
                    if g not in sums:
                        if len(sums) >= HELD:
                            yield from flush()
                        sums[g] = np.zeros(resamples), np.zeros(resamples, np.int64)
                    sums[g][0][:] += d[s : s + ROWS][mine] @ w[mine]
                    sums[g][1][:] += w[mine].sum(axis=0)
        yield from flush()

    return run


def bootstrap(rows: DataFrame, by: str, key: str, delta: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Paired bootstrap by group: point, linear 2.5 and 97.5 percentiles, two-sided p, significance.

    Resample b takes a row as many times as a Poisson variable of mean 1 says that hashes of (seed, b, integer key) draw: a
    resample of a group in which each row decides by itself. So every task adds its rows up for (group, b) on its own, in numpy, and only
    those sums are shuffled; the cost of a resample is a few operations a row. Rows with one key are drawn together. Null
    deltas, keys and groups are left out.
    """
    rows = rows.where(F.col(delta).isNotNull() & F.col(key).isNotNull() & F.col(by).isNotNull())
    own = rows.select(by, F.col(key).cast("long"), F.col(delta).cast("double"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = own.repartition(n, key).mapInArrow(_resampled(resamples, seed), f"g {rows.schema[by].dataType.simpleString()}, s array<double>, n array<long>")
    sums = sums.select("g", F.posexplode(F.arrays_zip("s", "n")).alias("b", "x")).groupBy("g", "b").agg(F.sum("x.s").alias("s"), F.sum("x.n").alias("n"))
    means = sums.where("n > 0").select(F.col("g").alias(by), F.round(F.col("s") / F.col("n"), 9).alias("m"))  # sums in another order must not move a mean across 0
    q = means.groupBy(by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("m") <= 0).cast("double")).alias("below"))
    point = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(delta).alias("point"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    p = F.least(F.lit(1.0), 2 * F.least(F.col("below"), 1 - F.col("below")))
    return point.join(q, by).select(by, "n", F.round("point", 6).alias("point"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), F.round(p, 6).alias("p"), ((lo > 0) | (hi < 0)).alias("significant"))
