"""Paired bootstrap with exactly n places in each resample of a group of n rows, spread over tasks.

A group's rows are numbered; the ranks are halved again and again into ranges of at most `LEAF`, a binary tree. The n places of
a resample are dealt down that tree: of a node's places, a binomial draw goes to its left half. The draws of a node come from a
generator seeded by (seed, group, node), for all resamples at once, so every task finds the places of its own ranges by going down from the
root, and all tasks agree without any exchange. In a leaf, places fall on rows uniformly. What a task adds up for a group is one number for each resample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import positions

#: Rows of a leaf at most, places drawn at a time, levels of the tree at most.
LEAF, DRAWN, DEEPEST = 1024, 1 << 22, 40


class Places:
    """The places that ranges of one group get in each resample."""

    def __init__(self, group: str, n: int, resamples: int, seed: int, places: int | None = None):
        self.key = (seed, zlib.crc32(group.encode()), n)
        self.n, self.resamples = n, resamples
        self.path: dict[tuple[int, int], np.ndarray] = {(0, 0): np.full(resamples, n if places is None else places, np.int64)}

    def generator(self, depth: int, node: int) -> np.random.Generator:
        return np.random.default_rng([*self.key, depth, node])

    def bounds(self, depth: int, node: int) -> tuple[int, int]:
        return node * self.n >> depth, (node + 1) * self.n >> depth

    def of(self, depth: int, node: int) -> np.ndarray:
        """Places of a node, one number for each resample; nodes on the way are kept while later ones are below them."""
        self.path = {k: v for k, v in self.path.items() if k[0] <= depth and node >> (depth - k[0]) == k[1]}
        for d in range(1, depth + 1):
            at = (d, node >> (depth - d))
            if at not in self.path:
                above = (d - 1, at[1] >> 1)
                (low, high), (mid, _) = self.bounds(*above), self.bounds(d, 2 * above[1] + 1)
                left = self.generator(*above).binomial(self.path[above], (mid - low) / (high - low))
                self.path[at] = left if at[1] % 2 == 0 else self.path[above] - left
        return self.path[depth, node]

    def times(self, depth: int, node: int) -> np.ndarray:
        """How often each rank of a leaf is drawn, in the first resample."""
        low, high = self.bounds(depth, node)
        out = np.zeros(high - low, np.int64)
        left, rng = int(self.of(depth, node)[0]), self.generator(depth + DEEPEST, node)
        while left > 0:
            out += np.bincount(rng.integers(0, len(out), min(left, DRAWN)), minlength=len(out))
            left -= DRAWN
        return out

    def sums(self, depth: int, node: int, values: np.ndarray) -> np.ndarray:
        """For each resample, the sum of a leaf's values, as often as they are drawn."""
        places, rng, out = self.of(depth, node), self.generator(depth + DEEPEST, node), np.zeros(self.resamples)
        ends = np.cumsum(places)
        start = 0
        while start < self.resamples:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + DRAWN, "right")))
            drawn = np.append(values[rng.integers(0, len(values), int(ends[stop - 1]) - done)], 0.0)
            at = np.r_[0, ends[start : stop - 1] - done].astype(np.int64)
            out[start:stop] = np.where(places[start:stop] > 0, np.add.reduceat(drawn, at), 0.0)
            start = stop
        return out


def _sums(resamples: int, seed: int):
    """(g, n, sums) of rows (g, n, depth, node, rank, value), sorted by g, node, rank: a row for each group of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, total, leaf, values = None, None, None, None, []

        def close() -> None:
            if values:
                total[:] += places.sums(*leaf, np.array(values))
                values.clear()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([places.n]), pa.array([total.tolist()])], names=["g", "n", "sums"])

        for b in batches:
            for g, n, depth, node, value in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 5)), strict=True):
                if g != now or (depth, node) != leaf:
                    close()
                    leaf = (depth, node)
                if g != now:
                    if now is not None:
                        yield row()
                    now, places, total = g, Places(g, n, resamples, seed), np.zeros(resamples)
                values.append(value)
        close()
        if now is not None:
            yield row()

    return run


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, lo, hi, p) of rows (g, n, sums), sorted by g."""
    now, n, total = None, 0, None

    def row() -> pa.RecordBatch:
        means = np.round(total / n, 9)  # sums in another order must not move a mean across 0
        lo, hi = np.percentile(means, [2.5, 97.5])
        p = min(1.0, 2 * min((means <= 0).mean(), (means > 0).mean()))
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (now, float(lo), float(hi), float(p))], names=["g", "lo", "hi", "p"])

    for b in batches:
        for k, g in enumerate(b.column(0).to_pylist()):
            if g != now:
                if now is not None:
                    yield row()
                now, n, total = g, b.column(1)[k].as_py(), 0.0
            total = total + b.column(2).slice(k, 1).flatten().to_numpy()
    if now is not None:
        yield row()


def leaves(rows: DataFrame, by: str, key: str, delta: str, keep: bool = False) -> DataFrame:
    """(g, n, depth, node, rank, value), and the key k with keep: each row's rank in its group, and the leaf of the group's tree in which it lies."""
    own = rows.where(F.col(delta).isNotNull() & F.col(key).isNotNull() & F.col(by).isNotNull())
    own = own.select(F.col(by).cast("string").alias("g"), F.col(key).cast("long").alias("k"), F.col(delta).cast("double").alias("value"))
    placed = positions(own, [F.col("g"), F.col("k"), F.col("value")])
    groups = placed.groupBy("g").agg(F.count("*").alias("n"), F.min("position").alias("start"))
    ranked = placed.join(groups, "g").withColumn("rank", F.col("position") - F.col("start"))
    ranked = ranked.withColumn("depth", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int"))
    power = F.expr("shiftleft(1L, depth)")
    return ranked.select("g", "n", "depth", F.call_function("div", (F.col("rank") + 1) * power - 1, F.col("n")).alias("node"), "rank", "value", *(["k"] if keep else []))


def exact_bootstrap(rows: DataFrame, by: str, key: str, delta: str, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """by, n, point, lo, hi, p, significant: each resample of a group of n rows draws exactly n of them, with replacement.

    lo and hi are the linear 2.5 and 97.5 percentiles of the means, p is two-sided. Rows go by integer key, then value, so the result does not depend on
    partitions, nor on ties. Null deltas, keys and groups are left out; a group of one row has an interval of width 0; an empty table gives an empty result.
    """
    dealt = leaves(rows, by, key, delta).repartition("g", "node").sortWithinPartitions("g", "node", "rank")  # a leaf is at most LEAF rows
    sums = dealt.mapInArrow(_sums(resamples, seed), "g string, n long, sums array<double>")
    found = sums.repartition("g").sortWithinPartitions("g").mapInArrow(_intervals, "g string, lo double, hi double, p double")
    point = rows.where(F.col(delta).isNotNull() & F.col(key).isNotNull() & F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("g")).agg(F.count("*").alias("n"), F.avg(delta).alias("point"))
    out = point.join(found, "g")
    return out.select(F.col("g").cast(rows.schema[by].dataType).alias(by), "n", F.round("point", 6).alias("point"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("p", 6).alias("p"), ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"))


def _times(seed: int):
    """(key, times) of rows (g, n, depth, node, rank, key, places) that are drawn, sorted by g and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, places, leaf, times, low = None, None, None, None, 0
        for b in batches:
            keys, out = [], []
            for g, n, depth, node, rank, key, most in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != now:
                    now, places, leaf = g, Places(g, n, 1, seed, most), None
                if (depth, node) != leaf:
                    leaf, times, low = (depth, node), places.times(depth, node), places.bounds(depth, node)[0]
                if times[rank - low]:
                    keys.append(key), out.append(int(times[rank - low]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.int64())], names=["k", "times"])

    return run


def draws(rows: DataFrame, by: str, key: str, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """(k, times): how often each row's key is drawn when each group gets `places` independent draws with replacement.

    wanted(by, places) has a row for each group to draw from; the times of a group add up to its places. key is an integer, unique and not null.
    """
    some = rows.join(wanted.select(by), by, "left_semi").select(by, F.col(key).cast("long").alias("key"), F.lit(0.0).alias("value"))
    placed = leaves(some, by, "key", "value", keep=True).join(wanted.select(F.col(by).cast("string").alias("g"), F.col("places").cast("long").alias("places")), "g")
    dealt = placed.select("g", "n", "depth", "node", "rank", "k", "places").repartition("g", "node").sortWithinPartitions("g", "node", "rank")
    return dealt.mapInArrow(_times(seed), "k long, times long")
