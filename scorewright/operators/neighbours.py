"""Exact nearest neighbours of vectors: cells around sampled pivots, bounds by the triangle inequality, blocks of distances in numpy.

Every vector lies in the cell of its nearest pivot. A block holds several cells that lie near each other, or part of a large one; its size is bounded. A search has owners, each with a bound on the distance
of what it looks for. A vector meets a cell only if it may lie within the bound of an owner there: if its distance from the
cell's pivot is no more than the largest sum, over the cell's owners, of an owner's distance from the pivot and its bound. Pieces of
vectors are written once, and each task, which holds the owners of one block by their cells, reads those that may meet it from there; a table of distances has `AREA`
numbers at most. So neither pairs nor copies of vectors are shuffled, and disk grows with the vectors, also where bounds rule nothing out.
Only the pivots (`PIVOTS` at most) and one number for each cell come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed, restarted

#: Pivots at most, owners of a block at most and at least (about), vectors compared with a cell at a time, numbers in a table at most (about), bytes of others that a task holds (about).
PIVOTS, BLOCK, SMALL, STEP, AREA, HELD = 1024, 16_384, 512, 1024, 1 << 20, 64 << 20
#: Distances that differ by less than this share may be equal: they are computed again from differences.
NEAR = 1e-9
POINT = "id long, x binary, cell int, block long, reach double, core double, comp long, bound double"


def usable(rows: DataFrame, vector: str):
    """A column: whether a vector has the most usual length and only finite numbers."""
    size = F.size(vector)
    widths = rows.where(size > 0).groupBy(size.alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((size == (widths[0]["w"] if widths else 0)) & (size > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Binary columns of equal length as rows of 64-bit floats."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances by one matrix product; accurate to rounding of the squared lengths."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))


def exactly(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows with rows of the same number, the same whatever else is computed with them."""
    d = x - y
    return np.sqrt(np.add.accumulate(d * d, axis=1)[:, -1]) if d.shape[1] else np.zeros(len(d))


def exact_pairs(x: np.ndarray, row: np.ndarray, y: np.ndarray, col: np.ndarray) -> np.ndarray:
    """exactly(x[row], y[col]) in pieces of bounded size: equal vectors may give as many pairs as there are."""
    step = max(1, 2 * AREA // max(1, x.shape[1]))
    return np.concatenate([exactly(x[row[k : k + step]], y[col[k : k + step]]) for k in range(0, max(1, len(row)), step)])


@dataclass
class Space:
    """Vectors in cells: points has the columns of POINT."""

    points: DataFrame
    pivots: np.ndarray
    pivot_ids: np.ndarray
    first: np.ndarray  # block of each cell, the first if it has more
    blocks: np.ndarray  # number of each cell


def packed(pivots: np.ndarray, sizes: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells that follow each other from one to the nearest next share a block of `most` vectors."""
    first, count = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    left, cell, block, filled = np.ones(len(sizes), bool), 0, -1, most
    while True:
        n, left[cell] = sizes[cell], False
        if n > most:
            first[cell], count[cell], filled = block + 1, -(-n // most), most
            block += int(count[cell])
        else:
            if filled + n > most or block < 0:
                block, filled = block + 1, 0
            first[cell], filled = block, filled + n
        if not left.any():
            return first, count
        cell = int(np.where(left, ((pivots - pivots[cell]) ** 2).sum(1), np.inf).argmin())


def space(rows: DataFrame, key: str, vector: str, per_cell: int, pivots: int = PIVOTS, block: int = BLOCK) -> Space:
    """The usable vectors of rows in cells of `per_cell` or more on average. key is an integer, unique and not null."""
    own = rows.where(usable(rows, vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = own.count()
    want = int(min(pivots, max(1, n // max(1, per_cell))))
    at = own.orderBy(F.xxhash64("id"), "id").limit(want).collect()  # at most PIVOTS rows
    p, ids = np.array([r["v"] for r in at], np.float64).reshape(len(at), -1), np.array([r["id"] for r in at], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                d = distances(x, p)
                cell = d.argmin(1)
                far = exactly(x, p[cell])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell, pa.int32()), pa.array(far)], names=["id", "x", "cell", "far"])

    placed = checkpointed(own.repartition("id").mapInArrow(assign, "id long, x binary, cell int, far double"))
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most PIVOTS rows
    # some for each core, as each costs a copy of the vectors that meet it
    most = min(block, max(SMALL, n // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    first, blocks = packed(p, [counts.get(c, 0) for c in range(len(p))], most) if len(p) else (np.zeros(1, np.int64), np.ones(1, np.int64))
    number = F.lit([int(v) for v in first])[F.col("cell")].cast("long") + F.pmod(F.xxhash64("id"), F.lit([int(v) for v in blocks])[F.col("cell")])
    return Space(placed.withColumn("block", number), p, ids, first, blocks)


def _bytes(part: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema) as writer:
        writer.write_table(part)
    return sink.getvalue().to_pybytes()


def _table(value: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks().to_batches()[0]


def met(owners: DataFrame, others: DataFrame, blocks: int, kept: int, width: int, meets: Callable, work: Callable, out: str) -> DataFrame:
    """work(pairs) over pairs (block, owners' rows, others' rows) of a block and a piece of others that may meet it, as rows of the schema out.

    owners have a column block, 0 to blocks - 1, others one, 0 to kept - 1, of `BLOCK` rows at most (about), and binary vectors of `width` numbers; meets(rows) gives the blocks that a piece of others
    may meet, in rows (piece's row, block). Pieces lie in the checkpoint folder once and tasks read them there: no copy for each block is shuffled. The
    pairs of a block follow each other in one task; where the folder has places that Spark prefers, they may be in several, so results are partial.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).sort_by("block")
            block = rows.column("block").to_numpy()
            at = np.flatnonzero(np.r_[True, np.diff(block) > 0, True])
            for i, j in zip(at[:-1], at[1:], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 1]), pa.array([_bytes(rows.slice(i, j - i))], pa.binary())], names=["block", "owners"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("cell", "ascending")])
            for i in range(0, rows.num_rows, STEP):
                part = rows.slice(i, STEP)
                to = np.unique(meets(part.combine_chunks().to_batches()[0])[1])
                if len(to):
                    yield pa.RecordBatch.from_arrays([pa.array([to.tolist()], pa.list_(pa.int64())), pa.array([_bytes(part)], pa.binary())], names=["meets", "others"])

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                yield part.take(pa.array(np.unique(meets(part)[0])))

    fields = lambda df: ", ".join(f"{n} {t}" for n, t in df.dtypes)
    group = int(max(1, HELD // (BLOCK * (8 * width + 64))))  # blocks in a partition of pieces, which a task holds
    number = (F.col("block") / group).cast("int")
    left = restarted(owners.repartitionById(blocks, F.col("block").cast("int")).mapInArrow(whole, "block long, owners binary"))
    right = restarted(others.mapInArrow(useful, fields(others)).repartitionById(-(-kept // group), number).mapInArrow(pieces, "meets array<long>, others binary"))
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl")).where(F.array_contains("meets", F.col("block"))).select("block", "owners", "others")
    return pairs.coalesce(blocks).mapInArrow(work, out)


def search(s: Space, owners: DataFrame, others: DataFrame, work: Callable, out: str, own_block: bool = False) -> DataFrame:
    """work(owners), fed with others by add(ids, x, core, comp), for each cell of each block, as rows of the schema out.

    owners and others have the columns of POINT (others' reach and bound are not read); owners' reach is the distance
    that their cell's pivot may have from what they look for. own_block: others are sent to their own block only and meet all of its cells.
    Without it the results of a cell may come in parts.
    """
    p, names = s.pivots, [f.split()[0] for f in POINT.split(", ")]

    def begun(rows: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Work of each cell, how many owners it has, its pivot and reach."""
        all_ = rows.sort_by("cell").combine_chunks().to_batches()[0]
        cell = all_.column(2).to_numpy()
        at = np.flatnonzero(np.r_[True, np.diff(cell) > 0, True])
        parts = [all_.slice(i, j - i) for i, j in zip(at[:-1], at[1:], strict=True)]
        far = [np.inf if own_block else part.column(4).to_numpy().max() for part in parts]
        return [work(part) for part in parts], np.diff(at), p[cell[at[:-1]]], np.array(far)

    def fed(state: tuple, part: pa.RecordBatch) -> None:
        """At most STEP others for the cells that they may meet."""
        ids, x, core, comp = part.column(0).to_numpy(), matrix(part.column(1)), part.column(5).to_numpy(), part.column(6).to_numpy()
        may = distances(x, state[2]) <= state[3] * (1 + NEAR) + NEAR
        for c, w in enumerate(state[0]):
            rows, step = np.flatnonzero(may[:, c]), max(16, AREA // int(state[1][c]))
            for j in range(0, len(rows), step):
                some = rows[j : j + step]
                w.add(ids[some], x[some], core[some], comp[some])

    if not own_block:
        reach = np.full(len(s.blocks), -1.0)
        for r in owners.groupBy("cell").agg(F.max("reach").alias("r")).collect():  # at most PIVOTS rows
            reach[r["cell"]] = r["r"]
        order = np.argsort(s.first, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(s.first[order]) > 0])  # cells that share a block, or a cell with several
        first, count = s.first[order][starts], s.blocks[order][starts]

        def meets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            may = distances(matrix(part.column(1)), p) <= reach * (1 + NEAR) + NEAR
            row, group = np.nonzero(np.logical_or.reduceat(may[:, order], starts, axis=1))
            times = count[group]
            return np.repeat(row, times), np.repeat(first[group], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)

        def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, now = None, None
            for b in batches:
                for k, block in enumerate(b.column(0).to_pylist()):
                    if block != now:
                        for w in state[0] if state is not None else ():
                            yield from w.result()
                        state, now = begun(pa.Table.from_batches([_table(b.column(1)[k])])), block
                    fed(state, _table(b.column(2)[k]))
            for w in state[0] if state is not None else ():
                yield from w.result()

        n = int((s.first + s.blocks).max())
        return met(owners.select(*names), others.select(*names), n, n, p.shape[1], meets, run_pairs, out)

    every = owners.select(*names, F.lit(0).alias("role")).unionByName(others.select(*names).withColumn("role", F.lit(1)))
    dealt = every.repartition(int((s.first + s.blocks).max()), "block").sortWithinPartitions("block", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state, now = None, None
        for b in batches:
            block, role = b.column(3).to_numpy(), b.column(8).to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1
            for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if e == a:
                    continue
                if block[a] != now:
                    for w in state[0] if state is not None else ():
                        yield from w.result()
                    state, held, now = None, [], block[a]
                if role[a] == 0:
                    held.append(b.slice(a, e - a))
                    continue
                if state is None and held:
                    state, held = begun(pa.Table.from_batches(held)), []
                for k in range(a, e if state is not None else a, STEP):
                    fed(state, b.slice(k, min(STEP, e - k)))
        for w in state[0] if state is not None else ():
            yield from w.result()

    return dealt.mapInArrow(run, out)


class Knn:
    """The k nearest others of each owner, by distance, then id; those farther than its bound are not looked at."""

    def __init__(self, owners: pa.RecordBatch, k: int):
        self.ids, self.x, self.k = owners.column(0).to_numpy(), matrix(owners.column(1)), k
        n, self.bound = len(self.ids), owners.column(7).to_numpy()
        self.d, self.q = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)

    def add(self, ids: np.ndarray, y: np.ndarray, core: np.ndarray, comp: np.ndarray) -> None:
        d = distances(self.x, y)
        d[self.ids[:, None] == ids] = np.inf
        # those that may be among the nearest, with exact distances
        near = d <= np.minimum(self.d[:, -1], self.bound)[:, None] * (1 + NEAR) + NEAR
        if self.k < d.shape[1] and np.count_nonzero(near) > len(d):
            near &= d <= np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k] * (1 + NEAR) + NEAR
        row, col = np.nonzero(near)
        ok = np.isfinite(d[row, col])
        row, col = row[ok], col[ok]
        if not len(row):
            return
        new = exact_pairs(self.x, row, y, col)
        own = np.unique(row)  # only the lists of these change
        row, dist, q = np.r_[np.repeat(own, self.k), row], np.r_[self.d[own].ravel(), new], np.r_[self.q[own].ravel(), ids[col]]
        order = np.lexsort((q, dist, row))
        row, dist, q = row[order], dist[order], q[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        nth = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        keep = nth < self.k
        self.d[own], self.q[own] = dist[keep].reshape(-1, self.k), q[keep].reshape(-1, self.k)

    def result(self) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.ids), STEP):
            d, q = self.d[s : s + STEP], self.q[s : s + STEP]
            n = np.isfinite(d).sum(1)
            at = pa.array(np.cumsum(np.r_[0, n]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[s : s + STEP]), pa.ListArray.from_arrays(at, pa.array(d[np.isfinite(d)])), pa.ListArray.from_arrays(at, pa.array(q[np.isfinite(d)]))], names=["id", "d", "q"])


def nearest(s: Space, k: int) -> DataFrame:
    """(id, d, q): distances and ids of each vector's k nearest others, by distance, then id; all others where there are fewer."""
    blank = s.points.select("id", "x", "cell", "block", F.lit(float("inf")).alias("reach"), F.lit(0.0).alias("core"), F.col("id").alias("comp"), F.lit(float("inf")).alias("bound"), "far")
    out = "id long, d array<double>, q array<long>"
    # within the own block: a bound on the k-th distance
    rough = search(s, blank, blank, lambda b: Knn(b, k), out, own_block=True)
    kth = F.when(F.size("d") == k, F.element_at("d", -1)).otherwise(F.lit(float("inf")))
    bounded = checkpointed(blank.drop("reach", "bound").join(rough.select("id", kth.alias("bound")), "id").withColumn("reach", F.col("far") + F.col("bound")))
    found = restarted(search(s, bounded, bounded, lambda b: Knn(b, k), out))
    if found.count() == bounded.count():
        return found
    one = F.flatten(F.collect_list(F.arrays_zip("d", "q")))  # a vector's lists in parts
    return restarted(found.groupBy("id").agg(F.slice(F.array_sort(one), 1, k).alias("x")).select("id", "x.d", "x.q"))
