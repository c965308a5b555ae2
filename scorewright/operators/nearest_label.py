"""The most similar label of each vector, for any number of labels: label cells with bounds by the triangle inequality.

Labels and vectors are taken at length 1, where the cosine falls as the distance grows. Labels lie in cells around pivots, a sample of
them, and a cell in blocks of bounded size; a row for each cell (pivot and radius) is all that tasks carry. First a vector goes to the cell of its
nearest pivot, which gives it its two best labels so far. Then it meets every other cell that may hold a nearer one than the second: those
whose pivot is no farther than that distance and the cell's radius together. A task holds one block of vectors with their two best labels, and reads the pieces of labels
that may be near from the checkpoint folder, where they lie once; tables of similarities have a bounded size. So no vector meets a label
that the bounds rule out, none is left out that they don't, and nothing is written for a vector and a block of labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed
from .neighbours import AREA, NEAR, SMALL, _table, distances, matrix, met, packed, usable

#: Cells of labels at most, labels of a block at most (about), vectors compared at a time.
CELLS, BLOCK, STEP = 1024, 16_384, 1024
SENT = "block long, role int, id long, v binary"


def _unit(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of vectors with a length, divided by it."""
    own = rows.where(usable(rows, vector)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                n = np.sqrt((x * x).sum(1))
                keep = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([r.tobytes() for r in x[keep] / n[keep, None]], pa.binary())], names=["id", "v"])

    return own.mapInArrow(run, "id long, v binary")


def _copies(part: pa.RecordBatch, row: np.ndarray, where: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows SENT of part's (id, v) by their numbers, in batches of bounded size: where bounds rule nothing out, each row goes to every cell."""
    for k in range(0, len(row), 4 * STEP):
        got = part.take(pa.array(row[k : k + 4 * STEP]))
        n = got.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(where[k : k + n].astype(np.int64)), pa.array(np.ones(n, np.int32)), got.column(0), got.column(1)], names=["block", "role", "id", "v"])


def _best_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, similarity, compared) of rows SENT, sorted by block and role: labels (role 0), then vectors; two labels for each vector."""
    now, names, held, labels = None, [], [], None
    for b in batches:
        block, role = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1
        for a, e in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if e == a:
                continue
            if block[a] != now:
                now, names, held, labels = block[a], [], [], None
            part = b.slice(a, e - a)
            if role[a] == 0:
                names.append(part.column(2).to_numpy()), held.append(matrix(part.column(3)))
                continue
            if not held:
                continue
            if labels is None:
                names, held = [np.concatenate(names)], [np.concatenate(held)]
                order = np.argsort(names[0])  # of equal similarities the smallest label comes first
                labels, ids = held[0][order], names[0][order]
            step = min(STEP, max(16, AREA // len(ids)))
            for s in range(0, e - a, step):
                some = part.slice(s, step)
                sim = matrix(some.column(3)) @ labels.T
                np.round(sim, 12, out=sim)
                rows, out = np.arange(len(sim)), []
                for _ in range(min(2, len(ids))):
                    k = sim.argmax(1)
                    out.append((some.column(2).to_numpy(), ids[k], sim[rows, k], np.full(len(sim), len(ids)) if not out else np.zeros(len(sim), np.int64)))
                    sim[rows, k] = -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "label", "similarity", "compared"])


def _meets(p: np.ndarray, reach: np.ndarray, first: np.ndarray, blocks: np.ndarray):
    """For `met`: the blocks of vectors that have a cell within whose reach a label lies."""

    def run(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        row, cell = np.nonzero(distances(matrix(part.column(1)), p) <= reach * (1 + NEAR) + NEAR)
        times = blocks[cell]
        return np.repeat(row, times), np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)

    return run


class Two:
    """The two best labels so far of each vector of a block, by similarity, then label."""

    def __init__(self, owners: pa.RecordBatch):
        self.ids, self.v, self.cell, self.bound = owners.column(0), matrix(owners.column(1)), owners.column(2).to_numpy(), owners.column(3).to_numpy()
        n = len(self.cell)
        self.sim, self.label, self.compared = np.full((2, n), -np.inf), np.full((2, n), -1, np.int64), np.zeros(n, np.int64)

    def add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """labels, sorted by ids, for the vectors of some rows."""
        for k in range(0, len(rows), step := max(16, AREA // len(ids))):
            some = rows[k : k + step]
            sim = self.v[some] @ labels.T
            np.round(sim, 12, out=sim)
            self.compared[some] += len(ids)
            for _ in range(min(2, len(ids))):
                at = sim.argmax(1)
                s, name = sim[np.arange(len(some)), at], ids[at]
                sim[np.arange(len(some)), at] = -np.inf
                for place in range(2):  # what is better than the first pushes it to the second place
                    old, other = self.sim[place, some], self.label[place, some]
                    new = (s > old) | (s == old) & (name < other)
                    self.sim[place, some], self.label[place, some] = np.where(new, s, old), np.where(new, name, other)
                    s, name = np.where(new, old, s), np.where(new, other, name)

    def result(self) -> Iterator[pa.RecordBatch]:
        for place in range(2):
            found = np.flatnonzero(self.label[place] >= 0) if place else np.flatnonzero(self.compared)
            compared = np.zeros(len(found), np.int64) if place else self.compared[found]
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(found)), *(pa.array(c) for c in (self.label[place, found], self.sim[place, found], compared))], names=["id", "label", "similarity", "compared"])


def _two_of_pieces(p: np.ndarray, radius: np.ndarray):
    """For `met`: two rows FOUND for each vector of a block, of the labels in other cells that its bound doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                if block != now:
                    if state is not None:
                        yield from state.result()
                    state, now = Two(_table(b.column(1)[i])), block
                part = _table(b.column(2)[i])
                ids, v, cell = part.column(0).to_numpy(), matrix(part.column(1)), part.column(2).to_numpy()
                order = np.lexsort((ids, cell))
                cells, starts = np.unique(cell[order], return_index=True)
                may = (distances(state.v, p[cells]) <= (state.bound[:, None] + radius[cells]) * (1 + NEAR) + NEAR) & (state.cell[:, None] != cells)
                for c, some in enumerate(np.split(order, starts[1:])):
                    if may[:, c].any():
                        state.add(ids[some], v[some], np.flatnonzero(may[:, c]))
        if state is not None:
            yield from state.result()

    return run


FOUND = "id long, label long, similarity double, compared long"


def _top(found: DataFrame) -> DataFrame:
    """(id, best, compared): the two best labels of each vector (similarity descending, then label), and labels compared with it."""
    one = F.struct((-F.col("similarity")).alias("far"), "label")
    first = found.groupBy("id").agg(F.min(one).alias("a"), F.sum("compared").alias("compared"))
    second = found.join(first.select("id", "a"), "id").where(F.col("label") != F.col("a.label")).groupBy("id").agg(F.min(one).alias("b"))
    return first.join(second, "id", "left")


def nearest_labels(rows: DataFrame, key: str, vector: str, own: str, labels: DataFrame, label: str, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """rows with predicted, similarity, own_similarity, best_other, margin, compared, whatever the number of labels(label, centroid).

    predicted is the label of the greatest cosine, ties (to 12 digits) to the smallest; margin is the own label's less the best other's; compared counts the
    labels whose similarity was computed. key and label are integers, unique and not null. Null vectors, those of other lengths than
    most or without a length, and labels whose centroid is such, have no similarities.
    """
    named = checkpointed(_unit(labels, label, "centroid"))
    n = named.count()
    pivots = named.orderBy(F.xxhash64("id"), "id").limit(min(cells, max(1, int(n**0.5)))).collect()  # at most CELLS rows
    if not pivots:
        empty = {c: F.lit(None).cast("double") for c in ("similarity", "own_similarity", "best_other", "margin")}
        return rows.withColumns({"predicted": F.lit(None).cast("long"), **empty, "compared": F.lit(0).cast("long")})
    p = np.array([np.frombuffer(bytes(r["v"]), np.float64) for r in pivots])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, STEP):
                part = b.slice(s, STEP)
                d = distances(matrix(part.column(1)), p)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["id", "v", "cell", "far"])

    placed = "id long, v binary, cell int, far double"
    own_cells = checkpointed(named.mapInArrow(assign, placed))
    stats = {r["cell"]: (r["n"], r["far"]) for r in own_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # at most CELLS rows
    blocks = np.array([-(-stats[c][0] // block) if c in stats else 0 for c in range(len(p))])
    radius = np.array([stats[c][1] if c in stats else -np.inf for c in range(len(p))])
    first = np.cumsum(np.r_[0, blocks[:-1]])
    lit = lambda xs: F.lit([int(x) for x in xs])[F.col("cell")]
    number = lit(first).cast("long") + F.pmod(F.xxhash64("id"), lit(np.maximum(blocks, 1)))
    label_side = checkpointed(own_cells.select(number.alias("block"), F.lit(0).alias("role"), "id", "v"))
    vectors = checkpointed(_unit(rows, key, vector).mapInArrow(assign, placed))

    def meet(sent: DataFrame) -> DataFrame:
        return label_side.unionByName(sent).repartition("block").sortWithinPartitions("block", "role").mapInArrow(_best_two, FOUND)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to all blocks of its own cell."""
        for b in batches:
            for s in range(0, b.num_rows, STEP // 4):
                part = b.slice(s, STEP // 4)
                to = part.column(2).to_numpy()
                times = blocks[to]
                where = np.repeat(first[to], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield from _copies(part, np.repeat(np.arange(len(to)), times), where)

    near = checkpointed(meet(vectors.mapInArrow(send, SENT)))
    second = F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * F.col("b.far"))) + 1e-6  # the distance of a similarity, rounded up
    bound = F.coalesce(second, F.lit(3.0))
    # blocks of vectors, to which labels of other cells come
    held = {r["cell"]: r["count"] for r in vectors.groupBy("cell").count().collect()}  # at most CELLS rows
    most = min(block, max(SMALL, sum(held.values()) // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    own_first, own_blocks = packed(p, [held.get(c, 0) for c in range(len(p))], most)
    own_number = lit(own_first).cast("long") + F.pmod(F.xxhash64("id"), lit(own_blocks))
    todo = vectors.join(_top(near).select("id", bound.alias("bound")), "id", "left").select("id", "v", "cell", "far", F.coalesce("bound", F.lit(3.0)).alias("bound"), own_number.alias("block"))
    todo = checkpointed(todo)
    reach = np.full(len(p), -1.0)
    for r in todo.groupBy("cell").agg(F.max(F.col("far") + F.col("bound")).alias("r")).collect():  # at most CELLS rows
        reach[r["cell"]] = r["r"]
    label_first, label_blocks = packed(p, [stats[c][0] if c in stats else 0 for c in range(len(p))], block)
    every = own_cells.select("id", "v", "cell", (lit(label_first).cast("long") + F.pmod(F.xxhash64("id"), lit(label_blocks))).alias("block"))
    n_blocks, n_kept = int((own_first + own_blocks).max()), int((label_first + label_blocks).max())
    far = met(todo.select("id", "v", "cell", "bound", "block"), every, n_blocks, n_kept, p.shape[1], _meets(p, reach, own_first, own_blocks), _two_of_pieces(p, radius), FOUND)
    found = checkpointed(near.unionByName(far))
    top = _top(found).select(F.col("id").alias("_id"), F.col("a.label").alias("predicted"), (-F.col("a.far")).alias("similarity"), F.col("b.label").alias("_next"), (-F.col("b.far")).alias("_second"), "compared")
    mine = vectors.select("id", "v").join(rows.select(F.col(key).cast("long").alias("id"), F.col(own).cast("long").alias("_own")), "id").join(named.select(F.col("id").alias("_own"), F.col("v").alias("_c")), "_own")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round((matrix(b.column(1)) * matrix(b.column(2))).sum(1), 12))], names=["_i", "own_similarity"])

    own_dots = mine.select("id", "v", "_c").mapInArrow(dots, "_i long, own_similarity double")
    out = rows.join(top, F.col(key).cast("long") == F.col("_id"), "left").join(own_dots, F.col(key).cast("long") == F.col("_i"), "left")
    other = F.when(F.col("predicted") == F.col(own), F.col("_second")).otherwise(F.col("similarity"))
    return out.withColumns({"best_other": other, "margin": F.col("own_similarity") - other, "compared": F.coalesce("compared", F.lit(0))}).select(*rows.columns, "predicted", "similarity", "own_similarity", "best_other", "margin", "compared")
