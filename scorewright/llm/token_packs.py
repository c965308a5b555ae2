"""Token-id output: best-fit-decreasing packing into fixed rows of ids, written as binary matrices.

A task takes documents until a chunk holds `CHUNK` tokens, splits those longer than a row into row-sized pieces without
loss, sorts the pieces by falling length and places each into the fullest row that still holds it. A segment tree over
capacities finds that row's capacity in log(row) steps. Rows are padded with pad_id and come with cumulative segment
lengths and position ids that restart at each segment. There is no shuffle, and memory is bounded by the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch
from .tokens import byte_bpe

CHUNK = 4_000_000
ROWS = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary())])
ROWS_SQL = "row_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


class Capacities:
    """Multiset of open rows by free capacity; a segment tree of counts finds the smallest capacity of at least c."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def push(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self.change(capacity, 1)

    def change(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def pop(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of a fullest row with room for `least`; None if there is none."""
        k = self.leaves + least
        while not self.count[k]:
            while k & 1:  # right children have nothing to their right below this parent
                k >>= 1
                if not k:
                    return None
            k += 1
            if k & k - 1 == 0:
                return None
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        self.change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers by best-fit decreasing; each length is 1..width."""
    tree, rows = Capacities(width), []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.pop(lengths[k])
        if found is None:
            found = width, len(rows)
            rows.append([])
        rows[found[1]].append(k)
        tree.push(found[0] - lengths[k], found[1])
    return rows


def _rows(pieces: list[tuple], width: int, first: int, pad: int) -> Iterator[tuple]:
    for r, members in enumerate(best_fit([len(p[2]) for p in pieces], width)):
        ids, positions, cu = np.full(width, pad, "<u4"), np.zeros(width, "<u4"), [0]
        for k in members:
            s, n = cu[-1], len(pieces[k][2])
            ids[s : s + n], positions[s : s + n] = pieces[k][2], np.arange(n)
            cu.append(s + n)
        yield first + r, cu[-1], [pieces[k][0] for k in members], [pieces[k][1] for k in members], cu, ids.tobytes(), positions.tobytes()


def _pack(path: str, width: int, end_id: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made, pieces, held = byte_bpe(path).ids, TaskContext.get().partitionId() << 36, [], 0

        def flush():
            nonlocal made, pieces, held
            rows = list(_rows(pieces, width, made, pad))
            made, pieces, held = made + len(rows), [], 0
            for s in range(0, len(rows), 1000):
                yield batch(ROWS, *map(list, zip(*rows[s : s + 1000], strict=True)))

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                pieces += [(doc.as_py(), s, ids[s : s + width]) for s in range(0, len(ids), width)]
                held += len(ids)
                if held >= CHUNK:
                    yield from flush()
        if pieces:
            yield from flush()

    return run


def pack_ids(docs: DataFrame, tokenizer: str, width: int = 2048, end_id: int = 50256, pad_id: int = 0) -> DataFrame:
    """Packed rows: row_id, n_tokens, doc_ids, starts, cu_seqlens, ids and positions (little-endian uint32, width each).

    A document is its text's ids and then end_id (null and empty texts: end_id alone). Segment i of a row is
    ids[cu_seqlens[i] : cu_seqlens[i+1]], from place starts[i] of document doc_ids[i]; all ids of every row of the input
    occur once. Repeated rows are kept, a null doc_id stays null, an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_pack(tokenizer, width, end_id, pad_id), ROWS_SQL)


def write_packs(packs: DataFrame, folder: str) -> None:
    """Write packed rows as Parquet; each part file holds whole id and position matrices."""
    packs.write.mode("errorifexists").parquet(folder)


def digest(packs: DataFrame) -> DataFrame:
    """Packed rows with their matrices as CRC-32 sums."""
    return packs.select("row_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
