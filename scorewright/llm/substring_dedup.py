"""Substring dedup: repeated windows of 13 words, found by Rabin-Karp hashes counted in Spark.

Every window of every document gets a polynomial hash. A map task sorts the hashes of a block of documents and sends
each distinct one once, with the block's smallest document, to the partition that a second, independent hash names;
windows that repeat within the block are settled there, so a passage found everywhere costs one entry a block. The
reduce side takes the smallest document of each hash over all blocks and tells the others. Documents then come
together with what was found about them, and repeated windows merge into maximal removal intervals.

Partitions grow in number with the input, blocks do not. From `FAN` partitions on a block would fall into shuffled rows of few
windows; then tasks deal to groups of some sqrt(n) partitions first, and a middle stage puts the blocks of many tasks together and
deals them to the partitions (`Route`). It costs a second shuffle and changes no result.

Two windows count as equal if 64 bits of one hash and the partition bits of the other agree: with W windows over n
partitions some W^2 / (2^65 n) chance matches (2e-6 of one at 10^8 windows on 49 partitions; about two in all at
100 TB), far below what disks lose.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import WordHash, batch, dealt, id_part, part_of, partitions, runs

WINDOW = 13
#: Words in a block of a map task; partitions that a task deals to directly; partitions' worth of data in a task of the middle stage.
BLOCK, FAN, MIDDLE = 1 << 20, 4096, 16
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
FOUND = pa.schema([("p", pa.int32()), ("kind", pa.int8()), ("docs", pa.binary()), ("data", pa.binary())])
FOUND_SQL = "p int, kind tinyint, docs binary, data binary"
WINDOWS, SPANS, HASHES, ROWS = 0, 1, 2, 3
SPAN = np.dtype([("doc", "<i8"), ("crc", "<u4"), ("start", "<u4"), ("n", "<u4")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the window that starts at each word."""
    m = len(flat) - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    out = []
    for base in BASES:
        h = flat[:m].copy()
        for j in range(1, WINDOW):
            h *= base
            h += flat[j : j + m]
        out.append(h)
    return out[0], out[1]


def run_length(values: np.ndarray) -> bytes:
    """Runs of equal document ids: differences of the ids, then lengths."""
    s, n = runs(values)
    return np.int64(len(s)).tobytes() + np.diff(values[s], prepend=np.int64(0)).tobytes() + n.astype(np.int32).tobytes()


def from_runs(data: bytes) -> np.ndarray:
    k = int(np.frombuffer(data, np.int64, 1)[0])
    return np.repeat(np.cumsum(np.frombuffer(data, np.int64, k, 8)), np.frombuffer(data, np.int32, k, 8 + 8 * k))


@dataclass(frozen=True)
class Route:
    """The way of blocks to n partitions: directly (width 1), or over groups of `width` partitions, each with `salts` tasks of its own."""

    n: int
    width: int = 1
    salts: int = 1

    @classmethod
    def to(cls, n: int) -> Route:
        if n <= FAN:
            return cls(n)
        width = math.isqrt(n)
        return cls(n, width, max(1, width // MIDDLE))

    @property
    def first(self) -> int:
        """Partitions of the first exchange."""
        return -(-self.n // self.width) * self.salts

    def deal(self, part: np.ndarray, turn: int) -> Iterator[tuple[int, np.ndarray]]:
        """(partition of the first exchange, indices) of entries bound for partitions `part`; turn: number of the block, which takes the salts by turns."""
        for g, i in dealt(part // np.int32(self.width) if self.width > 1 else part):
            yield g * self.salts + turn % self.salts, i

    def exchange(self, blocks: DataFrame) -> DataFrame:
        """Blocks in their partitions of n."""
        blocks = blocks.repartitionById(self.first, "p")
        return blocks if self.width == 1 else blocks.mapInArrow(_middle(self.n), FOUND_SQL).repartitionById(self.n, "p")


def windows_row(p: int, doc: np.ndarray, h: np.ndarray, part: np.ndarray | None) -> tuple:
    """A row of windows; part: the partition of each, if the row still has to be dealt out."""
    return p, WINDOWS, run_length(doc), h.tobytes() + (b"" if part is None else part.astype("<i4").tobytes())


def _middle(n: int):
    """Blocks of many tasks put together and dealt to their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {k: [] for k in (WINDOWS, SPANS, HASHES, ROWS)}
        size = dict.fromkeys(held, 0)

        def flush(kind: int) -> Iterator[tuple]:
            got, held[kind], size[kind] = held[kind], [], 0
            if kind == WINDOWS:
                doc, h, part = (np.concatenate([x[k] for x in got]) for k in range(3))
                order = np.argsort(doc, kind="stable")
                for p, i in dealt(part[order]):
                    yield windows_row(p, doc[order[i]], h[order[i]], None)
            elif kind == HASHES:
                doc, h = (np.concatenate([x[k] for x in got]) for k in range(2))
                order = np.argsort(doc, kind="stable")
                for p, i in dealt(id_part(doc[order], n)):
                    yield p, HASHES, run_length(doc[order[i]]), h[order[i]].tobytes()
            elif kind == SPANS:
                span = np.concatenate(got)
                for p, i in dealt(id_part(span["doc"], n)):
                    yield p, SPANS, b"", span[i].tobytes()
            else:
                yield from _row_blocks(pa.Table.from_batches(got).combine_chunks().to_batches()[0], lambda part: dealt(part), n)

        for b in batches:
            for kind, d, data in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if kind == WINDOWS:
                    doc = from_runs(d)
                    held[kind].append((doc, np.frombuffer(data, np.uint64, len(doc)), np.frombuffer(data, "<i4", len(doc), 8 * len(doc))))
                    size[kind] += len(doc)
                elif kind == HASHES:
                    held[kind].append((from_runs(d), np.frombuffer(data, np.uint64)))
                    size[kind] += len(data) // 8
                elif kind == SPANS:
                    held[kind].append(np.frombuffer(data, SPAN))
                    size[kind] += len(held[kind][-1])
                else:
                    held[kind] += pa.ipc.open_stream(data).read_all().to_batches()
                    size[kind] += sum(x.nbytes for x in held[kind][-1:]) // 8
                if size[kind] >= BLOCK:
                    yield batch(FOUND, *map(list, zip(*flush(kind), strict=True)))
        for kind in held:
            if held[kind]:
                yield batch(FOUND, *map(list, zip(*flush(kind), strict=True)))

    return run


def _row_blocks(b: pa.RecordBatch, deal, n: int) -> Iterator[tuple]:
    """Rows of documents (id first) as compressed blocks for their partitions."""
    option = pa.ipc.IpcWriteOptions(compression="zstd")
    ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for s in range(0, len(ids), 4096):
        for p, i in deal(id_part(ids[s : s + 4096], n)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=option) as w:
                w.write_batch(b.take(pa.array(i + s)))
            yield p, ROWS, b"", sink.getvalue().to_pybytes()


def _block(docs: list[tuple[int, int, np.ndarray]], route: Route, turn: int) -> Iterator[tuple]:
    docs.sort(key=lambda d: d[0])
    flat = np.concatenate([d[2] for d in docs])
    lens = np.array([len(d[2]) for d in docs])
    h, h2 = window_hashes(flat)
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    own = np.repeat(np.arange(len(docs)), lens)[: len(h)]
    place = np.arange(len(h)) - starts[own]
    at = np.flatnonzero(place <= lens[own] - WINDOW)
    h, h2, own, place = h[at], h2[at], own[at], place[at]
    ids = np.array([d[0] for d in docs], np.int64)
    order = np.argsort(h, kind="stable")
    new = np.r_[True, (h[order[1:]] != h[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])]
    first = order[new]
    least = np.empty(len(h), np.int64)
    least[order] = ids[own[first]][np.cumsum(new) - 1]
    first.sort()
    part = part_of(h2[first], route.n)
    for p, i in route.deal(part, turn):
        yield windows_row(p, ids[own[first[i]]], h[first[i]], part[i] if route.width > 1 else None)
    again = np.flatnonzero(ids[own] > least)
    if len(again):
        s = np.flatnonzero(np.r_[True, (np.diff(again) != 1) | (own[again[1:]] != own[again[:-1]])])
        spans = np.zeros(len(s), SPAN)
        spans["doc"], spans["start"], spans["n"] = ids[own[again[s]]], place[again[s]], np.diff(np.r_[s, len(again)])
        spans["crc"] = np.array([d[1] for d in docs], np.uint32)[own[again[s]]]
        for p, i in route.deal(id_part(spans["doc"], route.n), turn):
            yield p, SPANS, b"", spans[i].tobytes()


def _windows(route: Route):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, docs, size, turn = WordHash(), [], 0, TaskContext.get().partitionId()
        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                doc, words = i.as_py(), words_of(t.as_py())
                if doc is None or len(words) < WINDOW:
                    continue
                docs.append((doc, zlib.crc32(b" ".join(words)), memo.of(words)))
                size += len(words)
                if size >= BLOCK:
                    yield batch(FOUND, *map(list, zip(*_block(docs, route, turn), strict=True)))
                    docs, size, turn = [], 0, turn + 1
        if docs:
            yield batch(FOUND, *map(list, zip(*_block(docs, route, turn), strict=True)))

    return run


def _repeats(route: Route):
    """The smallest document of each window of a partition; what was found goes to the partitions of the documents concerned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, turn = [], [], TaskContext.get().partitionId()
        for b in batches:
            passed = []
            for p, kind, d, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if kind == WINDOWS:
                    hashes.append(data)
                    docs.append(from_runs(d))
                elif route.width == 1:
                    passed.append((p, kind, d, data))
                else:  # on its way again to a partition that it is in already
                    passed += [(q, kind, d, np.frombuffer(data, SPAN)[i].tobytes()) for q, i in route.deal(id_part(np.frombuffer(data, SPAN)["doc"], route.n), turn)]
            if passed:
                yield batch(FOUND, *map(list, zip(*passed, strict=True)))
        if not hashes:
            return
        h, doc = np.frombuffer(b"".join(hashes), np.uint64), np.concatenate(docs)
        del hashes, docs
        order = np.argsort(h)
        starts, counts = runs(h[order])
        many = counts > 1
        order = order[np.repeat(many, counts)]
        counts = counts[many]
        if not len(order):
            return
        least = np.minimum.reduceat(doc[order], np.r_[0, np.cumsum(counts)[:-1]])
        order = order[doc[order] > np.repeat(least, counts)]
        order = order[np.argsort(doc[order], kind="stable")]
        out = [(p, HASHES, run_length(doc[order[i]]), h[order[i]].tobytes()) for p, i in route.deal(id_part(doc[order], route.n), turn)]
        if out:
            yield batch(FOUND, *map(list, zip(*out, strict=True)))

    return run


def _pack(route: Route):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in batches:
            if out := list(_row_blocks(b, lambda part: route.deal(part, turn), route.n)):
                yield batch(FOUND, *map(list, zip(*out, strict=True)))
            turn += 1

    return run


def _apply(fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, spans, hashes, docs, memo = [], [], [], [], WordHash()
        for b in batches:
            for kind, d, data in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if kind == ROWS:
                    rows.append(data)
                elif kind == SPANS:
                    spans.append(data)
                else:
                    hashes.append(data)
                    docs.append(from_runs(d))
        span = np.frombuffer(b"".join(spans), SPAN)
        span = span[np.argsort(span["doc"], kind="stable")]
        h, doc = np.frombuffer(b"".join(hashes), np.uint64), np.concatenate([np.zeros(0, np.int64), *docs])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
        del spans, hashes, docs

        def gone_of(i: int, words: list[bytes]) -> np.ndarray:
            gone = np.zeros(len(words) + 1, np.int32)
            if len(words) >= WINDOW:
                mine = h[slice(*np.searchsorted(doc, [i, i + 1]))] if len(doc) else h
                if len(mine):
                    at = np.flatnonzero(np.isin(window_hashes(memo.of(words))[0], mine))
                    np.add.at(gone, at, 1), np.add.at(gone, at + WINDOW, -1)
                local = span[slice(*np.searchsorted(span["doc"], [i, i + 1]))] if len(span) else span
                if len(local):
                    local = local[local["crc"] == zlib.crc32(b" ".join(words))]
                    np.add.at(gone, local["start"], 1), np.add.at(gone, local["start"].astype(np.int64) + local["n"] + WINDOW - 1, -1)
            return np.cumsum(gone[:-1]) > 0

        while rows:
            yield _kept(pa.ipc.open_stream(rows.pop()).read_all().combine_chunks().to_batches()[0], fields, gone_of)

    return run


KEPT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def _kept(b: pa.RecordBatch, fields: list[str], gone_of) -> pa.RecordBatch:
    """(row, kept) of rows (id, text, their columns); gone_of(id, words) says which words go."""
    out = []
    for i, t in zip(b.column(0), b.column(1), strict=True):
        words = words_of(t.as_py())
        removed = gone_of(i.as_py(), words)
        kept = b" ".join(words if not removed.any() else [w for w, r in zip(words, removed.tolist(), strict=True) if not r])
        s, n = runs(removed)
        cut = [{"start": int(x), "length": int(y)} for x, y in zip(s, n, strict=True) if removed[x]]
        out.append((len(words), int(removed.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest(), cut))
    row = pa.StructArray.from_arrays([b.column(k) for k in range(2, b.num_columns)], names=fields)
    kept = pa.array([dict(zip(("n_words", "n_removed", "kept_text", "kept_sha256", "spans"), x, strict=True)) for x in out], KEPT)
    return pa.RecordBatch.from_arrays([row, kept], names=["row", "kept"])


def _as_they_are(fields: list[str]):
    """Rows that keep all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                yield _kept(b.slice(s, 1024), fields, lambda _, words: np.zeros(len(words), bool))

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every input row as `row`, and `kept`: n_words, n_removed, kept_text, kept_sha256, spans.

    Words are runs of characters other than space, tab and line ends, unchanged. A word goes if a window of 13
    words that covers it also starts in a document with a smaller doc_id; windows are judged on the input. spans are
    the maximal removal intervals (word numbers from 0); kept_text has the kept words joined by one space. A null or
    empty text has no words. A document of fewer than 13 words keeps all. Rows with equal doc_id are no copies of each
    other. A row whose doc_id is null keeps all its words and is no one's original. An empty table gives an empty result.
    """
    route = Route.to(partitions(docs, 48))
    # rows without an id have nothing to look for and stay where they are; in a Parquet table without such rows, its statistics say so
    every, nameless = docs, docs.where(F.col("doc_id").isNull())
    docs = docs.where(F.col("doc_id").isNotNull())
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = route.exchange(base.mapInArrow(_windows(route), FOUND_SQL)).mapInArrow(_repeats(route), FOUND_SQL)
    carried = lambda df: df.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text"), *(df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(df.columns)))
    rows = carried(docs).mapInArrow(_pack(route), FOUND_SQL)
    schema = T.StructType([T.StructField("row", every.schema), T.StructField("kept", RESULT)])
    with_id = route.exchange(rows.unionByName(found)).mapInArrow(_apply(every.columns), schema)
    return with_id.unionByName(carried(nameless).mapInArrow(_as_they_are(every.columns), schema))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    return remove_repeats(docs.select("doc_id", "text")).select("row.doc_id", "kept.n_words", "kept.n_removed", "kept.kept_sha256")
