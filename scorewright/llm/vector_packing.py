"""Vector bin packing of documents into training sequences.

Each example takes tokens, one segment and loss-bearing tokens from a sequence's capacity. Bins are filled one at a
time by the dot-product heuristic: of the waiting examples that fit, take the one with the largest product of its
demand and the residual capacity (both as shares of the limits). Documents longer than a sequence fill whole ones
first. Where nothing fits a gap, or one segment is left, an example is cut so that the bin is filled; at a task's end
the last bin is cut into sequences whose sizes are powers of two, so that nothing is padded. Each task packs its own
rows from a bounded pool: there is no shuffle, and a lost task is packed again alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch
from .tokens import byte_bpe

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.binary())])
PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds: tokens, segments, loss-bearing tokens. loss None: all tokens bear loss, no own limit.

    spare: tokens that may stay empty in a sequence rather than that an example is cut which an empty sequence would hold.
    """

    tokens: int = 1024
    segments: int = 64
    loss: int | None = None
    spare: int = 0


#: Examples that wait in a task, and those left when more are read.
POOL, LOW = 2048, 1024


class Packer:
    def __init__(self, limits: Limits, first: int, ids: bool):
        self.limits, self.next, self.with_ids = limits, first, ids
        self.cap = np.array([limits.tokens, limits.segments, limits.tokens if limits.loss is None else limits.loss], np.float64)
        self.need = np.zeros((3, POOL + 8))  # a row for each limit, so that comparisons run over neighbouring numbers
        self.items: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray, loss: np.ndarray) -> None:
        """loss: 1 for each loss-bearing token. Whole sequences go out at once, the rest waits."""
        item, most = (doc, ids, np.r_[0, np.cumsum(loss)], 0), self.limits.loss
        while len(ids) - item[3] >= self.limits.tokens and (most is None or self.loss(item, self.limits.tokens) <= most):
            self.emit([(item, self.limits.tokens)])
            item = (*item[:3], item[3] + self.limits.tokens)
        if len(ids) > item[3]:
            self.put(item)
            if len(self.items) >= POOL:
                while len(self.items) > LOW:
                    self.fill()

    @staticmethod
    def loss(item: tuple, n: int) -> int:
        return int(item[2][item[3] + n] - item[2][item[3]])

    def put(self, item: tuple) -> None:
        n = len(item[1]) - item[3]
        self.need[:, len(self.items)] = n, 1, self.loss(item, n)
        self.items.append(item)
        if len(self.items) == self.need.shape[1]:
            self.need = np.concatenate([self.need, np.zeros_like(self.need)], axis=1)

    def pop(self, k: int) -> tuple:
        item, last = self.items[k], self.items.pop()
        if k < len(self.items):
            self.items[k], self.need[:, k] = last, self.need[:, len(self.items)]
        return item

    def cut(self, item: tuple, room: np.ndarray) -> int:
        """The longest head of an example that fits."""
        n = min(len(item[1]) - item[3], int(room[0]))
        return min(n, int(np.searchsorted(item[2], item[2][item[3]] + room[2], side="right")) - 1 - item[3]) if self.limits.loss is not None else n

    def fill(self, target: int | None = None) -> None:
        """One sequence of at most target tokens."""
        room, bin_ = self.cap.copy(), []
        room[0] = target or room[0]
        while self.items and room[0] > 0 and room[1] > 0:
            need = self.need[:, : len(self.items)]
            fits = (need[0] <= room[0]) & (need[2] <= room[2])  # a segment fits, as room[1] > 0
            a, b, c = room / np.maximum(self.cap, 1) / np.maximum(self.cap, 1)
            score = need[0] * a + (b + need[2] * c)
            if fits.any() and not (room[1] == 1 and need[0, fits].max() < room[0] and (need[0] >= room[0]).any()):
                k = int(np.argmax(np.where(fits, score, -1)))
                n = int(need[0, k])
            else:
                if bin_ and room[0] <= self.limits.spare and not ((need[0] > self.cap[0]) | (need[2] > self.cap[2])).any():
                    break
                k = int(np.argmax(need[0]))
                n = self.cut(self.items[k], room)
                if n <= 0:
                    break
            room -= (n, 1, self.loss(self.items[k], n))
            item = self.pop(k)
            bin_.append((item, n))
            if len(item[1]) > item[3] + n:
                self.put((*item[:3], item[3] + n))
        if not bin_:
            raise ValueError("a token needs more than an empty sequence holds")
        self.emit(bin_)

    def finish(self) -> None:
        while self.items:
            waiting = int(self.need[0, : len(self.items)].sum())
            self.fill(None if waiting >= self.limits.tokens else 1 << waiting.bit_length() - 1)

    def emit(self, bin_: list[tuple]) -> None:
        offset = 0
        for item, n in bin_:
            doc, ids, _, start = item
            raw = ids[start : start + n].astype("<u4").tobytes()
            self.out.append((doc, start, n, zlib.crc32(raw), len(ids), self.next, offset, self.loss(item, n), raw if self.with_ids else None))
            offset += n
        self.next += 1


def _document(encode, end_id: int, loss: str):
    """Ids and loss marks of a row (doc_id, text)."""

    def of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        ids = np.append(encode(text), np.uint32(end_id))
        bears = np.ones(len(ids), np.int64)
        if loss == "predicted":
            bears[0] = 0
        return ids, bears

    return of


def _pair(encode, end_id: int):
    """Ids and loss marks of a row (doc_id, prompt, answer): the answer and its end bear loss."""

    def of(prompt: str | None, answer: str | None) -> tuple[np.ndarray, np.ndarray]:
        parts = encode(prompt), encode(answer), np.array([end_id], np.uint32)
        return np.concatenate(parts), np.repeat([0, 1, 1], [len(p) for p in parts])

    return of


def _pack(path: str, limits: Limits, with_ids: bool, example):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = example(byte_bpe(path).ids)
        packer = Packer(limits, TaskContext.get().partitionId() << 36, with_ids)
        for b in batches:
            for doc, *texts in zip(*b.columns, strict=True):
                packer.add(doc.as_py(), *of(*(t.as_py() for t in texts)))
                if len(packer.out) > 5000:
                    yield batch(PIECES, *map(list, zip(*packer.out, strict=True)))
                    packer.out = []
        packer.finish()
        if packer.out:
            yield batch(PIECES, *map(list, zip(*packer.out, strict=True)))

    return run


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, ids: bool = True, loss: str = "all") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens, ids (uint32, if asked).

    A document is its text's ids and then end_id; a null or empty text is end_id alone. loss 'all': each token bears
    loss; 'predicted': all but a document's first. Each id lies in exactly one piece; a sequence's offsets run from 0
    without gaps. Repeated rows, also with one doc_id, are packed each by itself; a null doc_id stays null. sequence_id
    is unique in a run and depends on how the input is split into tasks. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_pack(tokenizer, limits, ids, lambda encode: _document(encode, end_id, loss)), PIECES_SQL)


def pack_pairs(pairs: DataFrame, tokenizer: str, limits: Limits, end_id: int = 0, ids: bool = True) -> DataFrame:
    """`pack` for instruction data: rows (doc_id, prompt, answer), of which the answer's tokens and end_id bear loss.

    A sequence holds at most so many tokens, segments and loss-bearing tokens; null prompts and answers are empty. Repeated rows and null ids are
    packed each by itself; an empty table gives an empty result.
    """
    own = pairs.select(F.col("doc_id").cast("long"), F.col("prompt").cast("string"), F.col("answer").cast("string"))
    return own.mapInArrow(_pack(tokenizer, limits, ids, lambda encode: _pair(encode, end_id)), PIECES_SQL)
