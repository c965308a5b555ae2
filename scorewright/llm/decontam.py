"""Benchmark decontamination by spaced seeds.

Words (letters and digits, lower case; scripts without blanks: characters) are hashed. A spaced seed is a fixed mask over a few
consecutive words that ignores some of them, so that a substitution at an ignored place leaves the hash unchanged. Masked
hashes of documents and benchmark items are joined. A hit names a diagonal (an item held against a place of a document), and
each diagonal that is hit is verified whole: its overlaps are the longest stretches that meet the declared rule.

The masks miss no overlap. An overlap of 20 words or more falls into parts of 10 to 19, one of which has 0.8 of its words equal,
so 8 of them; and every pattern of up to 19 words with 8 equal ones and 0.8 equal holds one of `MASKS` whole
(a test goes through them all). Items of 5 to 8 words need fewer equal words and have masks of their own.

The benchmark side is cut into shards of at most some `SHARD` words (`_shards`; one item is never cut, so a longer one makes a shard of its own
size); each shard's seed table is broadcast, so its size is bounded whatever the benchmark's size, and documents are read
once for each shard. Items with equal texts are one class, named by its smallest item_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import MEMO, SHORT_WORD, batch, filtered, mix

#: Fixed masks (1: compared) for all items, and those for items of `FEWEST` to 8 words.
MASKS, SHORT_MASKS = ("110111", "11010011", "11100101"), ("1101", "1011")
LEAST_WORDS, IDENTITY, FEWEST = 8, 0.8, 5
SHARD = 1_000_000
#: Documents' words joined at a time; pairs of words compared at a time.
BLOCK, PAIRS = 1 << 18, 1 << 20
HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("equal_items", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64()), ("matches", pa.int64()), ("item_words", pa.int64())])
HITS_SQL = "doc_id long, item_id long, equal_items long, doc_start long, item_start long, length long, matches long, item_words long"
CLEAN = re.compile(r"[\W_]+")
#: Scripts written without blanks: each character is a word.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


class Normal(dict):
    """word -> hash of its letters and digits in lower case, 0 if it has none; a bounded memo of short words."""

    def __missing__(self, word: str) -> int:
        bare = CLEAN.sub("", word.lower())
        h = xxhash.xxh64_intdigest(bare.encode("utf-8", "surrogatepass"), 7) if bare else 0
        if len(word) <= SHORT_WORD and len(self) < MEMO:
            self[word] = h
        return h

    def text(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not text.isascii():
            text = UNSPACED.sub(r" \g<0> ", text)
        words = text.split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return h[h != 0]


def seeds(flat: np.ndarray, mask: str) -> np.ndarray:
    """Masked hash at each place where the whole mask fits."""
    m = len(flat) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += flat[j : j + m]
    return mix(h)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, .. (sizes[i] of them) one after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def pieces(weight: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose weights add up to most, or hold one entry."""
    ends, s = np.cumsum(weight), 0
    while s < len(weight):
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")))
        yield slice(s, e)
        s = e


def stretches(same: np.ndarray, need: int, identity: Fraction) -> list[tuple[int, int, int]]:
    """(start, end, equal words) of a diagonal's overlaps, from left to right.

    An overlap starts and ends with equal words, has `need` of them or more and `identity` of its words equal. The
    longest one is taken (then that with more equal words, then the leftmost), and again from what lies on either side.
    """
    out, todo = [], [(0, len(same))]
    score = np.r_[0, np.cumsum(np.where(same, identity.denominator - identity.numerator, -identity.numerator))]
    equal = np.r_[0, np.cumsum(same)]
    while todo:
        a, b = todo.pop()
        if equal[b] - equal[a] < need:
            continue
        low = np.minimum.accumulate(np.where(same[a:b], score[a:b], np.iinfo(np.int64).max))
        ends = a + np.flatnonzero(same[a:b]) + 1
        first = a + np.searchsorted(-low, -score[ends], "left")  # leftmost place with equal words whose score is not higher
        size = ends - first
        top = np.flatnonzero(size == size.max())
        k = top[np.argmax(equal[ends[top]] - equal[first[top]])]
        s, e = int(first[k]), int(ends[k])
        if equal[e] - equal[s] >= need:
            out.append((s, e, int(equal[e] - equal[s])))
            todo += [(a, s), (e, b)]
    return sorted(out)


class Seeds:
    """Masked hashes of some items, sorted, with a bit table that turns most lookups away."""

    def __init__(self, mask: str, items: list[tuple[int, np.ndarray]]):
        parts = [(seeds(w, mask), k) for k, w in items]
        h = np.concatenate([np.zeros(0, np.uint64), *(s for s, _ in parts)])
        order = np.argsort(h, kind="stable")
        self.mask, self.hashes = mask, h[order]
        self.item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(s), k) for s, k in parts)])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(s)) for s, _ in parts)])[order]
        bits = max(16, len(h).bit_length() + 6)
        self.seen, self.shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        self.seen[(h >> self.shift).astype(np.int64)] = True

    def hits(self, flat: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in flat, items, places in the items) of equal seeds, some at a time; own: each word's row."""
        s = seeds(flat, self.mask)
        if not len(s) or not len(self.hashes):
            return
        place = np.flatnonzero(self.seen[(s >> self.shift).astype(np.int64)])
        place = place[own[place] == own[place + len(self.mask) - 1]]
        lo, hi = np.searchsorted(self.hashes, s[place], "left"), np.searchsorted(self.hashes, s[place], "right")
        some = lo < hi
        place, lo, n = place[some], lo[some], (hi - lo)[some]
        for part in pieces(n, PAIRS):
            k = ragged(lo[part], n[part])
            yield np.repeat(place[part], n[part]), self.item[k], self.place[k]


class Table:
    """The items of a shard: ids, words, and seeds for each mask."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], least: int = LEAST_WORDS, identity: float = IDENTITY):
        self.ids, self.equal_items = [i for i, _, _ in items], [n for _, n, _ in items]
        self.size = np.array([len(w) for _, _, w in items], np.int64)
        self.start = np.r_[0, np.cumsum(self.size)].astype(np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *(w for _, _, w in items)])
        self.identity = Fraction(identity).limit_denominator(1000)
        self.need = np.minimum(least, -(-self.size * self.identity.numerator // self.identity.denominator))
        words = [(k, w) for k, (_, _, w) in enumerate(items) if len(w) >= FEWEST]
        self.by = [Seeds(m, words) for m in MASKS] + [Seeds(m, [x for x in words if len(x[1]) <= least]) for m in SHORT_MASKS]

    def matches(self, flat: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(row, item, place in flat, place in item, length, equal words) of all overlaps, sorted; own: each word's row, ascending."""
        found: set[tuple] = set()
        first, last = np.searchsorted(own, own, "left"), np.searchsorted(own, own, "right")
        for table in self.by:
            for p, i, j in table.hits(flat, own):
                pair = np.unique(np.stack([first[p], i, p - j, last[p]]), axis=1)  # diagonals, each once
                start, i, d, end = pair
                lo, hi = np.maximum(0, start - d), np.minimum(self.size[i], end - d)
                for part in pieces(hi - lo, PAIRS):
                    n = (hi - lo)[part]
                    same = flat[ragged((lo + d)[part], n)] == self.words[ragged((self.start[i] + lo)[part], n)]
                    ends = np.cumsum(n)
                    enough = np.add.reduceat(same, ends - n, dtype=np.int64) >= self.need[i[part]]
                    for k in np.flatnonzero(enough).tolist():
                        q = part.start + k
                        for s, e, equal in stretches(same[ends[k] - n[k] : ends[k]], int(self.need[i[q]]), self.identity):
                            found.add((int(own[start[q]]), int(i[q]), s + int(lo[q] + d[q]), s + int(lo[q]), e - s, equal))
        return sorted(found)


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id): items with equal texts are one class, named by its smallest item_id. Null ids and texts are left out."""
    items = _items(benchmark)
    return items.join(_classes(items).select("text", F.col("item_id").alias("class_id")), "text").select("item_id", "class_id")


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")


def _classes(items: DataFrame) -> DataFrame:
    return items.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))


def _shards(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int, int, str]]]:
    """(item_id, equal items, text) of different texts in shards of about `size` words; only one shard is on the driver at a time."""
    items = _classes(_items(benchmark))
    total = items.select(F.sum(F.length("text") / 4)).first()[0] or 0
    n = int(total // size) + 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield [(r["item_id"], r["n"], r["text"]) for r in part.collect()]


def _table(shared, normal: Normal, least: int, identity: float) -> Table:
    return Table([(i, n, normal.text(t)) for i, n, t in shared.value], least, identity)


def _blocks(column: pa.ChunkedArray, normal: Normal) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(number of rows, words, each word's row) of a column of texts, some `BLOCK` words at a time."""
    held, first, size = [], 0, 0
    for k, text in enumerate(column):
        held.append(normal.text(text.as_py()))
        size += len(held[-1])
        if size >= BLOCK or k == len(column) - 1:
            yield first, held, np.concatenate(held), np.repeat(np.arange(first, k + 1), [len(x) for x in held])
            held, first, size = [], k + 1, 0


def _find(shared, least: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = Normal()
        table = _table(shared, normal, least, identity)
        for b in batches:
            ids = b.column(0).to_pylist()
            for first, held, flat, own in _blocks(b.column(1), normal):
                starts = np.r_[0, np.cumsum([len(x) for x in held])].tolist()
                out = [(ids[r], table.ids[i], table.equal_items[i], p - starts[r - first], q, n, m, int(table.size[i])) for r, i, p, q, n, m in table.matches(flat, own)]
                for s in range(0, len(out), 10_000):
                    yield batch(HITS, *map(list, zip(*out[s : s + 10_000], strict=True)))

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Verified overlaps: doc_id, item_id, equal_items, doc_start, item_start, length, matches, item_words (word numbers from 0).

    An overlap is a stretch of a diagonal that starts and ends with equal words; at least `least` words are equal (or
    `identity` of an item that is shorter than that) and at least `identity` of its words are. Of stretches that cross, the
    longest counts (`stretches`). Case and punctuation are ignored; words without letters or digits don't count; in scripts
    without blanks each character is a word. None is missed for the default rule, nor for a stricter one. Items of fewer than
    `FEWEST` words are too short to be evidence and match nothing. item_id is the smallest of `equal_items` items with the same text
    (`item_classes`). Null texts and items with null ids match nothing; a document's null
    doc_id stays null; repeated rows are reported each; empty tables give an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for shard in _shards(benchmark, SHARD):
        part = own.mapInArrow(_find(docs.sparkSession.sparkContext.broadcast(shard), least, identity), HITS_SQL)
        found = part if found is None else found.unionByName(part)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and class of equal items with an overlap.

    doc_id, item_id, equal_items, n_overlaps, and of the overlap with the most equal words (then the longest): longest (its length),
    matches, coverage (matches / words of the item). Rows with one doc_id count as one document.
    """
    best: Column = F.max(F.struct("matches", "length", "item_words")).alias("best")
    pairs = overlaps(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("equal_items").alias("equal_items"), F.count("*").alias("n_overlaps"), best)
    return pairs.select("doc_id", "item_id", "equal_items", "n_overlaps", F.col("best.length").alias("longest"), F.col("best.matches").alias("matches"), (F.col("best.matches") / F.col("best.item_words")).alias("coverage"))


def _keep(shared, at: int, least: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = Normal()
        table = _table(shared, normal, least, identity)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for _, _, flat, own in _blocks(b.column(at), normal):
                keep[[m[0] for m in table.matches(flat, own)]] = False
            yield b.filter(pa.array(keep))

    return run


def uncontaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_WORDS, identity: float = IDENTITY) -> DataFrame:
    """The rows without any overlap (`overlaps`), whole and without a shuffle; each is judged by its own text, whatever its doc_id.

    `text` is a string. Null and empty texts stay, repeated rows share their fate, an empty table stays empty.
    """
    for shard in _shards(benchmark, SHARD):
        docs = filtered(docs, _keep(docs.sparkSession.sparkContext.broadcast(shard), docs.columns.index("text"), least, identity))
    return docs
