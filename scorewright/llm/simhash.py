"""SimHash near-duplicates: fingerprints linked through the anchors of a covering code.

Fingerprints. Lower-case A-Z, words of non-blank characters, 4-word shingles with repeats (fewer words: the whole
sequence as one shingle; none: fingerprint 0). A bit is 1 if it is set in over half of the shingles' XXH64 values.

Anchors. A part of the fingerprint's bits is cut into blocks that carry perfect codes (Golay [23,12] of covering
radius 3, Hamming [15,11] and [7,4] of radius 1) or all words (radius 0). The codewords of their direct sum are the
anchors: every bit string has one within the blocks' radii. Two fingerprints at distance 4 or less differ in 2 bits
or fewer on one of two halves, so a point midway on that half is within 1 of both; the midpoint's anchor is within
the radius plus 1 of both. Each fingerprint is replicated to every anchor of either half within radius plus 1
(20 of 2^19 on average), and fingerprints are compared per anchor. For tables over `FINE_FROM` fingerprints one code
on all 64 bits (2^38 anchors, radius plus 2, some 200 replicas) keeps the groups small. Both are exact: no pair is lost.

Equal fingerprints are one point. Groups are searched breadth first and give a spanning forest, not all pairs, so a
family of copies costs its size. A group too large for direct comparison is cut by equal bands of bits (distance 4
leaves one of five bands equal), which loses no pair either. Anchors that would gather more than `HOT` fingerprints are
found beforehand by counting in cells; their fingerprints get salts, and each pair of salts is a block of its own that
holds `HOT` at most. Every two fingerprints meet in a block, so a task's memory is bounded whatever the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import batch, checkpointed, dealt, looked_up, mix, part_of, partitions
from .graph import components

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: Blocks (bits, radius) of each part. 0 bits of radius: every word is a codeword.
HALVES = (((23, 3), (7, 1), (2, 0)), ((23, 3), (7, 1), (2, 0)))
WHOLE = (((23, 3), (23, 3), (15, 1), (3, 0)),)
FINE_FROM = 1 << 27
#: Shingles hashed at a time; group size from which bands are used.
SHINGLES, BANDED = 1 << 18, 4096
#: Fingerprints compared in one block at most; cells of a partition in which they are counted.
HOT, CELLS = 1 << 20, 64
FPS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
KEYED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])
POINTS = pa.schema([("p", pa.int32()), ("anchor", pa.binary()), ("fp", pa.binary()), ("node", pa.binary())])
COUNTS = pa.schema([("cell", pa.int64()), ("n", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint from each run of counts[i] hashes; all counts are 1 or more."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, np.r_[0, np.cumsum(counts)[:-1]], axis=0, dtype=np.int32)
    return np.packbits(sums * 2 > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, at, ends = b" ".join(words), [0], []
    for w in words:
        ends.append(at[-1] + len(w))
        at.append(ends[-1] + 1)
    if not words:
        return []
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], SEED) for s, e in zip(at, ends[SHINGLE - 1 :], strict=False)]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(FPS, b.column(0), _folded(b))


def _fingerprint_keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(KEYED, b.column(0), b.column(2), _folded(b))


def _folded(b: pa.RecordBatch) -> list[int]:
    """Fingerprints of the texts in a batch's second column."""
    fps, held, counts, where = [0] * b.num_rows, [], [], []

    def flush(fps=fps, held=held, counts=counts, where=where):
        if held:
            for k, f in zip(where, fold(np.concatenate(held), np.array(counts)).view(np.int64).tolist(), strict=True):
                fps[k] = f
        held.clear(), counts.clear(), where.clear()

    room = SHINGLES
    for k, text in enumerate(b.column(1)):
        if h := shingle_hashes(text.as_py()):
            if len(h) > SHINGLES:  # a very long document is folded by itself, in pieces
                a, sums = np.array(h, np.uint64), np.zeros(64, np.int64)
                for s in range(0, len(a), SHINGLES):
                    sums += np.unpackbits(a[s : s + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
                fps[k] = int(np.packbits(sums * 2 > len(a), bitorder="little").view(np.int64)[0])
                continue
            held.append(np.array(h, np.uint64)), counts.append(len(h)), where.append(k)
            room -= len(h)
            if room <= 0:
                flush()
                room = SHINGLES
    flush()
    return fps


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprint, "doc_id long, fp long")


@cache
def parity(bits: int) -> np.ndarray:
    """Syndrome of each single bit of a block."""
    if bits == 23:  # the Golay code: remainders modulo x^11+x^10+x^6+x^5+x^4+x^2+1
        out, r = [], 1
        for _ in range(23):
            out.append(r)
            r = r << 1 ^ (0xC75 if r >> 10 & 1 else 0)
        return np.array(out)
    return np.arange(1, bits + 1)  # Hamming: all non-zero syndromes


@cache
def offsets(bits: int, radius: int, excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns to codewords within radius + excess: patterns by syndrome and excess, starts, counts by excess."""
    if radius == 0:
        by = {0: [(max(0, w), sum(1 << i for i in c)) for w in range(excess + 1) for c in combinations(range(bits), w)]}
        size = 1
    else:
        size, by = 1 << (11 if bits == 23 else bits.bit_length()), {}
        columns = parity(bits).tolist()
        for w in range(radius + excess + 1):
            for c in combinations(range(bits), w):
                s = 0
                for i in c:
                    s ^= columns[i]
                by.setdefault(s, []).append((max(0, w - radius), sum(1 << i for i in c)))
    flat, starts, counts = [], np.zeros(size, np.int64), np.zeros((size, excess + 1), np.int64)
    for s in range(size):
        mine = sorted(by.get(s, []))
        starts[s] = len(flat)
        counts[s] = [sum(x <= e for x, _ in mine) for e in range(excess + 1)]
        flat += mine
    return np.array(flat, np.int64), starts, counts


@cache
def syndromes(bits: int) -> np.ndarray:
    table = np.zeros(1, np.int32)
    for c in parity(bits):
        table = np.concatenate([table, table ^ int(c)])
    return table


def anchors(fp: np.ndarray, parts=HALVES) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor key) for every anchor that each fingerprint is replicated to."""
    rows, keys, shift = [], [], 0
    for number, blocks in enumerate(parts):
        excess = DISTANCE // len(parts) // 2
        row, key, left = np.arange(len(fp)), np.zeros(len(fp), np.uint64), np.full(len(fp), excess)
        for bits, radius in blocks:
            own = (fp >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)[row]
            patterns, starts, counts = offsets(bits, radius, excess)
            s = syndromes(bits)[own] if radius else np.zeros(len(own), np.int64)
            n = counts[s, left]
            at = np.repeat(starts[s] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            word = np.repeat(own, n) ^ patterns[at, 1]
            row, left = np.repeat(row, n), np.repeat(left, n) - patterns[at, 0]
            key = np.repeat(key, n) | word.astype(np.uint64) << np.uint64(shift)
            shift += bits
        rows.append(row)
        keys.append(mix(key + np.uint64(number)))  # a bijection for each part; the two parts rarely share a key, which costs a comparison only
    return np.concatenate(rows), np.concatenate(keys)


def forest(fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (seed's nodes, members' nodes) that span the components of one group."""
    left, chain = np.arange(1, len(fp)), [0]
    seed = 0
    while len(left) or chain:
        if not chain:
            seed, left = left[0], left[1:]
            chain = [seed]
        x = chain.pop()
        near = np.bitwise_count(fp[left] ^ fp[x]) <= DISTANCE
        if near.any():
            new = left[near]
            left = left[~near]
            chain += new.tolist()
            yield np.full(len(new), node[seed]), node[new]


def group_links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, banded: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links within the groups of equal keys."""
    order = np.argsort(key, kind="stable")
    key, fp, node = key[order], fp[order], node[order]
    starts, sizes = runs_of(key)
    pairs = np.flatnonzero(sizes == 2)
    i = starts[pairs]
    hit = np.bitwise_count(fp[i] ^ fp[i + 1]) <= DISTANCE
    yield node[i[hit]], node[i[hit] + 1]
    few = np.flatnonzero((sizes > 2) & (sizes <= 64))
    member = np.zeros(len(key), bool)
    for s, n in zip(starts[few], sizes[few], strict=True):
        member[s : s + n] = True
    at = np.flatnonzero(member)
    for k in range(1, 64):  # all pairs of small groups, k places apart
        at = at[at + k < len(key)]
        at = at[key[at + k] == key[at]]
        if not len(at):
            break
        j = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= DISTANCE]
        yield node[j], node[j + k]
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        f, d = fp[s : s + n], node[s : s + n]
        if n < BANDED or not banded:
            yield from forest(f, d)
        else:
            for low, width in zip((0, 13, 26, 39, 52), (13, 13, 13, 13, 12), strict=True):
                yield from group_links(f >> np.uint64(low) & np.uint64((1 << width) - 1), f, d, banded=False)


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def _count(cells: int, parts, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, np.int64)
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for s in range(0, len(fps), 20_000):
                cell, n = np.unique(part_of(mix(anchors(fps[s : s + 20_000], parts)[1]), cells), return_counts=True)
                seen[cell] += n
        at = np.flatnonzero(seen >= least)
        yield batch(COUNTS, at, seen[at])

    return run


def hot_cells(points: DataFrame, n: int, parts, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (of CELLS * n) with more than `hot` replicas, sorted, and the number of salts of each.

    A task reports a cell only where it holds its share of hot / 2, so that even data report next to nothing; what is
    left out of a cell is less than hot / 2 over all tasks, which the limit and the salts allow for.
    """
    tasks = 1 + (points.select(F.spark_partition_id().alias("t")).agg(F.max("t")).first()[0] or 0)
    counts = points.select("fp").mapInArrow(_count(CELLS * n, parts, -(-hot // (2 * tasks))), "cell long, n long")
    rows = counts.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > hot // 2).orderBy("cell").collect()  # cells, in proportion to the partitions, at most
    return np.array([r["cell"] for r in rows], np.int64), np.array([-(-2 * (r["n"] + hot // 2) // hot) for r in rows], np.int64)


def salted(row: np.ndarray, key: np.ndarray, fp: np.ndarray, cells: int, hot: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) with the replicas of hot cells dealt to blocks, one for each pair of salts that a fingerprint's own is in."""
    cell = part_of(mix(key), cells)
    at = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
    is_hot = hot[at] == cell
    if not is_hot.any():
        return row, key
    many = salts[at[is_hot]]
    own = (mix(fp[row[is_hot]] ^ np.uint64(SEED)) % many.astype(np.uint64)).astype(np.int64)
    other = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    own, size = np.repeat(own, many), np.repeat(many, many)
    block = np.minimum(own, other) * size + np.maximum(own, other)
    keys = mix(np.repeat(key[is_hot], many) ^ mix(block.astype(np.uint64) + np.uint64(1)))
    return np.r_[row[~is_hot], np.repeat(row[is_hot], many)], np.r_[key[~is_hot], keys]


def _replicate(n: int, parts, hot: np.ndarray, salts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 20_000 if not len(hot) else max(1, 20_000 // int(salts.max()))
        for b in batches:
            fps, nodes = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for s in range(0, len(fps), step):
                row, key = anchors(fps[s : s + step], parts)
                if len(hot):
                    row, key = salted(row, key, fps[s : s + step], CELLS * n, hot, salts)
                f, d = fps[s : s + step][row], nodes[s : s + step][row]
                out = [(p, key[i].tobytes(), f[i].tobytes(), d[i].tobytes()) for p, i in dealt(part_of(mix(key), n))]
                yield batch(POINTS, *map(list, zip(*out, strict=True))) if out else batch(POINTS, [], [], [], [])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(a, f, d) for b in batches for a, f, d in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
    if not got:
        return
    key, fp = (np.frombuffer(b"".join(x[k] for x in got), np.uint64) for k in (0, 1))
    node = np.frombuffer(b"".join(x[2] for x in got), np.int64)
    del got
    for a, b in group_links(key, fp, node):
        if len(a):
            yield batch(LINKS, np.minimum(a, b), np.maximum(a, b))


def links(points: DataFrame, many: bool = False, hot: int = HOT) -> DataFrame:
    """Distinct links (a, b) of points(fp, node) that span all pairs at DISTANCE bits or fewer; hot: size of a block."""
    parts = WHOLE if many else HALVES
    n = max(partitions(points), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt_out = points.select("fp", "node").mapInArrow(_replicate(n, parts, *hot_cells(points, n, parts, hot)), "p int, anchor binary, fp binary, node binary").repartitionById(n, "p")
    return dealt_out.mapInArrow(_compare, "a long, b long").distinct()


def labels(fps: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(fp, root, n) of the fingerprints of fps(fp): root is the smallest linked, directly or over others, n their number of rows.

    also: further links (a, b) between fingerprints.
    """
    points = checkpointed(fps.groupBy("fp").agg(F.count("*").alias("n")))
    found = links(points.select("fp", F.col("fp").alias("node")), points.count() > FINE_FROM)
    found = components(found if also is None else found.unionByName(also))
    return points.join(found, points["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"), "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included), for every row.

    Null and empty texts have fingerprint 0 and link like any other. Rows with one doc_id are one document: their
    fingerprints share a component. Rows whose doc_id is null link like others but give no name: theirs is that of their
    component's other rows, null if there are none. An empty table gives an empty result.
    """
    fps = checkpointed(fingerprints(docs))
    ends = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("a <> b")
    ends = checkpointed(ends)  # documents with several fingerprints
    repeated = looked_up(fps.join(ends.select("doc_id"), "doc_id", "left_semi"), ends, "doc_id", "a").select("a", F.col("fp").alias("b")) if not ends.isEmpty() else None
    found = checkpointed(labels(fps, repeated))
    rooted = looked_up(fps, found, "fp", "root")
    names = checkpointed(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")))
    return looked_up(rooted, names, "root", "component_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...), whole, one of each component of near-duplicates: that of the smallest doc_id.

    Each row goes by itself: rows with one doc_id are linked only if their texts are. Of rows with one doc_id in a component that
    of the smallest text hash stays, of rows equal in doc_id and text one; a null doc_id counts as larger than any. An
    empty table stays empty.
    """
    key, h = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    own = docs.select(key.alias("doc_id"), docs["text"].cast("string").alias("text"), h.alias("h"))
    fps = checkpointed(own.mapInArrow(_fingerprint_keyed, "doc_id long, h long, fp long"))
    rooted = looked_up(fps, checkpointed(labels(fps)), "fp", "root")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h")
    best = checkpointed(rooted.groupBy("root").agg(F.min(row).alias("best"), F.count("*").alias("n")))
    fate = looked_up(rooted, best, "root", "best").groupBy("doc_id", "h").agg(F.min(F.when(row == F.col("best"), 0).otherwise(1)).alias("gone"), F.count("*").alias("n")).where("gone = 1 or n > 1")
    fate = checkpointed(fate.select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "gone"))  # rows that go, and those that repeat
    same = key.eqNullSafe(fate["_doc"]) & (h == fate["_h"])
    left = docs.join(fate, same, "left_anti").select(*(docs[f"`{c}`"] for c in docs.columns))
    again = fate.where("gone = 0")
    if again.isEmpty():
        return left
    one = F.row_number().over(Window.partitionBy(again["_doc"], again["_h"]).orderBy(again["_h"])) == 1
    copies = docs.join(again, same).select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), one.alias("one")).where("one")
    return left.unionByName(copies.select("row.*"))
