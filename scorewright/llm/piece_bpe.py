"""SentencePiece BPE ids by vectorised merge rounds, and texts from ids.

The words of many texts lie one after another in flat numpy arrays of symbols, and in each round every word looks for its pair
of the best score (a segmented minimum of ranks) and merges it, leftmost first; the arrays are then compacted, and words
without a pair leave. All occurrences of a word's best pair are merged at once, up to the first after which another pair would come
first: one whose merged symbol makes a pair of no worse score with a neighbour. So the result is that of one merge after another.

A word is a run of blanks and what follows it: no piece goes on after a blank that follows another character (`Merges`
raises if one does). Inside a word no merge crosses two characters that stand together in no piece, so long words
are cut there. Short words are kept in a bounded memo, so a word of the corpus is merged about once a worker.

This is the normal form of the file in use: blanks become the meta symbol, one is put before every text, nothing else changes;
characters without a piece become the pieces of their UTF-8 bytes. Models with other normal forms, user-defined pieces or no byte pieces are refused.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MEMO, SHORT_WORD, batch, runs

META = "▁"
#: A run of blanks and what follows it, without the first blank.
WORD = re.compile(" ( *[^ ]*)")
#: Rank of two symbols that make no piece.
NONE = np.iinfo(np.int32).max
codecs.register_error("one sign a byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
#: New characters that are merged together, numbers of a text's ids that are turned to text together.
TOGETHER, STEP = 1 << 18, 1 << 18
ROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


class Merges:
    """The pairs of symbols that make a piece. A symbol is a number: pieces come first, in id order, then characters that are no piece."""

    def __init__(self, pieces: list[tuple[int, str, float]]):
        """pieces: (id, piece, score) of all normal pieces."""
        if crossing := [p for _, p, _ in pieces if META in p.lstrip(META)]:
            raise ValueError(f"pieces go on after a blank: {crossing[:3]}")
        self.symbol = {p: k for k, (_, p, _) in enumerate(pieces)}
        for _, p, _ in pieces:
            for c in p:
                self.symbol.setdefault(c, len(self.symbol))
        scores = np.array([s for _, _, s in pieces])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32) if len(scores) else np.zeros(0, np.int32)
        self.n, self.ids = len(self.symbol), np.array([i for i, _, _ in pieces], np.int32)
        left, right, made = [], [], []
        for _, p, _ in pieces:
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(self.symbol[p])
        a, b, m = (np.array(x, np.int64) for x in (left, right, made))
        order = np.argsort(a * self.n + b)
        self.key, self.made = (a * self.n + b)[order], m[order]
        self.rank = rank[self.made]
        # symbols that can make a pair of no worse score than their own
        every = np.r_[rank, np.full(self.n - len(rank), -1, np.int32)]
        self.rising = np.zeros(self.n, bool)
        for side in (a, b):
            self.rising[side[rank[m] <= every[side]]] = True
        # characters that stand together in a piece, and characters as symbols
        self.char = np.full(0x110000, -1, np.int32)
        for c, k in self.symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = k
        self.joined = np.unique(np.array([ord(x) << 21 | ord(y) for _, p, _ in pieces for x, y in zip(p, p[1:], strict=False)], np.int64))
        # the longest piece of blanks, if every longer run falls into such pieces from its left
        self.blanks = 0
        longest = max((len(p) for _, p, _ in pieces if not p.strip(META)), default=0)
        if longest > 1 and not any(p.startswith(META * 2) and p.strip(META) for _, p, _ in pieces):
            lengths = [[], *(np.diff(np.r_[self.merged(np.full(n, ord(META), np.uint32), np.zeros(1, np.int64))[1], n]).tolist() for n in range(1, 4 * longest))]
            if all(lengths[n] == [longest, *lengths[n - longest]] for n in range(longest, 4 * longest)):
                self.blanks = longest

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """Places of one word at which no merge crosses: between characters that stand together in no piece, and in a long run of blanks."""
        pairs = codes[:-1].astype(np.int64) << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.joined, pairs), max(0, len(self.joined) - 1))
        apart = np.flatnonzero(self.joined[at] != pairs) + 1 if len(self.joined) else np.arange(1, len(codes))
        lead = int(np.argmin(np.r_[codes, 0] == ord(META)))
        return np.r_[apart, np.arange(0, lead - 1, self.blanks)] if self.blanks else apart  # the last blank may go with the word

    def found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each two symbols; -1 is a character in no piece."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        ok = (a >= 0) & (b >= 0) & (self.key[at] == key) if len(self.key) else np.zeros(len(a), bool)
        return np.where(ok, self.rank[at], NONE) if len(self.key) else np.full(len(a), NONE, np.int32), np.where(ok, self.made[at], -1) if len(self.key) else np.full(len(a), -1)

    def in_order(self, sym: np.ndarray, first: np.ndarray, hit: np.ndarray, made: np.ndarray, rank: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The hits of each segment up to the first whose merged symbol makes a pair of no worse rank with a neighbour."""
        check = np.flatnonzero(self.rising[made[hit]])
        if not len(check):
            return hit
        at = hit[check]
        x, r = made[at], rank[at]
        before = np.where((check > 0) & (hit[check - 1] == at - 2) & ~first[at - 1], made[at - 2], sym[at - 1])  # merged just before
        bad = ~first[at] & (self.found(before, x)[0] <= r)
        after = np.minimum(at + 2, len(sym) - 1)
        bad |= (after == at + 2) & ~first[after] & (self.found(x, sym[after])[0] <= r)
        if not bad.any():
            return hit
        mark = np.zeros(len(hit), np.int64)
        mark[check[bad]] = 1
        upto = np.cumsum(mark) - mark  # bad ones before each hit
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        return hit[upto == np.repeat(upto[starts], np.diff(np.r_[starts, len(hit)]))]

    def merged(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are left of words of code points, and the place where each starts; starts: places where a word starts."""
        sym, place = self.char[codes].astype(np.int64), np.arange(len(codes))
        first = np.zeros(len(codes), bool)
        first[starts] = True
        done_sym, done_place = [], []
        if len(codes):
            rank, made = np.full(len(codes), NONE, np.int32), np.full(len(codes), -1)
            inner = np.flatnonzero(~first[1:])
            rank[inner], made[inner] = self.found(sym[inner], sym[inner + 1])
        while len(sym):
            heads = np.flatnonzero(first)
            sizes = np.diff(np.r_[heads, len(sym)])
            least = np.minimum.reduceat(rank, heads)
            if (over := least == NONE).any():
                gone = np.repeat(over, sizes)
                done_sym.append(sym[gone]), done_place.append(place[gone])
                sym, place, first, rank, made = (x[~gone] for x in (sym, place, first, rank, made))
                if not len(sym):
                    break
                heads, sizes, least = np.flatnonzero(first), sizes[~over], least[~over]
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            segment = np.searchsorted(heads, hit, side="right") - 1
            new = np.r_[True, segment[1:] != segment[:-1]]
            run = np.r_[True, hit[1:] != hit[:-1] + 1] | new  # hits that overlap follow each other
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            one = new | (nth % 2 == 0)
            hit = self.in_order(sym, first, hit[one], made, rank, segment[one])
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))  # each place less the symbols that go before it
            sym, place, first, rank, made = (x[keep] for x in (sym, place, first, rank, made))
            # the pairs on both sides of a merged symbol are new
            keep = np.zeros(len(sym) + 1, bool)
            keep[now] = keep[now - 1] = True  # of the first place, the one before is the last of the array, which is none
            near = np.flatnonzero(keep[:-1])
            rank[near], made[near] = NONE, -1
            near = near[near + 1 < len(sym)]
            near = near[~first[near + 1]]
            rank[near], made[near] = self.found(sym[near], sym[near + 1])
        sym, place = np.concatenate([np.zeros(0, np.int64), *done_sym]), np.concatenate([np.zeros(0, np.int64), *done_place])
        order = np.argsort(place)
        return sym[order], place[order]


class Pieces(dict):
    """word without its first blank -> its ids as bytes of 32 bits; a bounded memo of short words. Blanks are blanks here."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        if p.normalize("  ａ  b ") != f"{META * 3}ａ{META * 2}b{META}":
            raise ValueError("another normal form than a blank before and nothing else")
        pieces, unused = range(p.get_piece_size()), [i for i in range(p.get_piece_size()) if p.is_unused(i)]
        own = {i: int(p.id_to_piece(i)[3:5], 16) for i in pieces if p.is_byte(i)}
        if len(own) != 256 or unused:
            raise ValueError("no byte pieces, or unused pieces")
        plain = [i for i in pieces if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        self.merges = Merges([(i, p.id_to_piece(i), p.get_score(i)) for i in plain])
        self.byte = np.zeros(256, np.int32)
        self.byte[list(own.values())] = list(own)
        # each id's text: a byte, nothing for a control piece, the library's sign for unknown
        shown = [bytes([own[i]]) if i in own else b"" if p.is_control(i) else " ⁇ ".encode() if p.is_unknown(i) else p.id_to_piece(i).replace(META, " ").encode() for i in pieces]
        self.shown = Table(shown)
        self.blank = np.array([p.id_to_piece(i).startswith(META) for i in pieces])

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of each word, all merged together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(np.r_[0, sizes])
        codes = np.frombuffer((META + META.join(words)).replace(" ", META).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = [begin[:-1]]
        for k in np.flatnonzero(sizes > SHORT_WORD).tolist():
            starts.append(begin[k] + self.merges.cuts(codes[begin[k] : begin[k + 1]]))
        sym, place = self.merges.merged(codes, np.concatenate(starts))
        known = (sym >= 0) & (sym < len(self.merges.ids))
        ids, count = np.zeros(len(sym), np.int32), np.ones(len(sym), np.int64)
        ids[known] = self.merges.ids[sym[known]]
        if not known.all():
            # a character without a piece becomes its bytes
            odd = np.flatnonzero(~known)
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in codes[place[odd]].tolist()]
            count[odd] = [len(r) for r in raw]
            ids = np.repeat(ids, count)
            ids[np.repeat(~known, count)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        upto = np.cumsum(np.r_[0, count])[np.searchsorted(place, begin)] * ids.itemsize
        raw, ends = ids.tobytes(), upto.tolist()
        return [raw[s:e] for s, e in zip(ends, ends[1:], strict=False)]

    def encoded(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for a null or empty one."""
        split = []
        for t in texts:
            t = (t or "").replace(META, " ")
            split.append([] if not t else WORD.findall(f" {t}") if t[0] == " " or "  " in t else t.split(" "))
        new = list(set(chain.from_iterable(split)).difference(self))
        size = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1) // TOGETHER
        for s, n in zip(*runs(size), strict=True):
            group = new[s : s + n]
            self.update(zip(group, self.learn(group), strict=True))
        out = [np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32) for words in split]
        # long words go, and those for which there is no room
        room = MEMO - len(self) + len(new)
        for w in new:
            if len(w) <= SHORT_WORD and room > 0:
                room -= 1
            else:
                del self[w]
        return out

    def decoded(self, ids: np.ndarray) -> str:
        """The text of ids; the blank before it goes. Each byte that is no UTF-8 becomes a replacement character."""
        parts = [self.shown.bytes(ids[s : s + STEP]) for s in range(0, len(ids), STEP)]
        head = ids[:1] if len(ids) and self.shown.size[ids[0]] else ids[self.shown.size[ids] > 0][:1]
        lead = len(head) and self.blank[head[0]]
        return b"".join(parts)[int(lead) :].decode("utf-8", "one sign a byte")


class Table:
    """Byte strings by number, gathered for many numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(np.r_[0, self.size[:-1]])

    def bytes(self, numbers: np.ndarray) -> bytes:
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - ends + size, size)].tobytes()


@cache
def pieces(path: str) -> Pieces:
    """One model for each worker process."""
    return Pieces(path)


def grouped(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows with about `limit` characters; a longer text comes alone."""
    held, size, first = [], 0, 0
    for k, t in enumerate(column):
        t = t.as_py()
        if held and size + len(t or "") > limit:
            yield first, held
            held, size, first = [], 0, k
        held.append(t)
        size += len(t or "")
    if held:
        yield first, held


def _encode(path: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            for first, texts in grouped(b.column(1)):
                found = model.encoded(texts)
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
                yield batch(ROW, b.column(0).slice(first, len(texts)), ids, [model.decoded(x) if decode else None for x in found])

    return run


def encode(docs: DataFrame, path: str, decode: bool = False) -> DataFrame:
    """doc_id, ids (array of int), decoded (the text of these ids, null unless asked for) for every row of (doc_id, text).

    Whole texts; null and empty ones have no ids. No begin or end ids. Repeated rows and null ids are kept; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_encode(path, decode), "doc_id long, ids array<int>, decoded string")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            texts = [None if x.as_py() is None else model.decoded(np.array([i for i in x.as_py() if i is not None], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids); null ids give a null text, none an empty one."""
    own = rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return own.mapInArrow(_decode(path), "doc_id long, text string")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and of the decoded text."""
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
