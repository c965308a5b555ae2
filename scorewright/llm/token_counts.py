"""Count-only Viterbi for unigram vocabularies.

An Aho-Corasick automaton enumerates the vocabulary pieces in a text; dynamic programming over their ends keeps the best
score and its number of pieces, never the path. The tie rule is that of the `tokenizers` library's Unigram model, whose counts
these are: starts are visited from left to
right and a later candidate replaces a kept one only if its score is higher. A character that no single-character
piece covers is an unknown piece (lowest score less 10); runs of unknown pieces count once, or once for each UTF-8 byte
with byte fallback. Blanks are the meta symbol, and a text gets one before it unless it starts with one.

A text is cut into chunks, each a run of blanks and what follows it: no piece goes on after a blank that follows another
character (`Counter` raises if one does), so a text's count is the sum of its chunks'. Short chunks are memoised. A state holds
scores of the last characters only, as far back as the longest piece, so that a chunk of any length takes bounded memory.

The box's public files hold no unigram model, so the query uses all pieces and scores of the SentencePiece file: the scores are
minus the rank, with many ties. `vocabulary` reads any such file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MEMO, SHORT_WORD, batch

META, UNKNOWN_LESS = "▁", 10.0
#: Characters of a chunk whose scores are held at a time.
STEP = 4096
#: A run of blanks and what follows it, without the first blank.
CHUNK = re.compile(" ( *[^ ]*)")
ROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("n_chars", pa.int64())])


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Normal and user-defined pieces with scores, in id order; control, unknown and byte pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


class Counter(dict):
    """chunk without its first blank -> number of tokens; a bounded memo of short chunks. Blanks are blanks here."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        if crossing := [p for p, _ in pieces if META in p.lstrip(META)]:
            raise ValueError(f"pieces go on after a blank: {crossing[:3]}")
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece not in self.auto:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_LESS
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.bytes = byte_fallback

    def __missing__(self, chunk: str) -> int:
        n = self.count(META + chunk.replace(" ", META))
        if len(chunk) <= SHORT_WORD and len(self) < MEMO:
            self[chunk] = n
        return n

    def count(self, chunk: str) -> int:
        """Tokens of a chunk with meta symbols for blanks."""
        lead, single, less = self.longest, self.single, self.unknown
        score, count, tail = [0.0], [0], [False]
        found = self.auto.iter(chunk) if len(self.auto) else iter(())
        end, piece = next(found, (-1, None))
        for start in range(0, len(chunk), STEP):
            part = chunk[start : start + STEP]
            # places before this part as far back as a piece can start, then one for each of its characters
            score, count, tail = ([*x[-lead:], *[0] * len(part)] for x in (score, count, tail))
            first = len(score) - len(part)
            shift = start - first
            for k, c in enumerate(part, first):
                best = None
                if end == k + shift:
                    here = [piece]
                    for end, piece in found:
                        if end != k + shift:
                            break
                        here.append(piece)
                    if len(here) > 1:
                        here.sort(reverse=True)  # the longest piece starts first
                    for length, s in here:
                        x = score[k - length] + s
                        if best is None or x > best:
                            best, n = x, count[k - length] + 1
                if c in single:
                    score[k], count[k] = best, n
                    continue
                x = score[k - 1] + less
                if best is None or x > best:
                    best, n, tail[k] = x, count[k - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes else not tail[k - 1]), True
                score[k], count[k] = best, n
        return count[-1]

    def text(self, text: str | None) -> tuple[int, int]:
        """(tokens, chunks) of a text."""
        if not text:
            return 0, 0
        text = text.replace(META, " ")
        bare = text.removeprefix(" ")  # a text that starts with a blank gets no other
        chunks = CHUNK.findall(f" {bare}") if bare[:1] == " " or "  " in bare else bare.split(" ")
        return sum(map(self.__getitem__, chunks)), len(chunks)


@cache
def counter(path: str, byte_fallback: bool) -> Counter:
    return Counter(vocabulary(path), byte_fallback)


def _count(path: str, byte_fallback: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(path, byte_fallback)
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            found = np.array([words.text(t) for t in texts]).reshape(-1, 2)
            yield batch(ROW, b.column(0).to_pylist(), found[:, 0], found[:, 1], [len(t or "") for t in texts])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_words (runs of blanks with what follows them), n_chars for every row. Null and empty texts have 0 tokens.

    Repeated rows and null ids are kept; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_count(vocabulary_path, byte_fallback), "doc_id long, n_tokens long, n_words long, n_chars long")
