"""Byte-level BPE ids by a public tokenizer file, from memoised words.

`tokenizers` defines the ids. Its merges are read into `tiktoken`, which gives the same ids faster, and words are
looked up in a bounded memo. A text is cut before each space that follows a non-blank character; no token of the
byte-level pattern crosses such a place. Texts with runs of blanks go to tiktoken whole, and texts that hold a special
token's string, or characters outside the Latin blocks, go to `tokenizers` itself.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np

#: Words kept with their ids, and the longest that is kept; others are encoded anew.
MEMO, SHORT_WORD = 250_000, 64
#: Blank characters next to a space, where cutting at single spaces could cut inside a token.
RUN = re.compile(r"\s \S|\s\s ?|^ | $|[^\S \n]")
OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧]")


class Words(dict):
    def __init__(self, tokenizer):
        self.t = tokenizer

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.t.fast.encode_ordinary(" " + word)).tobytes()  # 32 bits each
        if len(word) <= SHORT_WORD and len(self) < MEMO:
            self[word] = ids
        return ids


class ByteBpe:
    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        # the pattern of the byte-level pre-tokenizer
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = Words(self)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text, as uint32; none for a null text."""
        if not text:
            return np.zeros(0, np.uint32)
        if OTHER.search(text) or self.special and self.special.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        if RUN.search(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        first, *rest = text.split(" ")
        head = np.array(self.fast.encode_ordinary(first), np.uint32).tobytes()
        return np.frombuffer(head + b"".join(map(self.words.__getitem__, rest)), np.uint32)


@cache
def byte_bpe(path: str) -> ByteBpe:
    """One tokenizer for each worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBpe(path)
