"""Merge rounds against the sentencepiece library: ids and decoded texts, of given and odd texts and of made vocabularies."""

import hashlib
import random

import numpy as np
import pytest

from scorewright.llm import piece_bpe as B
from scorewright.llm.queries import queries, table, tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return B.pieces(PATH)


def odd_texts():
    r = random.Random(3)
    out = ["", " ", "   ", "▁", "▁▁a", " ▁ a▁", "a" * 3000, "abab" * 300, "aaab" * 100, "\x00\n\t", "😀é漢字<0x0A><s></s>", " 　 ", "the" + " " * 50 + "x ", "x" * 200 + " " * 200 + "\n" * 90]
    out += [" " * k + tail for k in range(70) for tail in ("", "a", "\n")]
    out += ["".join(r.choice("abcdeiou  the\né漢") for _ in range(r.randint(1, 300))) for _ in range(600)]
    return out + ["".join(r.choice("ab") for _ in range(r.randint(1, 200))) for _ in range(300)]


def test_odd_texts_have_the_librarys_ids(model, library):
    texts = odd_texts() + [library.id_to_piece(i) + library.id_to_piece(32003 - i) for i in range(259, 31000, 7)]
    got = [x.tolist() for x in model.encoded(texts)]
    assert got == library.encode(texts)
    assert [model.decoded(np.array(x, np.int64)) for x in got] == [library.decode(x) for x in got]
    assert [x.tolist() for x in model.encoded(texts)] == got  # from the memo


def test_any_ids_decode_like_the_library(model, library):
    r = random.Random(5)
    rows = [[r.randrange(32000) if r.random() < 0.6 else r.randrange(0, 259) for _ in range(r.randint(0, 12))] for _ in range(2000)]
    assert [model.decoded(np.array(x, np.int64)) for x in rows] == [library.decode(x) for x in rows]


def test_long_words_take_few_rounds(model, library):
    for text in (" " * 300_000 + "x", "ab" * 100_000, "".join(random.Random(1).choices("abcXYZ019+/", k=100_000))):
        assert model.encoded([text])[0].tolist() == library.encode(text)
    assert max(map(len, model)) <= B.SHORT_WORD  # long words stay out of the memo


def one_at_a_time(pieces, word):
    """The best pair, leftmost first, one after another."""
    score, parts = {p: s for _, p, s in pieces}, list(word)
    while True:
        best = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
        if not best:
            return parts
        i = min(best)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_scores_in_any_order_merge_as_one_after_another():
    r = random.Random(11)
    for trial in range(150):
        words = {"".join(r.choices("abc", k=r.randint(2, 4))) for _ in range(r.randint(1, 14))}
        pieces = [(i, p, float(r.randint(-6, 0))) for i, p in enumerate(sorted({"a", "b"} | words))]  # many ties, longer pieces may come first
        m = B.Merges(pieces)
        texts = ["".join(r.choices("abcd", k=r.randint(1, 25))) for _ in range(20)]
        begin = np.cumsum([0, *map(len, texts)])
        place = m.merged(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), begin[:-1])[1]
        for s, e, t in zip(begin, begin[1:], texts, strict=False):
            cut = place[(place >= s) & (place < e)] - s
            assert [t[x:y] for x, y in zip(cut, [*cut[1:], len(t)], strict=True)] == one_at_a_time(pieces, t), (trial, t, pieces)


def test_rows_of_any_kind(spark, library):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (None, "  é\n", None), (3, "lang " * 60_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing name
    got = B.encode(df, PATH, decode=True).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in got) == sorted((i or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    back = B.decode(B.encode(df, PATH).select("doc_id", "ids"), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, library.decode(library.encode(t or ""))) for i, t, _ in rows)
    assert B.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), PATH).collect()[0].text is None
    assert B.encode(df.limit(0), PATH).count() == 0


def test_query_has_the_librarys_digests(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in queries()["op12_sentencepiece"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    want = {}
    for i, t in table(spark, SF, "documents").select("doc_id", "text").collect():
        ids = library.encode(t or "")
        want[i] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))))
    assert got == want
