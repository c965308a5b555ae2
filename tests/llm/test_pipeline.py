"""Every stage of the pipeline on tables with nulls, repeats, empty and long texts and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorewright.llm.queries import table

SF = "/root/testdata/sf0.001"
#: Columns of documents, and names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` int, kept string, fp long, h long, gone int, _doc long, _h long, component_id long, p int, `a.b` int"


@pytest.fixture(scope="module")
def prose(spark):
    rows = table(spark, SF, "documents").where("lang = 'en' and length(text) between 800 and 4000").orderBy("doc_id").limit(6).collect()
    return [r.text for r in rows]


def made(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 2, 3, 4, 5, 6, 7, 8, 9) for i, t in pairs], SCHEMA).repartition(3)


def base(spark):
    """English documents to learn from, beside the planted rows."""
    rows = table(spark, SF, "documents").where("lang is not null").collect()
    return [(100_000 + r.doc_id, r.text) for r in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_with_odd_rows(spark, prose, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    a, b, c, *_ = prose
    planted = [(None, a), (None, a), (1, b), (1, c), (2, ""), (3, None), (4, "one word"), (5, "?? 12"), (None, None), (6, a + " " + "x" * 50_000)]
    rows = made(spark, planted + (base(spark) if name == "language_id" else []))
    got = stage(spark, rows, SF)
    assert got.columns == rows.columns and got.where("kept <> 'k' or p <> 8 or `a.b` <> 9 or gone <> 4").count() == 0
    mine = sorted((str(r.doc_id), str(r.text)[:40]) for r in got.collect() if r.doc_id is None or r.doc_id < 100)
    every = sorted((str(i), str(t)[:40]) for i, t in planted)
    if name == "language_id":
        assert mine == sorted((str(i), str(t)[:40]) for i, t in planted if t and any(x.isalpha() for x in t))
    elif name == "simhash_dedup":  # one of the two rows without id; empty and null texts are one group, its smallest id stays
        assert mine.count(("None", a[:40])) + mine.count(("6", a[:40])) <= 2 and [m for m in mine if m[1] in ("", "None")] == [("2", "")]
        assert len([m for m in mine if m[0] == "1"]) == 2
    elif name == "substring_dedup":
        assert len(mine) == len(every) and mine.count(("None", a[:40])) == 2  # rows without id are no one's copy
    else:
        assert mine == every
    assert stage(spark, rows.where("false"), SF).count() == 0


def test_packing_with_odd_rows(spark, prose):
    rows = made(spark, [(None, prose[0]), (1, prose[1]), (1, prose[1]), (2, ""), (3, None)])
    got = corpus_pipeline.packing(spark, rows, SF)
    ends = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert ends[2] == ends[3] == 1 and set(ends) == {None, 1, 2, 3} and ends[1] % 2 == 0
    assert corpus_pipeline.packing(spark, rows.where("false"), SF).count() == 0


def test_packed_ids_read_back(spark, prose):
    """The ids of the last stage, read as a trainer would, are those of the tokenizer; they fill sequences without gaps."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from scorewright.llm.queries import tokenizer_path

    rows = [(10, prose[0]), (11, prose[1] * 5), (12, ""), (13, None), (14, "é漢 <|endoftext|>  x")]
    got = corpus_pipeline.packing(spark, made(spark, rows), SF).collect()
    exact, docs, sequences = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        docs.setdefault(r.doc_id, []).extend(ids.tolist())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert docs == {i: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)]).tolist()
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_only_the_last_result_is_left(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, SF).count() > 0
    (folder,) = os.listdir(tmp_path)
    assert os.listdir(tmp_path / folder) == ["4-packing"]
