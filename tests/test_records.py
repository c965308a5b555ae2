"""Record filters, bootstrap draws, reply objects, report files and injected readers."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright import schemas
from scorewright.functions import citations as C
from scorewright.functions import judgejson as J
from scorewright.functions import text as T
from scorewright.operators import agreement as A
from scorewright.operators import preferences as P
from scorewright.operators import records as R
from scorewright.operators import reports
from scorewright.operators import sampling as S
from scorewright.sources import files, folders


def test_objects_are_the_outermost_balanced_stretches():
    assert J.objects('a {"x": {"y": 1}} } {2} {3') == ['{"x": {"y": 1}}', "{2}"] and J.objects("") == J.objects("}{") == []
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("{}ab") for _ in range(rng.randrange(14)))
        found, place = J.objects(t), 0
        for x in found:  # each is balanced, none holds another, and they follow one another
            assert x.count("{") == x.count("}") and all(x[:k].count("{") > x[:k].count("}") for k in range(1, len(x)))
            place = t.index(x, place) + len(x)
        depth = ends = 0
        for c in t:
            step = {"{": 1, "}": -1}.get(c, 0)
            ends += depth == 1 and step == -1
            depth = max(0, depth + step)
        assert len(found) == ends


def test_numbers_of_acts():
    assert C.NUMBERS["575/2013"] == "CRR" and C.NUMBERS["2013/36/EU"] == "CRD" and C.NUMBERS["2014/65/EU"] == "MIFID" and C.NUMBERS["2023/1114"] == "MICAR"


def test_many_citations_in_a_long_text(spark):
    parts = ["Article 5(1) of EMIR", "CRD IV", "Regulation (EU) No 575/2013", "no act", "Art. 7a", "MiFID II"]
    rng = random.Random(4)
    text = "; ".join(rng.choice(parts) for _ in range(3000))
    r = C.with_spans(spark.createDataFrame([(text,)], "t string"), "t", "s").first()
    assert all(text[s["start"] : s["end"]] == s["text"] for s in r.s) and len(r.s) > 2500


def test_citations_planted_in_documents(spark):
    """Spans in whole documents of four languages, long ones too, are those of Python's matcher."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    plant = ["see Article 5(1)(b) of Regulation (EU) No 575/2013", "CRD IV", "EBA/GL/2017/12", "art. 7a MiFID II", "UCITS V and Directive 2009/65/EC"]
    texts = {}
    for r in rows:
        words = (r.text or "").split(" ")
        for k in range(0, len(words), 60):
            words[k] += f" {plant[(r.doc_id + k) % 5]},"
        texts[r.doc_id] = " ".join(words)
    got = C.with_spans(spark.createDataFrame(list(texts.items()), "id long, t string"), "t", "s").select("id", "s").collect()
    for r in got:
        want = sorted((m.start(), k, m.end(), kind, m[0]) for k, (kind, p) in enumerate(C.PATTERNS) for m in re.finditer(p, texts[r.id], re.IGNORECASE))
        assert [tuple(s)[:5] for s in r.s] == want
    assert sum(len(r.s) for r in got) > 1000


def test_citations_as_rows_are_those_of_arrays(spark):
    """Texts with many citations, none, nulls: rows agree with the arrays; 20,000 citations in a text are all found, in place."""
    plant = ["see Article 5(1)(b) of Regulation (EU) No 575/2013", "CRD IV", "EBA/GL/2017/12", "art. 7a MiFID II", "Mar\u00eda, Mar", "é UCITS V and Directive 2009/65/EC", "nothing"]
    texts = [" ; ".join(plant[(i + k * k) % 7] + f" Art. {k % 9}" for k in range(3 * i)) for i in range(30)] + ["", "no citation", None, "\x01CRR\x02\x01 Art. 5\x02(1)"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    arrays = C.with_citations(C.with_spans(df, "t", "s"), "t", "c").select("id", "s", "c").collect()
    got = {tuple(r) for r in C.span_rows(df, "id", "t").collect()}
    assert got == {(r.id, s.start, s.end, s.rank, s.kind, s.text, s.g1, s.g2, s.g3) for r in arrays for s in r.s}
    rows = C.citation_rows(df, "id", "t").collect()
    assert {(r.id, r.citation) for r in rows} == {(r.id, c.key) for r in arrays for c in r.c}
    assert sum(r.mentions for r in rows) == len(got)
    long = "CRR " + "".join(f"Article {k}, " for k in range(20_000))
    rows = C.citation_rows(spark.createDataFrame([(1, long)], "id long, t string"), "id", "t").collect()
    assert len(rows) == 20_001 and {(r.citation, r.first_at) for r in rows if r.citation in ("CRR", "CRR:art0", "CRR:art19999")} == {("CRR", 0), ("CRR:art0", 4), ("CRR:art19999", long.index("Article 19999"))}
    assert C.citation_rows(df.limit(0), "id", "t").count() == 0


def test_bootstrap_draws_like_resampling(spark):
    """Means spread by sd / sqrt(n), two thirds of the rows are in a resample, rows are drawn independently."""
    rng = np.random.default_rng(1)
    data = [("g", i, float(v)) for i, v in enumerate(rng.normal(0.1, 1, 400))] + [("h", i, 0.0) for i in range(5)] + [(None, 1, 1.0), ("g", None, 1.0), ("g", 9999, None)]
    rows = spark.createDataFrame(data, "g string, k long, d double").repartition(3)
    got = {r.g: r for r in reports.bootstrap(rows, "g", "k", "d").collect()}
    d = np.array([x[2] for x in data[:400]])
    width = 2 * 1.96 * d.std() / 20
    assert set(got) == {"g", "h"} and got["g"].n == 400 and abs((got["g"].hi - got["g"].lo) / width - 1) < 0.05
    assert (got["h"].lo, got["h"].hi, got["h"].p, got["h"].significant) == (0, 0, 0, False)
    w = np.searchsorted(np.array(reports.POISSON, np.uint64), reports.mixed(reports.mixed(np.arange(400))[:, None] ^ reports.mixed(np.arange(1, 4001))), "right")
    assert abs((w > 0).mean() - (1 - np.exp(-1))) < 0.002 and abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    c = np.corrcoef(w[:60])
    assert np.abs(c - np.eye(60)).max() < 0.08 and np.abs(np.corrcoef(w.T[:60]) - np.eye(60)).max() < 0.25
    one, many = (sorted(map(tuple, reports.bootstrap(rows.repartition(n), "g", "k", "d", 200).collect())) for n in (1, 5))
    assert one == many


def test_rater_pairs(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (1, "c", None), (2, "a", 1), (3, "c", 5), (3, "b", 4), (3, "a", 4)], "k int, r string, s int")
    got = sorted(tuple(x) for x in A.rater_pairs(rows, ["k"], "r", "s").collect())
    assert got == [(1, "a", "b", 3, 2), (3, "a", "b", 4, 4), (3, "a", "c", 4, 5), (3, "b", "c", 4, 5)]


def test_filters(spark):
    rows = spark.createDataFrame([("ESMA_ESMA_QA_1580", " \nThis question was deleted on 1.1.", "click"), ("x", "It says: This question was deleted", None), (None, None, "view")], "id string, t string, v string")
    got = rows.select(R.blacklisted(F.col("id")), R.stub(F.col("t")), R.one_of(F.col("v"), ["original", "click"], "original"), R.one_of(F.col("v"), None, "original")).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (False, False, True, True), (False, False, False, True)]
    texts = ["7", " 7.5 ", "1e3", "-.5", "5d", "5f", "0x1", "", None, "n/a", "1,5"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.number(F.col("t"))).collect()]
    assert got == [7.0, 7.5, 1000.0, -0.5, None, None, None, None, None, None, None]


def test_article_titles_and_limits(spark):
    body = "words of a body " * 10
    text = "x\n" + "".join(f"Article {n}\n{t}\n{body}\n" for n, t in ((1, "Scope"), (2, "Definitions"), (3, "Duties"), (4, "Addressees"), (5, "Exercise of the delegation"), (6, "Committee procedure"), (60, "Late duties")))
    df = spark.createDataFrame([("DORA", text), ("other", text)], "r string, t string")
    got = lambda **k: sorted((r.r, r.article_number) for r in T.articles(df, "r", "t", **k).collect())
    assert got() == [("DORA", "3"), ("DORA", "60"), ("other", "3"), ("other", "60")]
    assert got(keep=("Definitions", "Scope"))[:4] == [("DORA", "1"), ("DORA", "2"), ("DORA", "3"), ("DORA", "60")]
    limits = df.select("r", T.highest(F.col("r")).alias("n")).collect()
    assert {r.r: r.n for r in limits} == {"DORA": 56, "other": 999}
    cut = df.select(T.without_preamble(F.col("t")).alias("t")).first().t
    assert cut == text[2:] and spark.createDataFrame([("No such line",)], "t string").select(T.without_preamble(F.col("t"))).first()[0] == "No such line"


def test_joins(spark):
    full = spark.createDataFrame([(1, "a"), (2, "b")], "pair_id int, text string")
    entries = spark.createDataFrame([(1, 5, "PASS"), (3, 4, "PASS"), (2, 1, "FAIL")], "pair_id int, score int, final_status string")
    assert sorted(map(tuple, R.merged(entries, full, "pair_id").collect())) == [(1, 5, "a"), (3, 4, None)]
    assert [tuple(r) for r in R.reindexed(spark.createDataFrame([("b", 1), ("z", 9)], "k string, v int"), "k", ["c", "b"]).select("ord", "k", "v").collect()] == [(0, "c", None), (1, "b", 1)]
    lp = spark.createDataFrame([([-1.0, -2.0, -3.0], 1), ([-1.0], 4), ([], 0)], "l array<double>, p int")
    assert [r[0] for r in lp.select(R.completion_logprob(F.col("l"), F.col("p"))).collect()] == [-5.0, 0.0, 0.0]
    score = R.mean_bert_score(spark.createDataFrame([("s", "ab", "ab"), ("s", "a", "b")], "side string, candidate string, reference string"), ["side"], lambda c, r: (c == r).cast("double")).first()
    assert score.bert_score == 0.5


def test_weights_over_epochs(spark):
    w = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "g string, w double")
    margins = lambda e: spark.createDataFrame([("a", 1.0), ("b", -1.0)], "g string, margin double")
    got = {(r.epoch, r.g): r.w for r in S.weights_over_epochs(w, margins, 2, 0.5, 0.05).collect()}
    assert len(got) == 6 and got[1, "b"] == pytest.approx(np.exp(0.5) / (np.exp(0.5) + np.exp(-0.5))) and got[2, "b"] == pytest.approx(np.exp(1) / (np.exp(1) + np.exp(-1)))


def test_report_and_array_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i == 3 else f"é{i}") for i in range(10)], "id int, t string").repartition(4)
    files.write_json_array(rows, str(tmp_path / "a"))
    (part,) = (tmp_path / "a").glob("part-*")
    assert sorted(json.loads(part.read_text(encoding="utf-8")), key=lambda r: r["id"])[2:4] == [{"id": 2, "t": "é2"}, {"id": 3, "t": None}]
    files.write_json_array(rows.where("id > 99"), str(tmp_path / "none"))
    (part,) = (tmp_path / "none").glob("part-*")
    assert json.loads(part.read_text()) == []
    files.write_report(rows.agg(F.count("*").alias("n")), rows.where("id < 2"), str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*")
    document = json.loads(part.read_text(encoding="utf-8"))
    assert document["summary"] == {"n": 10} and len(document["results"]) == 2
    files.write_jsonl(rows.where("id < 5"), str(tmp_path / "l"), append=True)
    files.write_jsonl(rows.where("id >= 5"), str(tmp_path / "l"), append=True)
    assert files.read_jsonl(spark, [str(tmp_path / "l"), str(tmp_path / "l")], "id int, t string").count() == 20


def test_page_texts_and_folder_of_articles(spark, tmp_path):
    for name, text in (("a.pdf", b"one\x0ctwo"), ("b.pdf", b" ")):
        (tmp_path / name).write_bytes(text)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_page_texts(spark, str(tmp_path / "*.pdf"), lambda raw: raw.decode().replace("\x0c", "\n--- PAGE 2 ---\n")).collect()}
    assert got == {"a.pdf": "one\n--- PAGE 2 ---\ntwo", "b.pdf": " "}
    for reg in ("GDPR", "DORA"):
        (tmp_path / f"{reg}_articles.json").write_text(json.dumps({"regulation": reg, "articles": [{"regulation": reg, "title": "t"}]}))
    read = lambda *a: sorted(r.regulation for r in files.read_articles(spark, str(tmp_path), "regulation string, articles array<struct<regulation:string,title:string>>", *a).collect())
    assert read() == ["DORA", "GDPR"] and read(["GDPR"]) == ["GDPR"]


def test_records_of_every_schema(spark, tmp_path):
    """Record files are read with their schemas; model names with slashes and dots stay keys, odd reasoning stays text."""
    scores = {"accuracy": 4, "completeness": 3, "topic_coherence": 5, "citation_quality": None, "reasoning": "ok"}
    record = {"question_id": "q1", "regulator": "EBA", "answers": {"org/model.1": {"text": "a", "judge_scores": {"j/1.5": scores, "k": scores | {"accuracy": 1}}}}, "meta": {"judge_models": ["j/1.5", "k"]}}
    path = tmp_path / "judged.jsonl"
    path.write_text(json.dumps(record) + "\n\n" + json.dumps({"question_id": "q2", "answers": {}}) + "\n")
    rows = P.flatten(files.read_jsonl(spark, str(path), schemas.JUDGE_RECORD)).collect()
    assert sorted((r.question_id, r.answerer, r.judge, r.accuracy, r.citation_quality) for r in rows) == [("q1", "org/model.1", "j/1.5", 4.0, None), ("q1", "org/model.1", "k", 1.0, None)]
    for schema in (schemas.QUESTION, schemas.OLD_JUDGE_RECORD, schemas.PREFERENCE_PAIR, schemas.EVAL_SCORES, schemas.EVAL_ANSWER, schemas.ARTICLES):
        assert len(files.read_jsonl(spark, str(path), schema).columns) >= 3 and files.read_jsonl(spark, str(path), schema).count() == 2


def test_split_hash_streams_the_sorted_ids(spark):
    import hashlib

    ids = [str(i) for i in range(500)]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id string").repartition(5)
    assert files.joined_hash(df).first()[0] == hashlib.sha256("|".join(sorted(ids)).encode()).hexdigest()
    assert files.joined_hash(df.where("false")).first()[0] == hashlib.sha256(b"").hexdigest()


def test_work_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = folders.work_folder(spark, "x"), folders.work_folder(spark, "x")
    assert a != b and a.startswith(base)


def test_array_parts_are_one_document(spark, tmp_path):
    """Part files, one after another, are the JSON document; several tasks write and read them."""
    import glob
    import json

    from scorewright.sources import files

    rows = [(k, None if k % 7 == 0 else f"é {k} [ ] \n, {{", "]") for k in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, value string").repartition(6)
    for name, part in (("all", df), ("none", df.limit(0)), ("one", df.where("id = 3"))):
        path = str(tmp_path / name)
        files.write_array_parts(part, path)
        names = sorted(glob.glob(f"{path}/part-*"))
        assert len(names) > 3 or name != "all"
        got = json.loads("".join(open(f, encoding="utf-8").read() for f in names))
        want = sorted(tuple(r) for r in part.collect())
        assert sorted((r["id"], r["text"], r["value"]) for r in got) == want
        assert sorted(tuple(r) for r in files.read_array_parts(spark, path, "id long, text string, value string").collect()) == want
    path = str(tmp_path / "report")
    files.write_report_parts(spark.createDataFrame([(100, "a: [")], "n long, s string"), df, path)
    whole = json.loads("".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*"))))
    assert whole["summary"] == {"n": 100, "s": "a: ["} and len(whole["results"]) == 100
    assert tuple(files.read_report_summary(spark, path, "n long, s string").first()) == (100, "a: [") and files.read_array_parts(spark, path, "id long").count() == 100


def test_tree_hash_of_sets(spark):
    import hashlib

    from scorewright.sources import files

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [f"id{k}" for k in range(500)] + ["", "é"]
    parts = {}
    for i in ids:
        parts.setdefault(sha(i)[:2], []).append(i)
    want = sha("|".join(sha("|".join(sorted(parts[p]))) for p in sorted(parts)))
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id string")
    assert {files.tree_hash(df.repartition(n), 2).first()[0] for n in (1, 5)} == {want}
    assert files.tree_hash(df.limit(0)).first()[0] == sha("")
