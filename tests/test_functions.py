"""Edge rules of citations, corruptions, replies, statistics and files."""

import json
import re

import pytest
from pyspark.sql import functions as F

from scorewright.functions import citations as C
from scorewright.functions import corruptions as X
from scorewright.functions import judgejson as J
from scorewright.functions import stats
from scorewright.operators import agreement as A
from scorewright.operators import preferences as P
from scorewright.operators import sampling as S
from scorewright.sources import files

TEXTS = [
    "Regulation (EU) No 575/2013 (CRR), Article 425(2)(c).", "Article 425 (CRR) applies", "part 3 in Mar", "CRD IV and Directive 2013/36/eu", "Directive 2013/36/EU", "(EU) 2019/876 Regulation (EU) 2019/876",
    "Article 7. EMIR Art. 7", "", None, "EBA/GL/2017/12 article 9 article 9", "MiFID  II, UCITS V; Art 39a (2) (b)",
]


def spans(text):
    out = []
    for rank, (kind, p) in enumerate(C.PATTERNS):
        out += [(m.start(), rank, m.end(), kind, m.group(0)) for m in re.finditer(p, text or "", re.IGNORECASE)]
    return sorted(out)


def test_spans_have_the_places_of_finditer(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    for r in C.with_spans(df, "t", "s").collect():
        assert [tuple(s)[:5] for s in r.s] == spans(TEXTS[r.id])


def test_keys(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    got = {r.id: [c["key"] for c in r.c] for r in C.with_citations(df, "t", "c").collect()}
    assert got[0] == ["CRR", "CRR:art425:(2):(c)"]
    assert got[1] == [":art425:(crr)", "CRR"]  # the act to the right does not bind
    assert got[2] == [":art3", "MAR"]
    assert got[3] == ["CRDIV", "2013/36/EU"]  # small letters miss the number table
    assert got[4] == ["CRD"]
    assert got[5] == []  # the pattern wants four digits after the stroke
    assert got[6] == [":art7", "EMIR", "EMIR:art7"]
    assert got[7] == got[8] == []
    assert got[9] == ["EBA/GL/2017/12", "EBA/GL/2017/12:art9"]
    assert got[10] == ["MIFIDII", "UCITSV", "UCITSV:art39a:(2):(b)"]


def test_explode_does_not_repeat_the_steps_in_a_filter(spark):
    df = spark.range(3).select("id", F.concat(F.lit("CRR, Article "), "id").alias("t"))
    for made in (C.with_spans(df, "t", "s").select(F.explode("s")), C.with_citations(df, "t", "c").select(F.explode("c"))):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == len(C.PATTERNS)
        assert made.count() == 6


def test_matches_are_dealt_to_tasks_that_grow_with_the_input(spark):
    from scorewright.plans.citations import document_citations

    plan = document_citations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [key#" in plan and f", {8 * spark.sparkContext.defaultParallelism}" in plan.split("RepartitionByExpression [key#")[1].split("\n")[0]


@pytest.mark.parametrize("truth, found, want", [([], [], (1, 1, 1)), (["a"], [], (0, 0, 0)), ([], ["a"], (0, 0, 0)), (["a", "b"], ["a"], (1, 0.5, 2 / 3))])
def test_set_scores(spark, truth, found, want):
    df = spark.createDataFrame([(truth, found)], "t array<string>, f array<string>")
    r = df.select(C.set_scores(F.col("t"), F.col("f")).alias("s")).first().s
    assert (r.precision, r.recall, r.f1) == pytest.approx(want)


def test_corruptions(spark):
    df = spark.createDataFrame([(1, "CRR and Regulation (EU) No 575/2013, then EMIR."), (2, "No law."), (3, "Article 3 and Article 4(1), Article 3.")], "id long, t string")
    laws = {r.id: r.x for r in X.law_swap(df, "t", "id", "x").collect()}
    assert laws[2] is None and laws[3] is None and "CRR" not in re.findall(r"\bCRR\b", laws[1]) and "575/2013" not in laws[1] and laws[1].endswith("then EMIR.")
    arts = {r.id: r.x for r in X.article_swap(df, "t", "id", "x").collect()}
    assert arts[3] == "Article 4 and Article 3(1), Article 4." and arts[1] is None
    done = {r.id: list(r.a) for r in X.combined(df, "t", "id", "x", "a").collect()}
    assert done[2] == ["hallucinate_citation", "hallucinate_text"] and done[1][0] == "law_swap"


def test_replies():
    good = '{"accuracy": 1, "completeness": 2, "topic_coherence": 3, "citation_quality": %s, "reasoning": {"a": "x"}}'
    text = "```json\n" + good % 4 + "```{} and " + good % '"n/a"'
    assert json.loads(J.scores(text, "last"))["citation_quality"] == 4
    assert json.loads(J.scores(text, "first"))["citation_quality"] == 4
    assert json.loads(J.scores(good % '"n/a"', "first"))["citation_quality"] == "n/a" and J.scores(good % '"n/a"', "last") is None
    assert json.loads(J.scores(good % "true", "last"))["citation_quality"] is True
    assert J.scores(None, "last") is None
    assert J.repaired("x {'a': 1,} y") == '{"a": 1}' and J.repaired("[1, 2,]") == "[1, 2]" and J.repaired("{") is None


def test_votes(spark):
    rows = [(1, "EBA", j, p, s, 2.0) for j, p, s in (("A", "F", "strong"), ("N", "O", "weak"), ("R", "tie", "tie"))] + [(2, "EBA", j, "F", "strong", 1.0) for j in "AN"]
    df = spark.createDataFrame(rows, "question_id long, regulator string, judge string, preferred string, strength string, abs_diff double")
    got = {r.question_id: r for r in P.consensus(df).collect()}
    assert got[1].majority_preferred == "F" and got[1].majority_count == 1 and not got[1].unanimous
    assert got[2].unanimous and got[2].unanimous_strong and got[2].n_judges == 2


def test_agreement(spark):
    same = spark.createDataFrame([("x", a, a) for a in (1, 2, 3, 5)] + [("c", 3, 3)] * 3, "g string, a int, b int")
    k = {r.g: r.kappa for r in A.kappa(same, ["g"], 2).collect()}
    assert k["x"] == pytest.approx(1) and k["c"] is None
    a = {r.g: r.alpha for r in same.groupBy("g").agg(A.krippendorff(F.col("a"), F.col("b")).alias("alpha")).collect()}
    assert a["x"] == pytest.approx(1) and a["c"] is None
    ties = spark.createDataFrame([("x", 1, 2), ("x", 1, 3), ("x", 2, 1), ("x", 3, 1)], "g string, a int, b int")
    assert A.spearman(ties, ["g"], "a", "b").first().rho == pytest.approx(-0.8888888, abs=1e-6)


def test_p_values():
    assert stats.correlation_p(0.5, 20) == pytest.approx(0.024769, abs=1e-5)
    assert stats.correlation_p(0.0, 10) == pytest.approx(1) and stats.correlation_p(1.0, 5) == 0 and stats.correlation_p(None, 5) is None


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"))
    got = S.stratified_split(df, "k", "s").groupBy("s").pivot("split").count().collect()
    assert all((r.train, r.val) == (n * 7 // 10, int(n * 0.85) - n * 7 // 10) for r in got for n in [334 if r.s == 0 else 333])
    pairs = spark.createDataFrame([(1, "c", "r")], "id int, chosen string, rejected string")
    assert {tuple(r) for r in S.labelled(pairs).collect()} == {(1, "c", True), (1, "r", False)}
    big = spark.createDataFrame([("g", 1e6), ("g", 1e6 + 1)], "g string, x double")
    assert S.dr_loss(big, ["g"], "x", 0.5).first().loss == pytest.approx(1e6 + 0.2832, abs=1e-3)


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "a/b.c", "v": 1}\n\n{"id": "x", "v": 2}\n{"id": "x", "v": 3}\n')
    assert files.read_jsonl(spark, str(p), "id string, v int").count() == 3
    assert {tuple(r) for r in files.read_keyed_jsonl(spark, str(p), "id string, v int", "id").collect()} == {("a/b.c", 1), ("x", 3)}
    q = tmp_path / "b.json"
    q.write_text('[{"id": "a", "v": 1},\n {"id": "b"}]')
    assert files.sniff(spark, str(q)) and not files.sniff(spark, str(p))
    assert files.read_json(spark, str(q), "id string, v int").count() == 2
    u = files.union_csv([spark.createDataFrame([(1, 2)], "b int, a int"), spark.createDataFrame([(3,)], "c int")])
    assert u.columns == ["a", "b", "c"]
    files.write_csv(u, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "a int, b int, c int").count() == 2


def test_resumed_stream_takes_each_key_once(spark, tmp_path):
    import time

    from scorewright.streaming.resume import Progress, judged_stream

    progress = Progress()
    spark.streams.addListener(progress)
    src = tmp_path / "in"
    src.mkdir()
    for k in range(2):
        (src / f"{k}.json").write_text('{"id": "a"}\n{"id": "b%d"}\n' % k)
        judged_stream(spark, str(src), "id string", "id", lambda d: d.withColumn("s", F.lit(1)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b0", "b1"]
    for _ in range(100):  # events arrive after the stream has ended
        if progress.rows < 4:
            time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert progress.rows == 4 and progress.batches >= 2


def test_names_and_budgets(spark):
    from scorewright.functions import names as N

    df = spark.createDataFrame([("a/b/eval_run1/", "crypto_assets", "x/Qwen-1"), ("eval_eval_z", "", "x/other"), ("", "fund_eval_x", None)], "p string, z string, m string")
    got = df.select(N.folder_name(F.col("p")), N.title_case(F.col("z")), N.request(F.col("m"), F.lit("hi")), N.budget(F.col("m"), {"x/Qwen-1": 9}, 3)).collect()
    assert [tuple(r) for r in got] == [("run1", "Crypto Assets", "hi\n\n/no_think", 9), ("eval_z", "", "hi", 3), ("", "Fund Eval X", "hi", 3)]


def test_held_out_is_exact(spark):
    rows = S.held_out(spark.range(1, 142).withColumnRenamed("id", "k"), "k", 0.05)
    assert {r[0]: r[1] for r in rows.groupBy("split").count().collect()} == {"eval": 8, "train": 133}


def test_topics_go_to_the_nearest_kept_centroid(spark):
    import numpy as np

    from scorewright.operators.topics import clusters

    rng = np.random.default_rng(3)
    data = [(i, [float(v) for v in np.eye(3)[i % 3] + rng.normal(0, 0.05, 3)]) for i in range(60)] + [(60, [-1.0, -1.0, -1.0]), (61, None), (62, [0.0, 0.0, 0.0]), (63, [1.0])]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = {r["id"]: r for r in clusters(df, "v", 4, 5).collect()}
    assert len(got) == 64 and all(got[i]["topic"] == -1 for i in (61, 62, 63))
    assert len({got[i]["topic"] for i in range(60)}) == 3 and all(got[i]["topic"] == got[i % 3]["topic"] for i in range(60))
    assert got[60]["moved"] and got[60]["topic"] >= 0
    assert clusters(df.where("id > 99"), "v", 4, 5).collect() == []
