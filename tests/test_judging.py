"""Retries, growing budgets and failure rows with a deterministic client."""

import json

import pytest

from scorewright.operators import judging


def test_retried():
    slept, replies = [], iter([(503, ""), (200, "page")])
    assert judging.retried(lambda u: next(replies), "u", sleep=slept.append) == "page" and slept == [5]
    slept.clear()

    def broken(u):
        raise OSError

    assert judging.retried(broken, "u", sleep=slept.append) is None and slept == [1, 2]
    slept.clear()
    replies = iter([(500, ""), (404, ""), (200, "late")])
    assert judging.retried(lambda u: next(replies), "u", sleep=slept.append) == "late" and slept == [1, 0]
    slept.clear()
    asked = []
    assert judging.retried(lambda u: (asked.append(u), (429, ""))[1], "u", sleep=slept.append) is None and slept == [5, 10] and len(asked) == 3


def test_run_keeps_failures_and_resumes(spark):
    def client(judge, prompt, budget):
        if judge == "down":
            raise OSError("down")
        return json.dumps({"accuracy": 3, "completeness": 3, "topic_coherence": 3, "citation_quality": 2}) if budget >= 6144 else ""

    answers = spark.createDataFrame([(1, "m", "p1"), (2, "m", "p2")], "question_id long, answerer string, prompt string")
    judges = spark.createDataFrame([("a",), ("down",)], "judge string")
    done = spark.createDataFrame([(1, "m", "a")], "question_id long, answerer string, judge string")
    got = {(r.question_id, r.judge): r.scores for r in judging.judge_run(judging.work_list(answers, judges, done), client).collect()}
    assert set(got) == {(2, "a"), (1, "down"), (2, "down")}
    assert json.loads(got[2, "a"])["citation_quality"] == 2 and got[1, "down"] is None


def test_phases(spark, tmp_path):
    """Each phase goes on from the tables of the one before; failures are asked again, what is done is not."""
    questions = spark.createDataFrame([(i, f"q{i}") for i in range(4)], "question_id long, question string")
    answerers, judges = (spark.createDataFrame([(m,) for m in names], f"{c} string") for c, names in (("answerer", "xy"), ("judge", "ab")))
    reply = json.dumps({"accuracy": 3, "completeness": 3, "topic_coherence": 3, "citation_quality": 2})

    def generate(broken):
        def run(model, question):
            if broken and question == "q3":
                raise OSError
            return f"{model} on {question}"

        return run

    report = lambda rows: rows.groupBy("judge").count()
    args = (spark, str(tmp_path), questions, answerers, judges)
    assert judging.evaluation(*args, generate(True), lambda j, p, b: reply, report, "generate") is None
    assert spark.read.json(f"{tmp_path}/answers").count() == 6
    got = judging.evaluation(*args, generate(False), lambda j, p, b: "" if j == "b" else reply, report)
    assert {r["judge"]: r["count"] for r in got.collect()} == {"a": 8}
    got = judging.evaluation(*args, generate(False), lambda j, p, b: reply if j == "b" else "", report)
    assert {r["judge"]: r["count"] for r in got.collect()} == {"a": 8, "b": 8} and spark.read.json(f"{tmp_path}/answers").count() == 8
    with pytest.raises(ValueError, match="phase"):
        judging.phases("later")
