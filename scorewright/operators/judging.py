"""Judge runs and fetches with an injected client; the client is the only thing that leaves the process."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.judgejson import scores

#: Token budgets of judge families; others get DEFAULT.
DEFAULT, TRIES = 3072, 3
#: Judges of one run at most.
JUDGES = 1000


def pause(status: int | None, n: int) -> int:
    """Seconds to wait after try n (from 0): 5, 10, .. if the server asks for it (429, 503), 1, 2, 4, .. after its other faults and exceptions (None), else 0."""
    if status in (429, 503):
        return 5 * (n + 1)
    return 2**n if status is None or status >= 500 else 0


def retried(fetch: Callable[[str], tuple[int, str]], url: str, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Body of a page with status 200; every other outcome is tried again after a pause; None in the end."""
    for n in range(tries):
        if n:
            sleep(wait)
        try:
            status, body = fetch(url)
        except Exception:
            status, body = None, None
        if status == 200:
            return body
        wait = pause(status, n)
    return None


def asked(client: Callable[[str, str, int], str], judge: str, prompt: str, budget: int, tries: int = TRIES) -> str | None:
    """Scores of one judgment: the budget doubles after each reply without valid scores; None after the last try."""
    for _ in range(tries):
        if (found := scores(client(judge, prompt, budget), "last")) is not None:
            return found
        budget *= 2
    return None


def work_list(answers: DataFrame, judges: DataFrame, done: DataFrame) -> DataFrame:
    """(question_id, answerer, prompt, judge) still to be judged: each answer by each of the few judges, less what is done."""
    names = [r[0] for r in judges.select("judge").distinct().orderBy("judge").limit(JUDGES + 1).collect()]
    if len(names) > JUDGES:
        raise ValueError(f"more than {JUDGES} judges: run them in parts")
    rows = answers.withColumn("judge", F.explode(F.array(*map(F.lit, names)))) if names else answers.where("false").withColumn("judge", F.lit(""))
    return rows.join(done.select("question_id", "answerer", "judge"), ["question_id", "answerer", "judge"], "left_anti")


#: Steps of an evaluation, in order.
PHASES = ("generate", "judge", "report")


def phases(wanted: str) -> tuple[str, ...]:
    """One phase by name, or all of them."""
    if wanted != "all" and wanted not in PHASES:
        raise ValueError(f"phase {wanted!r}: one of all, {', '.join(PHASES)}")
    return PHASES if wanted == "all" else (wanted,)


def evaluation(spark: SparkSession, folder: str, questions: DataFrame, answerers: DataFrame, judges: DataFrame, generate, judge, report: Callable[[DataFrame], DataFrame], phase: str = "all") -> DataFrame | None:
    """Answers, judgments and a report as tables under a folder; each phase reads what the one before has written.

    generate(model, question) and judge(model, prompt, budget) are injected. answers and judgments are appended: what is there is not
    asked again, failures are. Returns the report, None if it was not asked for.
    """
    for step in phases(phase):
        if step == "generate":
            work = questions.select("question_id", "question").crossJoin(answerers.select("answerer").distinct())  # few models
            done = spark.read.schema("question_id long, answerer string, prompt string").json(f"{folder}/answers") if _exists(spark, f"{folder}/answers") else None
            work = work if done is None else work.join(done, ["question_id", "answerer"], "left_anti")
            _mapped(work, lambda q, a: generate(a, q), "question", "answerer", "prompt").select("question_id", "answerer", "prompt").where("prompt is not null").write.mode("append").json(f"{folder}/answers")
        elif step == "judge":
            answers = spark.read.schema("question_id long, answerer string, prompt string").json(f"{folder}/answers")
            schema = "question_id long, answerer string, judge string, scores string"
            done = spark.read.schema(schema).json(f"{folder}/judgments") if _exists(spark, f"{folder}/judgments") else spark.createDataFrame([], schema)
            judge_run(work_list(answers, judges, done.where("scores is not null")), judge).where("scores is not null").write.mode("append").json(f"{folder}/judgments")
        else:
            return report(spark.read.schema("question_id long, answerer string, judge string, scores string").json(f"{folder}/judgments"))
    return None


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _mapped(rows: DataFrame, f: Callable[[str, str], str], a: str, b: str, out: str) -> DataFrame:
    """rows with f(a, b) as out; null where it raises."""

    def one(x, y):
        try:
            return f(x, y)
        except Exception:  # a failed answer is asked for again by the next run
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            yield d.assign(**{out: pd.Series([one(x, y) for x, y in zip(d[a], d[b], strict=True)], index=d.index, dtype=object)})

    return rows.mapInPandas(run, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema) + f", {out} string")


def judge_run(work: DataFrame, client: Callable[[str, str, int], str], budgets: dict[str, int] | None = None) -> DataFrame:
    """work with `scores`, JSON text; a judge that fails keeps its row with null. Concurrency is the number of partitions."""
    budgets = budgets or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for judge, prompt in zip(f["judge"], f["prompt"], strict=True):
                try:
                    found.append(asked(client, judge, prompt, budgets.get(judge, DEFAULT)))
                except Exception:  # a failed judgment is data: it stays as a null row and is judged again by the next run
                    found.append(None)
            yield f[["question_id", "answerer", "judge"]].assign(scores=pd.Series(found, index=f.index, dtype=object))

    types = {c.name: c.dataType.simpleString() for c in work.schema}
    return work.select("question_id", "answerer", "judge", "prompt").mapInPandas(run, f"question_id {types['question_id']}, answerer string, judge string, scores string")
