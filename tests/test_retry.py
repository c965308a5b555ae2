"""Retries in state: budgets double over batches and restarts; finished keys are not asked again."""

import json
import os
import time

import pytest

from scorewright.streaming.retry import retried_judgments

GOOD = json.dumps({"accuracy": 4, "completeness": 3, "topic_coherence": 5, "citation_quality": 2})


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def client(log):
    """easy is answered at once, hard from a budget of 400 on, never not at all."""

    def ask(judge, prompt, budget):
        with open(log, "a") as f:
            f.write(f"{prompt} {budget}\n")
        if prompt == "raises" and budget < 200:
            raise OSError("no connection")
        return GOOD if prompt in ("easy", "raises") or prompt == "hard" and budget >= 400 else "no scores"

    return ask


def start(spark, folder, out, checkpoint, log, wait):
    rows = spark.readStream.schema("id long, judge string, prompt string").json(folder)
    found = retried_judgments(rows, "id", client(log), budget=100, tries=4, wait=lambda n: wait)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()


def wait_for(check, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(0.5)
    return False


def lines(log):
    return open(log).read().split("\n")[:-1] if os.path.exists(log) else []


def test_a_retry_goes_on_after_a_restart(store, tmp_path):
    folder, out, checkpoint, log = (str(tmp_path / n) for n in ("in", "out", "checkpoint", "log"))
    os.makedirs(folder)
    rows = [{"id": 1, "judge": "j", "prompt": "easy"}, {"id": 2, "judge": "j", "prompt": "hard"}, {"id": 3, "judge": "j", "prompt": "never"}, {"id": 4, "judge": "j", "prompt": "raises"}, {"id": 1, "judge": "j", "prompt": "easy"}]
    with open(f"{folder}/a.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    q = start(store, folder, out, checkpoint, log, wait=20_000)
    assert wait_for(lambda: len(lines(log)) >= 4 and q.recentProgress and q.recentProgress[-1]["batchId"] >= 1)
    q.stop()
    assert sorted(lines(log)) == ["easy 100", "hard 100", "never 100", "raises 100"]  # their next tries are still to come
    with open(f"{folder}/b.json", "w") as f:
        f.write(json.dumps(rows[0]) + "\n")  # a finished key comes again
    q = start(store, folder, out, checkpoint, log, wait=100)
    assert wait_for(lambda: len([x for x in lines(log) if x.startswith("never")]) >= 4 and any(r.id == 3 for r in read(store, out)))
    q.stop()
    got = {r.id: (r.scores is not None, r.tries, r.budget) for r in read(store, out)}
    assert got == {1: (True, 1, 100), 2: (True, 3, 400), 3: (False, 4, 800), 4: (True, 2, 200)}
    assert sorted(lines(log)) == sorted(["easy 100", "hard 100", "hard 200", "hard 400", "never 100", "never 200", "never 400", "never 800", "raises 100", "raises 200"])


def read(spark, out):
    try:
        return spark.read.parquet(out).collect()
    except Exception:  # nothing written yet
        return []
