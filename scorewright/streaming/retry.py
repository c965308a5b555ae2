"""Judging as a stream with retries in state: each key's try and token budget outlive the process.

A reply without valid scores doubles the key's budget and sets a timer; the next try comes when the timer expires, in a later batch, so a
waiting key holds no task up. A restart in the middle goes on with the doubled budget. Finished keys are remembered for a
while, so that a record that comes again is not judged again, and then expire.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.judgejson import scores
from ..operators.judging import DEFAULT, TRIES

OUT = "judge string, scores string, tries int, budget int"


class Retries(StatefulProcessor):
    """client(judge, prompt, budget) gives a reply; wait(n) the milliseconds before try n + 1, after n tries."""

    def __init__(self, client: Callable[[str, str, int], str], key: str, kind: str, budget: int, tries: int, wait: Callable[[int], int], remember: int):
        self.client, self.key, self.kind, self.budget, self.tries, self.wait, self.remember = client, key, kind, budget, tries, wait, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "judge string, prompt string, budget int, tries int")
        self.finished = handle.getValueState("finished", "tries int", self.remember)

    def ask(self, key, judge: str, prompt: str, budget: int, tries: int, now: int) -> Iterator[pd.DataFrame]:
        try:
            found = scores(self.client(judge, prompt, budget), "last")
        except Exception:  # no reply is a reply without scores
            found = None
        if found is None and tries + 1 < self.tries:
            self.open.update((judge, prompt, 2 * budget, tries + 1))
            self.handle.registerTimer(now + self.wait(tries + 1))
            return
        self.open.clear()
        self.finished.update((tries + 1,))
        yield pd.DataFrame({self.key: [key], "judge": [judge], "scores": pd.Series([found], dtype=object), "tries": [tries + 1], "budget": [budget]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.finished.exists() or self.open.exists():
            return
        first = next((f for f in rows if len(f)), None)
        if first is not None:
            yield from self.ask(key[0], first["judge"].iloc[0], first["prompt"].iloc[0], self.budget, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield from self.ask(key[0], *self.open.get(), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def retried_judgments(records: DataFrame, key: str, client: Callable[[str, str, int], str], budget: int = DEFAULT, tries: int = TRIES, wait: Callable[[int], int] = lambda n: 1000 * 2**n, remember: int = 7 * 86_400_000) -> DataFrame:
    """key, judge, scores (null after the last try), tries, budget of the last try: one row for each key of a stream of (key, judge, prompt).

    The budget doubles after each reply without valid scores. remember: milliseconds for which a finished key's records are not
    judged again; its state expires then. Null judges and prompts are handed to the client as they are. The session needs the
    RocksDB state store; rows go out in append mode.
    """
    kind = records.schema[key].dataType.simpleString()
    work = Retries(client, key, kind, budget, tries, wait, remember)
    return records.select(key, "judge", "prompt").groupBy(key).transformWithStateInPandas(statefulProcessor=work, outputStructType=f"`{key}` {kind}, {OUT}", outputMode="append", timeMode="processingTime")
