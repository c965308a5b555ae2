"""Samples and splits by cut points: those of a sort, without moving rows."""

import pytest
from pyspark.sql import functions as F

from scorewright.operators import sampling as S

KEYS = [*range(0, 900, 3), *(k * S.RANGE + k % 7 for k in range(1, 400)), *(10**15 + k for k in range(50)), -5, -1_000_008]


def drawn(k, seed=42):
    """draw() in plain Python; the remainder of a negative key has its sign, as in Java."""
    rest = abs(k) % S.RANGE * (1 if k >= 0 else -1)
    return (rest * 48271 + seed * 7919) % S.RANGE


def stratum(k):
    return None if k % 11 == 0 else "big" if k % 11 < 9 else "small"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, stratum(k), "x") for k in KEYS] + [(None, "big", "no key")], "k long, s string, text string").repartition(5)


def sorted_groups():
    groups = {}
    for k in KEYS:
        groups.setdefault(stratum(k), []).append(k)
    return {g: sorted(ks, key=lambda k: (drawn(k), k)) for g, ks in groups.items()}


def test_split_is_that_of_a_sort(table):
    want = {}
    for ks in sorted_groups().values():
        a, b = int(len(ks) * 0.7), int(len(ks) * (0.7 + 0.15))
        want |= {k: "train" if i < a else "val" if i < b else "test" for i, k in enumerate(ks)}
    got = S.stratified_split(table, "k", "s")
    assert {r.k: r.split for r in got.collect()} == want and got.count() == len(KEYS)


def test_many_groups_are_joined_by_an_exchange(table, monkeypatch):
    want = {tuple(r) for r in S.stratified_split(table, "k", "s").collect()}
    monkeypatch.setattr(S, "CARRIED", 1)
    assert {tuple(r) for r in S.stratified_split(table, "k", "s").collect()} == want


def test_rows_stay_where_they_are(table):
    """The result's plan reads the table and carries the cut points to it; no exchange but theirs."""
    for df in (S.stratified_split(table, "k", "s"), S.held_out(table, "k", 0.05)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("Broadcast") >= 1


@pytest.mark.parametrize("share", [0.0, 0.05, 1.0])
def test_held_out_of_all_rows(table, share):
    ks = sorted(KEYS, key=lambda k: (drawn(k), k))
    n = -(-len(ks) * int(share * 100) // 100)
    got = {r.k: r.split for r in S.held_out(table, "k", share).collect()}
    assert {k for k, v in got.items() if v == "eval"} == set(ks[:n]) and len(got) == len(ks)


def test_weighted_sample_with_and_without_enough_rows(spark, table):
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("absent", 5.0)], "s string, w double")
    target = 600
    want = {}
    for g, ks in sorted_groups().items():
        if g:
            n = target // 2
            want |= {k: n // len(ks) + (i < n % len(ks)) if n > len(ks) else int(i < n) for i, k in enumerate(ks)}
    got = {r.k: r.n for r in S.weighted_sample(table, "k", "s", weights, target).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_empty_and_one_row(spark):
    one = spark.createDataFrame([(7, "a")], "k long, s string")
    assert [r.split for r in S.held_out(one, "k", 0.05).collect()] == ["eval"] and [r.split for r in S.stratified_split(one, "k", "s").collect()] == ["test"]
    assert S.stratified_split(one.limit(0), "k", "s").count() == 0 and S.held_out(one.limit(0), "k", 0.5).count() == 0
