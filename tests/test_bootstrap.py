"""Resamples of exactly n places against a plain resampler."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import bootstrap as B


def test_places_add_up_and_spread_like_draws_with_replacement():
    n, resamples, depth = 5000, 400, 3
    whole = B.Places("g", n, resamples, 0)
    counts = np.array([whole.of(depth, k) for k in range(1 << depth)])
    assert (counts.sum(axis=0) == n).all() and (counts >= 0).all()
    mean, var = counts.mean(axis=1), counts.var(axis=1)
    assert np.abs(mean - n / 8).max() < 5 and np.abs(var / (n / 8 * 7 / 8) - 1).max() < 0.35
    assert np.corrcoef(counts[0], counts[1])[0, 1] < 0.1  # multinomial: about -1/7
    alone = B.Places("g", n, resamples, 0)
    assert (alone.of(depth, 6) == counts[6]).all()  # a task that goes down to one range only
    ones = sum(B.Places("g", n, resamples, 0).sums(depth, k, np.ones(n // 8)) for k in range(8))
    assert (ones == n).all()
    single = sum(B.Places("g", n, resamples, 0).sums(depth, k, np.eye(1, n // 8, 3)[0] if k == 5 else np.zeros(n // 8)) for k in range(8))
    assert abs(single.mean() - 1) < 0.2 and abs(single.var() - 1) < 0.3  # one row is drawn about once


def test_leaves_cover_the_ranks(spark):
    rows = spark.range(5003).select(F.when(F.col("id") < 5000, "big").otherwise("small").alias("g"), "id", F.col("id").cast("double").alias("d"))
    for r in B.leaves(rows, "g", "id", "d").groupBy("g", "n", "depth", "node").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.count("*").alias("c")).collect():
        assert (r.a, r.b + 1) == B.Places(r.g, r.n, 1, 0).bounds(r.depth, r.node) and r.c == r.b + 1 - r.a <= B.LEAF


@pytest.mark.parametrize("leaf", [1024, 16])
def test_interval_is_that_of_a_plain_resampler(spark, monkeypatch, leaf):
    monkeypatch.setattr(B, "LEAF", leaf)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0.1, 1, 300), "b": rng.normal(1, 2, 40), "c": np.array([0.5]), "d": np.repeat(0.25, 20)}
    rows = [(g, k, float(v), 1) for g, x in groups.items() for k, v in enumerate(x)] + [(None, 1, 1.0, 1), ("a", None, 1.0, 1), ("a", 5, None, 1)]
    df = spark.createDataFrame(rows, "name string, k long, d double, node int").repartition(5)
    got = {r.name: r for r in B.exact_bootstrap(df, "name", "k", "d").collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        means = x[rng.integers(0, len(x), (10_000, len(x)))].mean(axis=1)
        lo, hi = np.percentile(means, [2.5, 97.5])
        error = 4 * x.std() / np.sqrt(len(x)) / 25  # of a quantile of 10,000 means
        r = got[g]
        assert r.n == len(x) and abs(r.point - x.mean()) < 1e-6 and abs(r.lo - lo) <= error + 1e-6 and abs(r.hi - hi) <= error + 1e-6
        assert abs(r.p - min(1, 2 * min((means <= 0).mean(), (means > 0).mean()))) < 0.03
        assert r.significant == (lo > 0 or hi < 0)
    assert got["c"].lo == got["c"].hi == 0.5
    again = {r.name: r for r in B.exact_bootstrap(df.repartition(2), "name", "k", "d").collect()}
    assert again == got
    assert B.exact_bootstrap(df.limit(0), "name", "k", "d").count() == 0


def test_weighted_draws_are_multinomial(spark, monkeypatch):
    from scorewright.operators.sampling import weighted_draws

    monkeypatch.setattr(B, "LEAF", 16)
    rows = spark.createDataFrame([(k, "many" if k < 300 else "few" if k < 340 else "none", f"t{k}") for k in range(345)], "id long, g string, text string").repartition(4)
    weights = spark.createDataFrame([("many", 0.1), ("few", 0.9), ("absent", 1.0)], "g string, w double")
    got = weighted_draws(rows, "id", "g", weights, 1000).collect()
    count = {g: [r for r in got if r.g == g] for g in ("many", "few", "none")}
    assert len(count["many"]) == 100 and len({r.id for r in count["many"]}) == 100 and {r.copy for r in count["many"]} == {1}
    assert len(count["few"]) == 900 and not count["none"]
    times = np.bincount([r.id - 300 for r in count["few"]], minlength=40)
    assert 10 < times.var() < 45  # 900 draws over 40 rows: about 22; equal copies would give none
    assert sorted(r.copy for r in count["few"] if r.id == 300) == list(range(1, times[0] + 1))
    assert sorted(map(tuple, got)) == sorted(map(tuple, weighted_draws(rows.repartition(2), "id", "g", weights, 1000).collect()))
