"""The most similar label against all labels."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from scorewright.operators import nearest_label as N
from scorewright.operators.nearest_label import nearest_labels


def plain(x, own, names, c):
    unit = lambda a: a / np.linalg.norm(a, axis=1)[:, None]
    sim = np.round(unit(x) @ unit(c).T, 12)
    at = {n: k for k, n in enumerate(names)}
    out = []
    for i, s in enumerate(sim):
        best = min(range(len(names)), key=lambda k: (-s[k], names[k]))
        mine = s[at[own[i]]] if own[i] in at else None
        other = max((s[k] for k in range(len(names)) if names[k] != own[i]), default=None)
        out.append((names[best], s[best], mine, other))
    return out


def check(got, want):
    for r, (p, s, mine, other) in zip(got, want, strict=True):
        assert r.predicted == p and abs(r.similarity - s) < 1e-9
        assert (r.own_similarity is None) == (mine is None) and (mine is None or abs(r.own_similarity - mine) < 1e-9)
        assert (r.best_other is None and other is None) or abs(r.best_other - other) < 1e-9
        assert r.margin is None if mine is None or other is None else abs(r.margin - (mine - other)) < 1e-9


@pytest.mark.parametrize("cells,block", [(1024, 16_384), (40, 7), (1, 100)])
def test_same_as_all_labels(spark, cells, block):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 6)) * 5
    c = middle[rng.integers(0, 12, 300)] + rng.normal(size=(300, 6)) * 0.3
    c[50] = c[51] * 2  # the same direction: a tie
    names = [int(n) for n in rng.permutation(1000)[:300]]
    x = middle[rng.integers(0, 12, 120)] + rng.normal(size=(120, 6)) * 0.4
    x[3] = c[50]
    own = [names[k % 300] if k % 5 else 5000 + k for k in range(120)]
    rows = spark.createDataFrame([(k, r.tolist(), o, "x") for k, (r, o) in enumerate(zip(x, own, strict=True))], "k int, v array<double>, own int, label string").repartition(4)
    labels = spark.createDataFrame([(n, r.tolist()) for n, r in zip(names, c, strict=True)], "label long, centroid array<double>").repartition(3)
    got = sorted(nearest_labels(rows, "k", "v", "own", labels, "label", cells, block).collect())
    check(got, plain(x, own, names, c))
    compared = sum(r.compared for r in got)
    assert compared == 120 * 300 if cells == 1 else compared < 0.6 * 120 * 300  # the bounds rule most cells out


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0], 1), (4, [1.0, float("nan")], 1), (5, [1.0, 0.1], None), (6, [0.1, 1.0], 2)], "k int, v array<double>, own int")
    labels = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0])], "label int, centroid array<double>")
    got = {r.k: (r.predicted, r.own_similarity is not None) for r in nearest_labels(rows, "k", "v", "own", labels, "label").collect()}
    assert got == {1: (None, False), 2: (None, False), 3: (None, False), 4: (None, False), 5: (1, False), 6: (2, True)}
    one = nearest_labels(rows, "k", "v", "own", labels.limit(1), "label").where("k = 5").first()
    assert one.predicted == 1 and one.best_other is not None
    assert nearest_labels(rows, "k", "v", "own", labels.limit(0), "label").where("predicted is not null").count() == 0
    assert nearest_labels(rows.limit(0), "k", "v", "own", labels, "label").count() == 0


def test_many_labels(spark):
    """50,000 labels, more than a task may carry as a literal table."""
    rng = np.random.default_rng(5)
    c = rng.normal(size=(50_000, 3)).round(4)
    x = rng.normal(size=(200, 3)).round(4)
    rows = spark.createDataFrame([(k, r.tolist(), k) for k, r in enumerate(x)], "k long, v array<double>, own long")
    labels = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(c)], "label long, centroid array<double>")
    got = sorted(nearest_labels(rows, "k", "v", "own", labels, "label").collect())
    check(got, plain(x, list(range(200)), list(range(50_000)), c))
    assert sum(r.compared for r in got) < 0.1 * 200 * 50_000


def test_tables_and_batches_have_a_bounded_size():
    rng = np.random.default_rng(6)
    labels, x = rng.normal(size=(16_384, 4)), rng.normal(size=(1024, 4))
    sent = lambda role, v: pa.RecordBatch.from_arrays([pa.array(np.zeros(len(v), np.int64)), pa.array(np.full(len(v), role, np.int32)), pa.array(np.arange(len(v))), pa.array([r.tobytes() for r in v], pa.binary())], names=["block", "role", "id", "v"])
    batches = iter([sent(0, labels), sent(1, x)])
    tracemalloc.start()
    got = pa.Table.from_batches(N._best_two(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all similarities at once are 134 MB
    sim = np.round(x @ labels.T, 12)
    best = {}
    for i, l, s in zip(*(got[c].to_pylist() for c in ("id", "label", "similarity")), strict=True):
        best[i] = max(best.get(i, (-np.inf, 0)), (s, l))
    assert len(best) == 1024 and all(best[i][1] == sim[i].argmax() for i in range(1024)) and got["compared"].to_numpy().sum() == 1024 * 16_384
    copies = list(N._copies(sent(1, x).select(["id", "v"]), np.repeat(np.arange(1024), 50), np.tile(np.arange(50), 1024)))
    assert sum(b.num_rows for b in copies) == 1024 * 50 and max(b.num_rows for b in copies) <= 4 * N.STEP


def test_two_labels_are_written_for_a_vector_not_for_each_block(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(600, 16))  # bounds rule nothing out
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    written = []
    monkeypatch.setattr(N, "_top", lambda found, own=N._top: (written.append(found.count()), own(found))[1])
    got = {r.k: (r.predicted, r.best_other, r.compared) for r in nearest_labels(rows, "k", "v", "k", rows.selectExpr("k as label", "v as centroid"), "label").collect()}
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    sim = unit @ unit.T
    np.fill_diagonal(sim, -1)
    assert all(got[k][0] == k and abs(got[k][1] - sim[k].max()) < 1e-9 for k in range(600))
    assert max(written) <= 4 * 600 < sum(c for *_, c in got.values()) / 100
