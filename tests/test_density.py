"""Density clusters against a plain O(n^2) version that cuts the tree from the top."""

import numpy as np
import pytest

from scorewright.operators import density as D
from scorewright.operators import neighbours as N
from scorewright.sources.folders import restarted


def planted(seed=1, scale=1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (n * scale, 5)) for c, s, n in ((0, 0.5, 60), (6, 0.3, 45), (-7, 1, 40), (20, 0.1, 25))] + [rng.uniform(-15, 25, (30 * scale, 5))])
    x[10] = x[11] = x[12]  # equal vectors
    return x.astype(np.float32).astype(np.float64)


def frame(spark, x):
    return spark.createDataFrame([(i * 3, r.tolist(), "x") for i, r in enumerate(x)], "k long, v array<double>, topic_name string").repartition(5)


def plain_tree(x, samples):
    d = np.sqrt(np.add.accumulate((x[:, None] - x[None]) ** 2, axis=2)[:, :, -1])
    core = np.sort(np.where(np.eye(len(x), dtype=bool), np.inf, d), axis=1)[:, min(samples, len(x) - 1) - 1]
    w = np.maximum(np.maximum(d, core[:, None]), core)
    at = {i: i for i in range(len(x))}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    out = []
    for link in sorted((w[i, j], 3 * i, 3 * j) for i in range(len(x)) for j in range(i + 1, len(x))):
        a, b = root(link[1] // 3), root(link[2] // 3)
        if a != b:
            at[a] = b
            out.append(link)
    return out


def plain_labels(n, tree, least):
    """From the top: take the longest link away; a part of `least` or more is a cluster, a smaller part leaves its cluster."""
    labels = {}

    def parts(links, members, away):
        near = {i: [] for i in members}
        for _, a, b in links:
            near[a].append(b), near[b].append(a)
        seen, todo = set(), [away[1]]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += near[i]
        return seen, members - seen

    def walk(links, members, birth, root):
        gone, total, links = set(), 0.0, sorted(links)
        while links:
            *links, away = links
            density = 1 / max(away[0], D.LEAST)
            one, two = parts(links, members - gone, away)
            inside = lambda p: [x for x in links if x[1] in p]
            if min(len(one), len(two)) >= least:
                total += (density - birth) * len(one | two)
                (sa, ga), (sb, gb) = (walk(inside(p), p, density, False) for p in (one, two))
                return (total, [members]) if not root and total >= sa + sb else (sa + sb, ga + gb)
            if max(len(one), len(two)) < least:
                return (total + (density - birth) * len(one | two), [members]) if not root else (0.0, [])
            small = min(one, two, key=len)
            total += (density - birth) * len(small)
            gone |= small
            links = [x for x in links if x[1] not in small]
        return total, [members]

    for k, group in enumerate(walk(tree, set(range(0, 3 * n, 3)), 0.0, True)[1]):
        labels |= dict.fromkeys(group, k)
    return labels


def groups(labels):
    out = {}
    for i, k in labels.items():
        out.setdefault(k, set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.fixture(scope="module")
def small(spark):
    x = planted()
    return x, frame(spark, x)


def test_neighbours_are_exact(spark, small):
    x, df = small
    for cell, block in ((10, 20), (1000, 1000)):
        got = {r.id: (r.d, r.q) for r in N.nearest(N.space(df, "k", "v", cell, block=block), 7).collect()}
        d = np.sqrt(np.add.accumulate((x[:, None] - x[None]) ** 2, axis=2)[:, :, -1])
        for i in range(len(x)):
            want = sorted((d[i, j], 3 * j) for j in range(len(x)) if j != i)[:7]
            assert list(zip(*got[3 * i], strict=True)) == want


def test_cells_share_blocks_and_tables_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(N, "AREA", 1 << 10)
    x = np.random.default_rng(2).normal(size=(1200, 12))  # bounds rule nothing out
    x[:300] = x[0]
    s = N.space(frame(spark, x), "k", "v", 5, block=150)
    held = {r["block"]: r["count"] for r in s.points.groupBy("block").count().collect()}
    assert len(s.blocks) == 240 and (s.first + s.blocks).max() <= 20 and max(held.values()) <= 220  # a vector is sent to 20 blocks, not 240 cells

    class Area:
        def __init__(self, owners):
            self.n, self.most, self.met = owners.num_rows, 0, 0

        def add(self, ids, *_):
            self.most, self.met = max(self.most, self.n * len(ids)), self.met + self.n * len(ids)

        def result(self):
            import pyarrow as pa

            yield pa.RecordBatch.from_pydict({"most": [self.most], "met": [self.met]})

    every = s.points.selectExpr("id", "x", "cell", "block", "double('inf') as reach", "0d as core", "id as comp", "0d as bound")
    got = N.search(s, every, every, Area, "most long, met long").collect()
    assert sum(r.met for r in got) == 1200 * 1200 and max(r.most for r in got) <= 16 * 220


def test_sizes_do_not_multiply_over_rounds(spark):
    t = restarted(spark.range(20).selectExpr("id", "id as c"))
    for _ in range(5):
        t = restarted(t.join(t.selectExpr("id as c", "c as d"), "c").select("id", "d").withColumnRenamed("d", "c"))
    assert len(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 25 and t.where("id = c").count() == 20


def test_tree_and_clusters_are_those_of_the_plain_version(spark, small):
    x, df = small
    tree = plain_tree(x, 5)
    s = N.space(df, "k", "v", 20, block=50)
    assert sorted(tuple(r) for r in D.spanning_tree(s, 5).collect()) == sorted(tree)
    got = {r.k: r.topic for r in D.clusters(df, "k", "v", least=12, samples=5).collect()}
    want = plain_labels(len(x), tree, 12)
    assert groups({i: t for i, t in got.items() if t >= 0}) == groups(want)
    sizes = [sum(t == k for t in got.values()) for k in range(max(got.values()) + 1)]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == 4 and -1 in got.values()


def test_ranges_and_joins_give_the_same(spark):
    x = planted(3)[::2]
    df = frame(spark, x)
    whole = {r.k: r.topic for r in D.clusters(df, "k", "v", least=8, samples=4).collect()}
    assert whole == {r.k: r.topic for r in D.clusters(df, "k", "v", least=8, samples=4, span=40, per_cell=9, listed=4).collect()}


def test_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0])] + [(k, [0.0, 0.0]) for k in range(10, 30)] + [(k, [9.0, k / 100]) for k in range(30, 50)]
    got = {r.k: r.topic for r in D.clusters(spark.createDataFrame(rows, "k int, v array<double>"), "k", "v", least=5).collect()}
    assert all(got[k] == -1 for k in range(1, 6)) and {got[k] for k in range(10, 30)} != {got[k] for k in range(30, 50)} and -1 not in {got[k] for k in range(10, 30)}
    few = spark.createDataFrame(rows[5:8], "k int, v array<double>")
    assert {r.topic for r in D.clusters(few, "k", "v", least=5).collect()} == {-1}
    assert D.clusters(few.limit(0), "k", "v").count() == 0


def test_outliers_go_to_the_topic_of_their_words(spark):
    rows = [(k, "capital ratio of banks", 0) for k in range(5)] + [(k, "market abuse by traders", 1) for k in range(5, 9)] + [(20, "the banks and their capital", -1), (21, "traders traders", -1), (22, "nothing known", -1), (23, None, -1), (24, "ratio market", -1)]
    got = {r.k: (r.topic, r.moved) for r in D.reassigned(spark.createDataFrame(rows, "k int, text string, topic int"), "k", "text").collect()}
    assert [got[k] for k in (0, 5, 20, 21, 22, 23)] == [(0, False), (1, False), (0, True), (1, True), (-1, False), (-1, False)]
    # ratio: 5/20 ln(1 + 18/5), market: 4/16 ln(1 + 18/4), each over its topic's length
    assert got[24] == (1, True)


def test_merging_a_range():
    sizes, clusters = {1: 3, 2: 3, 3: 1, 4: 6}, {4: 7}
    new, absorbed, events = D.merged([(0.5, 1, 2), (1.0, 2, 3), (2.0, 3, 4)], sizes, clusters, 6, 8)
    assert len(set(new.values())) == 1 and sizes[new[1]] == 13
    assert absorbed == {1: 8, 2: 8, 3: 8}
    assert events == [(8, None, 3, 2.0), (8, None, 3, 2.0), (8, None, 1, 1.0), (9, 8, 7, 0.5), (9, 7, 6, 0.5)]


def test_shuffles_grow_with_the_vectors_not_with_pairs(spark):
    x = np.random.default_rng(2).normal(size=(1200, 12))  # bounds rule nothing out: each of 20 blocks meets all vectors
    s = N.space(frame(spark, x), "k", "v", 5, block=60)
    every = s.points.selectExpr("id", "x", "cell", "block", "double('inf') as reach", "0d as core", "id as comp", "0d as bound")
    plan = N.search(s, every, every, lambda b: N.Knn(b, 5), "id long, d array<double>, q array<long>")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_outliers_meet_topics_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join("w" + chr(97 + int(i)) for i in rng.integers(0, 26, 8)), int(rng.integers(-1, 9))) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, text string, topic int")
    whole = {r.k: (r.topic, r.moved) for r in D.reassigned(df, "k", "text").collect()}
    for name, v in (("LOST", 3), ("TOPICS", 2), ("WORDS", 20), ("CELLS", 64)):
        monkeypatch.setattr(D, name, v)
    plan = D.reassigned(df, "k", "text")
    assert whole == {r.k: (r.topic, r.moved) for r in plan.collect()} and "_dot" not in plan._jdf.queryExecution().optimizedPlan().toString()
    share, size = {}, {}
    for _, text, t in rows:
        for w in text.split() if t >= 0 else ():
            share.setdefault(t, {}).setdefault(w, 0)
            share[t][w] += 1
    size = {t: sum(c.values()) for t, c in share.items()}
    mean, f = sum(size.values()) / len(size), {}
    for c in share.values():
        for w, n in c.items():
            f[w] = f.get(w, 0) + n
    idf = {w: np.log(1 + mean / n) for w, n in f.items()}
    x = {t: {w: n / size[t] * idf[w] for w, n in c.items()} for t, c in share.items()}
    for k, text, t in rows:
        if t < 0:
            score = {u: sum(idf[w] * x[u].get(w, 0) for w in text.split()) / np.sqrt(sum(v * v for v in x[u].values())) for u in x}
            assert whole[k] == (min(score, key=lambda u: (-round(score[u], 12), u)), True)


def test_others_beyond_the_bound_are_not_looked_at(monkeypatch):
    import pyarrow as pa

    x, looked = np.random.default_rng(8).normal(size=(400, 6)), []
    monkeypatch.setattr(N, "exact_pairs", lambda x, row, y, col, own=N.exact_pairs: (looked.append(len(row)), own(x, row, y, col))[1])
    found = []
    for bound in (np.full(400, np.inf), None):
        bound = found[0][0][:, -1] if bound is None else bound
        columns = [np.arange(400), [v.tobytes() for v in x], np.zeros(400, np.int32), np.zeros(400, np.int64), bound, bound, np.zeros(400, np.int64), bound]
        knn, before = N.Knn(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcdefgh")), 7), sum(looked)
        for k in range(0, 400, 50):
            knn.add(np.arange(k, k + 50), x[k : k + 50], None, None)
        found.append((knn.d, knn.q, sum(looked) - before))
    assert (found[0][0] == found[1][0]).all() and (found[0][1] == found[1][1]).all() and found[1][2] == 400 * 7 < found[0][2] / 2
