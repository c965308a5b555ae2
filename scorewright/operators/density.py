"""Density clusters of vectors (HDBSCAN): clusters of any shape and number, and outliers.

1. Core distances: the distance to the `samples`-th nearest other vector, from an exact search in blocks (`neighbours`).
2. A minimum spanning tree of mutual reachability distances, max(core, core, distance), by Boruvka rounds. A component's best link is
   looked for among the lists of nearest neighbours; where a vector's list ends before that link, an exact search
   with the link as bound decides. Links are ordered by (weight, smaller id, larger id), so there is one tree.
3. The condensed tree, from links in ascending order: a component of `least` vectors is a cluster; two clusters that meet
   end and begin a parent; smaller components that meet a cluster leave it there. Links are merged in ranges of bounded size, one range after another.
4. The clusters of greatest stability that don't overlap; vectors outside are outliers (-1).

Tables go through the checkpoint folder. The driver sees the pivots, one row for each range, and the clusters (at most
n / least of them, as a table of numbers; `CLUSTERS` at most).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import restarted
from . import neighbours as N
from .ranks import positions

#: Links that are merged by one task, clusters of the condensed tree at most, the least distance (equal vectors have a density of 1 / LEAST).
RANGE, CLUSTERS, LEAST = 250_000, 1_000_000, 1e-10
LINK = "w double, a long, b long"


class Outside:
    """The best link from each component of the owners to a vector of another component."""

    def __init__(self, owners: pa.RecordBatch):
        self.ids, self.x, self.core, self.comp = owners.column(0).to_numpy(), N.matrix(owners.column(1)), owners.column(5).to_numpy(), owners.column(6).to_numpy()
        self.comps, self.of = np.unique(self.comp, return_inverse=True)
        bound = np.full(len(self.comps), np.inf)
        np.minimum.at(bound, self.of, owners.column(7).to_numpy())
        self.best = bound  # links above it are of no use
        self.link: dict[int, tuple[float, int, int]] = {}

    def add(self, ids: np.ndarray, y: np.ndarray, core: np.ndarray, comp: np.ndarray) -> None:
        w = np.maximum(np.maximum(N.distances(self.x, y), self.core[:, None]), core)
        w[self.comp[:, None] == comp] = np.inf
        least = np.full(len(self.comps), np.inf)
        np.minimum.at(least, self.of, w.min(1))
        row, col = np.nonzero(w <= np.minimum(self.best, least)[self.of][:, None] * (1 + N.NEAR) + N.NEAR)
        if not len(row):
            return
        w = np.maximum(np.maximum(N.exact_pairs(self.x, row, y, col), self.core[row]), core[col])
        a, b, of = np.minimum(self.ids[row], ids[col]), np.maximum(self.ids[row], ids[col]), self.of[row]
        order = np.lexsort((b, a, w, of))
        for i in order[np.flatnonzero(np.r_[True, np.diff(of[order]) > 0])].tolist():
            new, c = (float(w[i]), int(a[i]), int(b[i])), int(of[i])
            if c not in self.link or new < self.link[c]:
                self.link[c] = new
                self.best[c] = min(self.best[c], new[0])

    def result(self) -> Iterator[pa.RecordBatch]:
        rows = [(int(self.comps[c]), *link) for c, link in self.link.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in map(list, zip(*rows, strict=True))], names=["comp", "w", "a", "b"])


def _least_links(links: DataFrame) -> DataFrame:
    """(comp, w, a, b): the first link of each component in the order of (w, a, b)."""
    return links.groupBy("comp").agg(F.min(F.struct("w", "a", "b")).alias("m")).select("comp", "m.*")


def spanning_tree(s: N.Space, samples: int, listed: int | None = None, span: int = RANGE) -> DataFrame:
    """(w, a, b): the n - 1 links of the minimum spanning tree of mutual reachability; listed: neighbours kept of each vector.

    Up to `span` links or components are merged by one task, more by joins; the tree is the same.
    """
    k = listed or 2 * samples
    lists = N.nearest(s, k)
    core = F.coalesce(F.element_at("d", F.least(F.lit(samples), F.size("d"))), F.lit(0.0))
    cores = lists.select("id", core.alias("core"), F.when(F.size("d") == k, F.element_at("d", -1)).otherwise(F.lit(float("inf"))).alias("last"))
    # limit: links of at least this weight may be missing from the vector's list
    points = restarted(s.points.join(cores, "id").select("id", "x", "cell", "block", "far", "core", F.greatest("core", "last").alias("limit"), F.col("id").alias("comp")))
    pairs = lists.select("id", F.inline(F.arrays_zip("d", "q"))).select(F.least("id", "q").alias("a"), F.greatest("id", "q").alias("b"), "d").distinct()
    both = pairs.join(points.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a").join(points.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
    links = restarted(both.select(F.greatest("d", "core_a", "core_b").alias("w"), "a", "b", F.col("a").alias("comp_a"), F.col("b").alias("comp_b")))
    tree = points.sparkSession.createDataFrame([], LINK)

    def renamed(roots: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
        """points and links with new components; links within one go."""
        table = F.broadcast(roots) if few else roots  # two rows for each of `span` links at most
        to = lambda c: table.select(F.col("comp").alias(c), F.col("root").alias(f"_{c}"))
        new = lambda rows, *cs: rows.withColumns({c: F.coalesce(f"_{c}", c) for c in cs}).drop(*(f"_{c}" for c in cs))
        own = restarted(new(points.join(to("comp"), "comp", "left"), "comp"))
        rest = new(links.join(to("comp_a"), "comp_a", "left").join(to("comp_b"), "comp_b", "left"), "comp_a", "comp_b").where("comp_a <> comp_b")
        return own, restarted(rest.select("w", "a", "b", "comp_a", "comp_b"))

    while (left := points.select("comp").distinct().count()) > 1:
        limits = restarted(points.groupBy("comp").agg(F.min("limit").alias("limit")))
        if 0 < links.count() <= span:
            # all merges of which the lists are enough
            with_limits = links.join(limits.select(F.col("comp").alias("comp_a"), F.col("limit").alias("limit_a")), "comp_a").join(limits.select(F.col("comp").alias("comp_b"), F.col("limit").alias("limit_b")), "comp_b")
            done = restarted(with_limits.select(*LINKS, "limit_a", "limit_b").repartition(1).mapInArrow(_certain, DONE))
            if not done.isEmpty():
                tree = tree.unionByName(done.where("w is not null").select("w", "a", "b"))
                points, links = renamed(done.where("root is not null").select("comp", "root"), True)
                left = points.select("comp").distinct().count()
                if left == 1:
                    break
        ends = lambda rows: rows.select(F.explode(F.array("comp_a", "comp_b")).alias("comp"), "w", "a", "b")
        # links of the lists, and of vectors with the pivots: every component has a bound
        at_pivots = _pivot_links(s, points, [tuple(r) for r in points.where(F.col("id").isin(s.pivot_ids.tolist())).select("id", "core", "comp").collect()])  # at most PIVOTS rows
        best = restarted(_least_links(ends(links).unionByName(ends(at_pivots))))
        # vectors whose lists end before their component's best link
        owners = points.join(best.select("comp", F.col("w").alias("bound")), "comp").where("limit <= bound")
        owners = restarted(owners.withColumn("reach", F.col("far") + F.col("bound")).select("id", "x", "cell", "block", "reach", "core", "comp", "bound"))
        found = N.search(s, owners, points.withColumns({"reach": F.lit(0.0), "bound": F.lit(0.0)}), Outside, "comp long, w double, a long, b long")
        best = restarted(_least_links(best.unionByName(found)))
        of = lambda n: points.select(F.col("id").alias(n), F.col("comp").alias(f"comp_{n}"))
        step = restarted(best.join(of("a"), "a").join(of("b"), "b").select("comp", *LINKS))
        tree = tree.unionByName(step.select("w", "a", "b").distinct())
        if left <= span:
            roots = restarted(step.select(*LINKS).repartition(1).mapInArrow(_together, "comp long, root long"))
        else:
            roots = _roots(step.select("comp", F.when(F.col("comp_a") == F.col("comp"), F.col("comp_b")).otherwise(F.col("comp_a")).alias("to")))
        points, links = renamed(roots, left <= span)
    return tree


LINKS = ("w", "a", "b", "comp_a", "comp_b")
DONE = "w double, a long, b long, comp long, root long"


def _numbers(batches: Iterator[pa.RecordBatch]) -> list[list]:
    parts = [b for b in batches if b.num_rows]
    return [c.to_pylist() for c in pa.Table.from_batches(parts).columns] if parts else []


class Sets(dict):
    """Disjoint sets: member -> a member nearer to the set's name."""

    def find(self, c: int) -> int:
        top = c
        while self.setdefault(top, top) != top:
            top = self[top]
        while self[c] != top:
            self[c], c = top, self[c]
        return top


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, root) of components that links join."""
    columns, sets = _numbers(batches), Sets()
    if columns:
        for x, y in zip(columns[3], columns[4], strict=True):
            x, y = sets.find(x), sets.find(y)
            sets[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([sets.find(c) for c in list(sets)], pa.int64())], names=["comp", "root"])


def _certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (DONE) that are a component's best though its vectors' lists end somewhere: those below its limit; and the components that they make."""
    columns = _numbers(batches)
    if not columns:
        return
    w, a, b, ca, cb = (np.array(c) for c in columns[:5])
    order = np.lexsort((b, a, w))
    w, a, b = w[order], a[order], b[order]
    comps, ends = np.unique(np.r_[ca[order], cb[order]], return_inverse=True)
    x, y = ends[: len(w)], ends[len(w) :]
    limit = np.full(len(comps), np.inf)
    for c, bound in ((x, columns[5]), (y, columns[6])):
        np.minimum.at(limit, c, np.array(bound, float)[order])
    at, sets, taken = np.arange(len(comps)), Sets(), []
    while len(w):
        first = np.full(len(comps), len(w))
        for c in (x, y):
            np.minimum.at(first, c, np.arange(len(w)))
        use = np.flatnonzero(first < len(w))
        use = np.unique(first[use[w[first[use]] < limit[use]]])
        if not len(use):
            break
        taken += zip(w[use].tolist(), a[use].tolist(), b[use].tolist(), strict=True)
        for i, j in zip(x[use].tolist(), y[use].tolist(), strict=True):
            i, j = sets.find(i), sets.find(j)
            sets[max(i, j)] = min(i, j)
            limit[min(i, j)] = min(limit[i], limit[j])
        at = np.array([sets.find(c) for c in at.tolist()])
        x, y = at[x], at[y]
        keep = x != y
        w, a, b, x, y = (v[keep] for v in (w, a, b, x, y))
    rows = [(*t, None, None) for t in taken] + [(None, None, None, int(comps[c]), int(comps[at[c]])) for c in np.flatnonzero(at != np.arange(len(comps))).tolist()]
    if rows:
        kinds = [pa.float64()] + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=[f.split()[0] for f in DONE.split(", ")])


def _pivot_links(s: N.Space, points: DataFrame, pivots: list[tuple[int, float, int]]) -> DataFrame:
    """(w, a, b, comp_a, comp_b): for each component of a batch and each pivot's component, the first link of the two with a pivot."""
    at = {i: k for k, i in enumerate(s.pivot_ids.tolist())}
    pivots = sorted(pivots)
    ids, core, comp = (np.array([r[j] for r in pivots], t) for j, t in enumerate((np.int64, np.float64, np.int64)))
    x = s.pivots[[at[i] for i in ids.tolist()]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, N.STEP):
                part = b.slice(k, N.STEP)
                i, y, c, own = part.column(0).to_numpy(), N.matrix(part.column(1)), part.column(2).to_numpy(), part.column(3).to_numpy()
                w = np.maximum(np.maximum(N.distances(y, x), c[:, None]), core)
                w[own[:, None] == comp] = np.inf
                # each vector's nearest pivot, and each pivot's nearest vector: a bound for both components
                row = np.r_[np.arange(len(i)), w.argmin(0)]
                col = np.r_[w.argmin(1), np.arange(len(ids))]
                ok = np.isfinite(w[row, col])
                row, col = row[ok], col[ok]
                exact = np.maximum(np.maximum(N.exactly(y[row], x[col]), c[row]), core[col])
                first = i[row] < ids[col]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (exact, np.where(first, i[row], ids[col]), np.where(first, ids[col], i[row]), np.where(first, own[row], comp[col]), np.where(first, comp[col], own[row]))], names=["w", "a", "b", "comp_a", "comp_b"])

    return points.select("id", "x", "core", "comp").mapInArrow(run, LINK + ", comp_a long, comp_b long")


def _roots(step: DataFrame) -> DataFrame:
    """(comp, root) where each component points to another and only pairs point to each other: the smaller of the pair is the root."""
    mutual = step.alias("x").join(step.alias("y"), (F.col("x.to") == F.col("y.comp")) & (F.col("y.to") == F.col("x.comp"))).where("x.comp < x.to").select(F.col("x.comp").alias("comp"), F.lit(True).alias("top"))
    at = restarted(step.join(mutual, "comp", "left").select("comp", F.when(F.col("top"), F.col("comp")).otherwise(F.col("to")).alias("root")))
    while True:
        up = at.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        new = restarted(at.join(up, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("comp", "root")
        at = new.select("comp", "root")


#: What merging a range of links gives: for each component that it touches, its new component, size and cluster, and events of the tree.
EVENT = "kind string, node long, to long, size long, cluster long, density double"


def merged(links: list[tuple], sizes: dict[int, int], clusters: dict[int, int], least: int, next_cluster: int) -> tuple[dict[int, int], dict, list[tuple]]:
    """Merge components along links (w, comp of a, comp of b) in their order.

    sizes and clusters: of the components, before and after. Result: each touched component's new one; the cluster that
    absorbed a small component; events (cluster, child cluster or None, vectors, density) of vectors that leave a cluster.
    """
    sets = Sets()
    small: dict[int, list[int]] = {}  # small components of this range that a small one is made of
    absorbed: dict[int, int] = {}
    events = []
    for w, a, b in links:
        a, b = sets.find(a), sets.find(b)
        density = 1 / max(w, LEAST)
        ca, cb = clusters.get(a), clusters.get(b)
        total = sizes[a] + sizes[b]
        if ca is None and cb is None and total >= least or ca is not None and cb is not None:
            own, next_cluster = next_cluster, next_cluster + 1
            for c, n, child in ((a, sizes[a], ca), (b, sizes[b], cb)):
                events.append((own, child, n, density))
                if child is None:
                    absorbed.update(dict.fromkeys(small.pop(c, [c]), own))
        elif ca is not None or cb is not None:
            own = ca if ca is not None else cb
            low = b if ca is not None else a
            events.append((own, None, sizes[low], density))
            absorbed.update(dict.fromkeys(small.pop(low, [low]), own))
        else:
            own = None
            small[a] = small.pop(a, [a]) + small.pop(b, [b])
        sets[b] = a
        sizes[a] = total
        clusters.pop(b, None)
        if own is not None:
            clusters[a] = own
    return {c: sets.find(c) for c in list(sets)}, absorbed, events


def _range(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort()
        sizes, clusters = {}, {}
        for _, _, _, ca, cb, sa, sb, ka, kb, _ in rows:
            sizes[ca], sizes[cb] = sa, sb
            clusters |= {c: k for c, k in ((ca, ka), (cb, kb)) if k is not None}
        start = rows[0][-1] if rows else 0
        new, absorbed, events = merged([(r[0], r[3], r[4]) for r in rows], sizes, clusters, least, start)
        out = [("node", c, t, sizes[t], clusters.get(t), None) for c, t in new.items()]
        out += [("absorbed", c, k, None, None, None) for c, k in absorbed.items()]
        out += [("event", k, child, n, None, d) for k, child, n, d in events]
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(map(list, zip(*out, strict=True)), kinds, strict=True)], names=[f.split()[0] for f in EVENT.split(", ")])

    return run


def condensed(points: DataFrame, tree: DataFrame, least: int, span: int = RANGE) -> tuple[DataFrame, list[tuple]]:
    """(id, cluster) of every vector that a cluster of the condensed tree took in, and the tree's events (cluster, child, vectors, density)."""
    ordered = positions(tree, [F.col("w"), F.col("a"), F.col("b")])
    ordered = restarted(ordered.withColumn("range", F.floor(F.col("position") / span)))
    one = lambda v: F.lit(v).cast("long")
    labels = restarted(points.select("id", F.col("id").alias("comp"), one(1).alias("size"), one(None).alias("cluster"), one(None).alias("own")))
    events: list[tuple] = []
    clusters = 0
    for k in range((ordered.agg(F.max("range")).first()[0] or 0) + 1 if not ordered.isEmpty() else 0):
        of = lambda n: labels.select(F.col("id").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("comp", "size", "cluster")))
        part = ordered.where(F.col("range") == k).join(of("a"), "a").join(of("b"), "b")
        part = part.select("w", "a", "b", "comp_a", "comp_b", "size_a", "size_b", "cluster_a", "cluster_b", one(clusters).alias("start"))
        done = restarted(part.repartition(1).mapInArrow(_range(least), EVENT))  # at most `span` rows
        events += [tuple(r) for r in done.where("kind = 'event'").select("node", "to", "size", "density").collect()]  # of clusters that span rows touch
        clusters = max((e[0] + 1 for e in events), default=0)
        if clusters > CLUSTERS:
            raise ValueError(f"more than {CLUSTERS} clusters: raise `least`")
        events = _added(events)
        # at most two rows for each link of the range
        node = F.broadcast(done.where("kind = 'node'").select(F.col("node").alias("comp"), F.col("to").alias("_to"), F.col("size").alias("_size"), F.col("cluster").alias("_cluster")))
        taken = F.broadcast(done.where("kind = 'absorbed'").select(F.col("node").alias("comp"), F.col("to").alias("_own")))
        labels = labels.join(node, "comp", "left").join(taken, "comp", "left")
        new = {"comp": F.coalesce("_to", "comp"), "size": F.coalesce("_size", "size"), "cluster": F.when(F.col("_to").isNull(), F.col("cluster")).otherwise(F.col("_cluster")), "own": F.coalesce("own", "_own")}
        labels = restarted(labels.select("id", *(v.alias(c) for c, v in new.items())))
    return labels.where("own is not null").select("id", F.col("own").alias("cluster")), events


def _added(events: list[tuple]) -> list[tuple]:
    """Events of one cluster without a child as one: (cluster, None, vectors, mean density), so that there are a few for each cluster."""
    out, sums = [], {}
    for c, child, n, d in events:
        if child is not None:
            out.append((c, child, n, d))
        else:
            old = sums.get(c, (0, 0.0))
            sums[c] = old[0] + n, old[1] + n * d
    return out + [(c, None, n, s / n) for c, (n, s) in sums.items()]


def chosen(events: list[tuple], single: bool = False) -> dict[int, int]:
    """cluster -> the chosen cluster that holds it, of greatest total stability; clusters in none are left out.

    A cluster's stability is the sum over its vectors of the density at which they leave it, less that at which it begins. The root, which is
    all vectors, counts only with single.
    """
    leave: dict[int, float] = {}
    size: dict[int, int] = {}
    birth, children, parent = {}, {}, {}
    for c, child, n, d in events:
        leave[c], size[c] = leave.get(c, 0.0) + n * d, size.get(c, 0) + n
        if child is not None:
            birth[child], parent[child] = d, c
            children.setdefault(c, []).append(child)
    pick, best = {}, {}
    for c in sorted(leave):  # a parent has a higher number than its children
        own, below = leave[c] - size[c] * birth.get(c, 0.0), sum(best[x] for x in children.get(c, ()))
        root = c not in parent
        pick[c] = (not root or single) and (not children.get(c) or own >= below)
        best[c] = max(own, below) if pick[c] else below
    out = {}
    for c in sorted(leave, reverse=True):
        above = out.get(parent.get(c, -1))
        if above is not None or pick[c]:
            out[c] = c if above is None else above
    return out


def clusters(rows: DataFrame, key: str, vector: str, least: int = 10, samples: int | None = None, single: bool = False, span: int = RANGE, per_cell: int | None = None, listed: int | None = None) -> DataFrame:
    """rows with `topic`: the density cluster of each vector (0, 1, ..., largest first), -1 for outliers.

    least: vectors of a cluster at least; samples: neighbours that make a core distance, `least` if not given. key is an integer,
    unique and not null. Null vectors, those with nulls or numbers that are not finite, and those of other lengths than most, are outliers. Equal
    vectors are at distance 0. Fewer than `least` vectors: all are outliers. An empty table gives an empty result.
    """
    samples = samples or least
    if rows.where(N.usable(rows, vector)).limit(max(2, least)).count() < max(2, least):
        return rows.withColumn("topic", F.lit(-1))
    s = N.space(rows, key, vector, per_cell or 8 * samples)
    tree = restarted(spanning_tree(s, samples, listed, span))
    members, events = condensed(s.points, tree, least, span)
    top = chosen(events, single)
    spark = rows.sparkSession
    names = spark.createDataFrame(sorted(top.items()), "cluster long, chosen long")
    found = restarted(members.join(F.broadcast(names), "cluster").select("id", "chosen"))  # at most CLUSTERS rows
    sizes = found.groupBy("chosen").count().orderBy(F.desc("count"), "chosen").collect()  # at most CLUSTERS rows
    number = spark.createDataFrame([(r["chosen"], k) for k, r in enumerate(sizes)], "chosen long, topic int")
    topics = found.join(F.broadcast(number), "chosen").select(F.col("id").alias("_id"), "topic")
    return rows.join(topics, F.col(key) == F.col("_id"), "left").withColumn("topic", F.coalesce("topic", F.lit(-1))).drop("_id")


def _pieces(batches: Iterator[pa.RecordBatch], most: int, size: int) -> Iterator[pa.Table]:
    """Tables of rows that are sorted by their first column: whole groups of equal values, `most` of them and `size` rows at most, or one group."""
    rest = None
    for b in batches:
        rest = pa.concat_tables([*([rest] if rest is not None else []), pa.Table.from_batches([b])]).combine_chunks()
        while rest.num_rows > size:
            cuts = _starts(rest)
            whole = cuts[1 : most + 1]  # where whole groups end; the last group may go on
            if not len(whole):
                break
            end = int(whole[max(0, int(np.searchsorted(whole, size, "right")) - 1)])
            yield rest.slice(0, end)
            rest = rest.slice(end).combine_chunks()
    while rest is not None and rest.num_rows:
        cuts = _starts(rest)
        end = int(cuts[most]) if len(cuts) > most else rest.num_rows
        yield rest.slice(0, end)
        rest = rest.slice(end).combine_chunks()


def _starts(rows: pa.Table) -> np.ndarray:
    """Where groups of equal values of the first column begin."""
    group = rows.column(0).combine_chunks().dictionary_encode()
    group = group.chunk(0) if isinstance(group, pa.ChunkedArray) else group
    return np.flatnonzero(np.r_[True, np.diff(group.indices.to_numpy()) != 0])


#: Outliers and topics of a piece at most, words of a piece (about), numbers in a table of words and topics (about).
LOST, TOPICS, WORDS, CELLS = 1024, 256, 1 << 18, 1 << 22


def _closest(lost: DataFrame, weight: DataFrame) -> DataFrame:
    """(_k, cosine, t) of lost (_k, _at, _y) and weight (_t, _at, _x): for each _k the topic of the greatest cosine (but for the length of _k's words), in parts."""
    lengths = weight.groupBy("_t").agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
    unit = weight.join(lengths, "_t").select("_t", "_at", (F.col("_x") / F.col("_norm")).alias("_x"))

    def packed(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _pieces(batches, most, WORDS):
                yield pa.RecordBatch.from_arrays([pa.array([N._bytes(part)], pa.binary())], names=["piece"])

        return run

    table = lambda rows, by, most: restarted(rows.repartition(by).sortWithinPartitions(by).mapInArrow(packed(most), "piece binary"))
    left = restarted(table(lost, "_k", LOST).select(F.monotonically_increasing_id().alias("number"), F.col("piece").alias("lost")))
    right = table(unit, "_t", TOPICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}  # two numbers and the key for each outlier of the task
        now, y = None, None
        for b in batches:
            for i, number in enumerate(b.column(0).to_pylist()):
                if number != now:
                    rows, now = N._table(b.column(1)[i]), number
                    starts = _starts(pa.Table.from_batches([rows]))
                    known, at = np.unique(rows.column(1).to_numpy(), return_inverse=True)
                    y = rows.column(2).to_numpy()
                    if number not in state:
                        state[number] = rows.column(0).take(pa.array(starts)), np.zeros(len(starts)), np.full(len(starts), -1, np.int64)
                _, best, topic = state[number]
                topics = N._table(b.column(2)[i])
                names, of = np.unique(topics.column(0).to_numpy(), return_inverse=True)
                place = np.searchsorted(known, topics.column(1).to_numpy())
                ok = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == topics.column(1).to_numpy())
                place, of, x = place[ok], of[ok], topics.column(2).to_numpy()[ok]
                step = max(1, CELLS // max(len(known), len(y)))
                for t in range(0, len(names), step):
                    some = (of >= t) & (of < t + step)
                    dense = np.zeros((len(known), min(step, len(names) - t)))
                    dense[place[some], of[some] - t] = x[some]
                    dots = np.add.reduceat(dense[at] * y[:, None], starts)
                    rounded = np.round(dots, 12)
                    first = rounded.argmax(1)  # of equal cosines the smallest topic comes first
                    value, name = rounded[np.arange(len(first)), first], names[t + first]
                    new = (dots[np.arange(len(first)), first] > 0) & ((value > best) | (value == best) & ((topic < 0) | (name < topic)))
                    best[new], topic[new] = value[new], name[new]
        for keys, best, topic in state.values():
            found = np.flatnonzero(topic >= 0)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(found)), pa.array(best[found]), pa.array(topic[found])], names=["_k", "cosine", "t"])

    pairs = left.crossJoin(right.hint("shuffle_replicate_nl")).select("number", "lost", "piece")
    tasks = max(1, left._jdf.rdd().getNumPartitions())
    return pairs.coalesce(tasks).mapInArrow(run, f"_k {lost.schema['_k'].dataType.simpleString()}, cosine double, t long")


def reassigned(rows: DataFrame, key: str, text: str, topic: str = "topic", token: str = r"[\p{L}]{2,}") -> DataFrame:
    """rows with `topic` of outliers (-1) replaced by the topic of the most similar words, and `moved`, whether it was.

    A topic's words weigh their share in it times ln(1 + words of a topic on average / occurrences in all topics); an outlier
    goes to the topic of the greatest cosine with its own words, weighed alike, ties to the smaller topic. Without a common word it stays -1.
    Only words of outliers that a topic has are joined. Outliers meet all topics in numpy, pieces of both read from the checkpoint folder (`_closest`):
    no row for an outlier and a topic is shuffled, of which there are as many as their product. A task holds one topic's words at least. key is unique.
    """
    words = rows.select(F.col(key).alias("_k"), F.col(topic).alias("_t"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(0))).alias("_w"))
    mine = restarted(words.where("_t >= 0").groupBy("_t", "_w").agg(F.count("*").alias("_n")))
    total = mine.groupBy("_t").agg(F.sum("_n").alias("_all"))
    every = mine.groupBy("_w").agg(F.sum("_n").alias("_f")).crossJoin(F.broadcast(total.agg(F.avg("_all").alias("_avg"))))  # one row
    idf = restarted(every.select("_w", F.log(1 + F.col("_avg") / F.col("_f")).alias("_idf"), F.monotonically_increasing_id().alias("_at")))
    weight = mine.join(total, "_t").join(idf, "_w").select(F.col("_t").cast("long").alias("_t"), "_at", (F.col("_n") / F.col("_all") * F.col("_idf")).alias("_x"))
    lost = words.where("_t < 0").groupBy("_k", "_w").agg(F.count("*").alias("_m")).join(idf, "_w").select("_k", "_at", (F.col("_m") * F.col("_idf")).alias("_y"))
    one = F.struct((-F.round("cosine", 12)).alias("far"), "t")
    best = _closest(lost, weight).groupBy("_k").agg(F.min(one).alias("_best"))
    out = rows.join(best, F.col(key) == F.col("_k"), "left")
    return out.select(*(F.coalesce(F.col("_best.t").cast(rows.schema[topic].dataType), topic).alias(c) if c == topic else c for c in rows.columns), F.col("_best").isNotNull().alias("moved"))
