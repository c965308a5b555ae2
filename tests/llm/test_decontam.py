"""Spaced seeds: no overlap of the declared rule is missed, held against brute force over every diagonal."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from scorewright.llm import decontam


def patterns(lengths, least):
    """Every pattern of equal words (True) that is an overlap."""
    for size in lengths:
        for k in range(size // 5 + 1):
            if size - k >= least:
                for gone in itertools.combinations(range(1, size - 1), k):
                    yield [i not in gone for i in range(size)]


def hit(pattern, masks):
    return any(all(c == "0" or pattern[i + j] for j, c in enumerate(m)) for m in masks for i in range(len(pattern) - len(m) + 1))


def test_masks_hit_every_overlap():
    assert all(hit(p, decontam.MASKS) for p in patterns(range(8, 20), 8))
    for words in range(decontam.FEWEST, 9):
        need = -(-words * 4 // 5)
        assert all(hit(p, decontam.MASKS + decontam.SHORT_MASKS) for p in patterns(range(need, words + 1), need))


def stretches(same, need):
    """The same definition by trying all stretches."""
    out, todo = [], [(0, len(same))]
    while todo:
        a, b = todo.pop()
        some = [(e - s, sum(same[s:e]), -s) for s in range(a, b) for e in range(s + 1, b + 1) if same[s] and same[e - 1] and 5 * sum(same[s:e]) >= 4 * (e - s)]
        if some and max(some)[1] >= need:
            size, equal, s = max(some)
            out.append((-s, size, equal))
            todo += [(a, -s), (size - s, b)]
    return out


def overlaps(doc, item):
    need = min(8, -(-len(item) * 4 // 5))
    for d in range(-len(item) + 1, len(doc)) if len(item) >= decontam.FEWEST else ():
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        for s, size, equal in stretches([doc[i + d] == item[i] for i in range(lo, hi)], need):
            yield s + lo + d, s + lo, size, equal


def planted(rng, words):
    items = [[rng.choice(words) for _ in range(rng.choice([3, 4, 5, 6, 7, 8, 9, 12, 20]))] for _ in range(4)]
    docs = []
    for _ in range(3):
        doc = []
        for _ in range(3):
            w = list(rng.choice(items))
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            doc += [rng.choice(words) for _ in range(rng.randrange(6))] + w[rng.randrange(2) :]
        docs.append(doc)
    return docs, items


def test_columns_against_brute_force(spark):
    rng = random.Random(1)
    for words in ("ab", "abcdefg", [f"w{i}" for i in range(40)]):
        docs, items = [], []
        for _ in range(6):
            d, i = planted(rng, words)
            docs, items = docs + d, items + i
        items += items[:2]  # equal items are one class
        d = spark.createDataFrame([(k, " ".join(w).upper() if k % 2 else ", ".join(w), "x") for k, w in enumerate(docs)], "doc_id long, text string, item_id string")
        b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
        classes = {r.item_id: r.class_id for r in decontam.item_classes(b).collect()}
        assert classes == {k: items.index(w) for k, w in enumerate(items)}
        names = set(classes.values())
        got = sorted(tuple(r) for r in decontam.overlaps(d, b).select("doc_id", "item_id", "doc_start", "item_start", "length", "matches").collect())
        assert got == sorted((k, i, *x) for k, doc in enumerate(docs) for i in names for x in overlaps(doc, items[i]))
        want = {}
        for k, i, _, _, size, equal in got:
            n, best = want.get((k, i), (0, (0, 0)))
            want[k, i] = n + 1, max(best, (equal, size))
        rows = {(r.doc_id, r.item_id): (r.n_overlaps, (r.matches, r.longest)) for r in decontam.contaminated(d, b).collect()}
        assert rows == want
        assert all(abs(r.coverage - r.matches / len(items[r.item_id])) < 1e-12 and r.equal_items == items.count(items[r.item_id]) for r in decontam.contaminated(d, b).collect())
        assert sorted(r.doc_id for r in decontam.uncontaminated(d, b).collect()) == [k for k in range(len(docs)) if not any(x == k for x, _ in want)]


def test_every_place_of_substitutions():
    """Items of 8 to 20 words with every admissible choice of substituted words are found, wherever they stand."""
    rng = np.random.default_rng(3)
    for size in (9, 10, 12, 15, 20):
        item = rng.integers(1, 1 << 60, size).astype(np.uint64)
        table = decontam.Table([(1, 1, item)])
        for gone in itertools.combinations(range(1, size - 1), min(size // 5, size - 8)):
            doc = rng.integers(1, 1 << 60, size + 8).astype(np.uint64)
            doc[4 : 4 + size] = item
            doc[4 + np.array(gone)] = 7
            assert [m[2:] for m in table.matches(doc, np.zeros(len(doc), np.int64))] == [(4, 0, size, size - len(gone))]


def test_scripts_without_blanks_and_short_items(spark):
    items = [(1, "今日は天気がいいから散歩しましょう"), (2, "red green"), (3, "one two three four five"), (4, "Ünter den Linden, im “alten” Berlin")]
    docs = [(1, "昨日、今日は天気がいいから散歩しましょうと言った"), (2, "red green"), (3, "and one two, other four five so"), (4, "x ünter den linden im alten berlin y"), (5, "今日は休みです")]
    b, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()) == [(1, 1), (3, 3), (4, 4)]


def test_common_passages_and_long_texts(spark):
    """Repeated words hit everywhere: work goes in pieces, and the results are those of one overlap for each diagonal."""
    b = spark.createDataFrame([(1, "x " * 30), (2, "y z " * 20)], "item_id long, text string")
    d = spark.createDataFrame([(1, "x " * 3000), (2, "a" * 100_000), (None, "z y " * 500), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated(d, b).collect()}
    assert set(got) == {1, None} and got[1].n_overlaps == 3000 + 30 - 1 - 2 * 7 and (got[1].longest, got[1].coverage) == (30, 1.0)
    assert {r.doc_id for r in decontam.uncontaminated(d, b).collect()} == {2, 4}
    assert decontam.uncontaminated(d, b.where(F.lit(False))).count() == 4
