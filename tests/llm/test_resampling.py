"""Importance resampling against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter

from scorewright.llm import resampling as R
from scorewright.llm.queries import queries, table

SF = "/root/testdata/sf0.001"


def plain(docs, target):
    def grams(text):
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    found = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, g in found for b in g), Counter(b for x in target for b in grams(x)[1])
    alls, allt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (alls + 10000) / ((s[b] + 1) * (allt + 10000)))) for b in s}
    rows = []
    for i, words, g in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        rows.append((i, words, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    chosen = able[: 5 * len(able) // 100]
    rank = {}
    for k, r in enumerate(chosen, 1):
        rank.setdefault(r, []).append(k)
    return sorted(((i, n, w, sc, rank[(i, words, n, w, sc)].pop(0) if rank.get((i, words, n, w, sc)) else None) for i, words, n, w, sc in rows), key=repr)


def same(df, docs, target):
    assert sorted((tuple(r) for r in df.collect()), key=repr) == plain(docs, target)


def test_query_on_whole_tables(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, SF, "benchmark").collect()]
    df = queries()["op13_importance_resampling"](spark, SF)
    assert [t for _, t in df.dtypes] == ["bigint"] * 5
    same(df, docs, target)


def test_odd_rows(spark):
    docs = [(None, None), (None, ""), (1, "One"), (1, "one TWO"), (2, "Ünï ÄB-ÇD x_y 12\n7"), (3, "?! \x00")]
    docs += [(4, "the same text here " * 6)] * 3 + [(None, "no id but the same text " * 5)] * 30 + [(k, f"word{k} and more of it " * 5) for k in range(10, 60)]
    docs += [(99, " ".join(f"w{i % 977}" for i in range(40_000)))]
    rows = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, row string, bucket double").repartition(5)  # clashing names
    target = spark.createDataFrame([("the same more",), (None,), ("",), ("word11 and",)], "text string")
    same(R.drawn(rows.sortWithinPartitions("doc_id", "text"), target), docs, [r.text for r in target.collect()])
    assert R.drawn(rows.limit(0), target).count() == 0
    same(R.drawn(rows, target.limit(0)), docs, [])


def test_a_likely_document_is_drawn_more_often(spark):
    near = "to be or not to be that is the question whether it is nobler in the mind to suffer slings and arrows"
    docs = [(k, (near if k % 10 == 0 else f"{k} lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim")) for k in range(200)]
    got = R.drawn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(near,)] * 3, "text string")).where("rank is not null").collect()
    assert len(got) == 10 and all(r.doc_id % 10 == 0 for r in got)


def test_texts_are_shuffled_once(spark, capsys):
    docs = table(spark, SF, "documents")
    plan = R.weights(docs, docs.select("text").limit(5))
    plan.collect()
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning(row") >= 1 and "ReusedExchange" in shown
