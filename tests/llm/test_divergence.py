"""Source divergence against plain loops; the query is held against SQL."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from scorewright.llm import divergence as D
from scorewright.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def plain(docs, least=10, top=10):
    docs = [tuple(x or "" for x in d) for d in docs]
    seen, counts = defaultdict(set), defaultdict(Counter)
    for k, (lang, source, text) in enumerate(docs):
        for t in re.findall("[A-Za-z\x80-\U0010ffff]+", text):
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            seen[lang, t].add(k)
            counts[lang, source][t] += 1
    out = []
    groups = sorted({d[:2] for d in docs})
    for lang in {g[0] for g in groups}:
        kept = [t for (v, t), ks in seen.items() if v == lang and len(ks) >= least]
        p = {}
        for s in [None, *(s for v, s in groups if v == lang)]:
            n = {t: sum(counts[lang, x][t] for v, x in groups if v == lang and s in (None, x)) for t in kept}
            p[s] = {t: 1 + 1_000_000_000 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in [s for s in p if s is not None]:
            pairs = [(q, sum(f(p[s][t], p[q][t]) for t in kept)) for q in p if q not in (None, s)]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(order, 1)]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_same_rows_as_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.sql(oracle_sql()["op11_source_divergence"])
    got = queries()["op11_source_divergence"](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == sorted(tuple(r[want.columns.index(k)] for k in ("lang", "source", "part", "item", "value", "rank")) for r in want.fetchall())


def test_odd_rows(spark):
    docs = [(lang, s, f"Common words ÄÖ {s or 'none'} {'x' * (k % 5 + 1)} İstanbul it's\n{'rare' if k % 7 == 0 else 'often often'}") for k in range(60) for lang, s in (("a", "s1"), ("a", "s2"), ("b", None), (None, "s1"), (None, None))]
    docs += [("a", "s3", None), ("a", "s4", ""), ("c", "one", "few docs"), ("c", "two", "few docs"), ("d", "alone", "words " * 3)] + [("a", "s5", "long text of words " * 20_000)] + [("e", f"s{k}", "tie tie") for k in range(12)]
    df = spark.createDataFrame([(k, *d, 1) for k, d in enumerate(docs)], "doc_id long, lang string, source string, text string, term int").repartition(7)
    assert rows(D.audit(df)) == plain(docs)
    assert rows(D.audit(df, least=1, top=2)) == plain(docs, 1, 2)
    assert rows(D.audit(df.limit(0))) == []


def test_counts_that_pass_a_hundred_billion(spark):
    big = spark.createDataFrame([(10**14, 5 * 10**14, 10**6)], "n long, size long, v long")
    from pyspark.sql import functions as F

    assert big.select(D.share(F.col("n"), F.col("size"), F.col("v"))).first()[0] == 1 + 10**9 * (10**14 + 2) // (5 * 10**14 + 2 * 10**6)


def test_partial_counts_are_handed_on(monkeypatch):
    monkeypatch.setattr(D, "HELD", 50)
    monkeypatch.setattr(D, "BLOCK", 300)
    texts = [f"w{chr(97 + k % 26)} {'y' * (k + 1)} z" for k in range(200)]
    b = pa.RecordBatch.from_arrays([pa.array(["l"] * 200), pa.array(["s"] * 200), pa.array(texts)], names=["lang", "source", "text"])
    parts = [x for b in D._counts(iter([b])) for x in b.to_pylist()]
    sums = Counter()
    for x in parts:
        sums[x["term"]] += x["n"]
    assert len(parts) > len(sums) and sums["z"] == 200 and sums == Counter(t for x in texts for t in x.split())


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="needs /proc")
def test_pairs_of_sources_without_rows_for_absent_terms():
    c = D._duck()
    c.register("rows", pa.table({"lang": ["l"] * 3, "source": ["a", "b", "c"], "term": ["x", "x", "y"], "zero": [1, 1, 1], "p": [5, 3, 4], "q": [4, 4, 4]}))
    assert c.sql(D._PAIRS).fetchall() == [("l", "a", "b", 1, 4 // 8 - 16 // 6 - 4 // 4)]
