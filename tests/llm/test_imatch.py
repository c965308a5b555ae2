"""I-Match against plain Python: lexicon, fingerprints, likeness, neighbours; ids of any span, null and repeated."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from scorewright.llm import imatch


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def hashed(terms):
    """Spark's hash of an array of longs: each value's XXH64 with the one before as seed."""
    h = imatch.NONE
    for t in terms:
        h = xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), h)
    return h


def terms_of(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\W_]+", (text or "").lower()) if w}


def plain(texts):
    """Function text -> fingerprint, with the exact band spread to the bits of the map."""
    n, df = len(texts), {}
    for t in texts:
        for h in terms_of(t):
            df[h] = df.get(h, 0) + 1
    size = imatch.LEAST_BITS
    at = lambda h: (h % (1 << 64) >> 38) & size - 1
    bits = {at(h) for h, c in df.items() if imatch.LEAST * n <= c <= max(1, imatch.MOST * n)}

    def fingerprint(text):
        every = sorted(terms_of(text))
        known = [h for h in every if at(h) in bits]
        out = []
        for s in imatch.SHIFTS:
            for z in imatch.ZEROS:
                out.append(hashed([h for h in known if not h >> s & (1 << z) - 1]))
        return out if any(h != imatch.NONE for h in out) else [hashed(known or every)] * len(out)

    return fingerprint


def likeness(a, b):
    used = [x == y for x, y in zip(a, b, strict=True) if x != imatch.NONE or y != imatch.NONE]
    return sum(used) / len(used) if used else 1.0


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(900)] + ["été", "Straße", "日本語"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.choice([1, 3, 10, 60, 400])) for _ in range(120)] + ["", "?!", None, prose(20_000)]
    return [(1 << 60, texts[0]), (-(1 << 63), texts[1]), ((1 << 63) - 1, texts[2])] + list(enumerate(texts)) + [(5, "same id"), (5, texts[5]), (None, "no id"), (None, None), (None, "no id")]


def test_all_columns_against_plain_python(spark, rows):
    docs = spark.createDataFrame([(i, t, "f", 1, 2) for i, t in rows], "doc_id long, text string, fingerprint string, k int, c int").repartition(5)
    got = imatch.fingerprints(docs).collect()
    fp = plain([t for _, t in rows])
    order = sorted(((i is not None, i or 0, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), i, t or "") for i, t in rows), key=lambda r: r[:3], reverse=True)
    want = []
    for k, (*_, i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][-1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = fp(t), fp(edited), fp(following)
        hexed = lambda x: "".join(format(h % (1 << 64), "016x") for h in x)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_ranges_are_even_whatever_the_ids(spark):
    ids = list(range(3000)) + [1 << 60, -(1 << 63), (1 << 63) - 1] + [77] * 1500 + [None] * 1500
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    cuts = imatch.limits(docs.select(key.alias("key")), 64)
    assert cuts == sorted(set(cuts), reverse=True) and 40 <= len(cuts) <= 65
    keys = [tuple(r.k) for r in docs.select(key.alias("k")).collect()]
    assert cuts[0] == max(keys)
    sizes = [sum(a >= k > b for k in keys) for a, b in zip(cuts, [*cuts[1:], (False, -(1 << 64), 0)], strict=True)]
    assert sum(sizes) == len(keys) and max(sizes) <= 6 * len(keys) / 64


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(3, "only these words")], "doc_id long, text string")
    r = imatch.fingerprints(one).first()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"only theonly the").hexdigest()
    assert imatch.fingerprints(one.where("false")).count() == 0


def test_map_grows_with_the_band(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(imatch, "LEAST_BITS", 1 << 10)
    _, size = imatch.lexicon(docs)
    assert size == 1 << 15 and imatch.band(docs).count() == 900
    assert imatch.band(docs, 0.01).count() == 0 and imatch.band(docs.union(docs.limit(1)), 0, 0.0).count() == 897
