"""Trigram probabilities, token matching, word vectors and latent vectors against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.operators import bert_score as B
from scorewright.operators import language_model as L
from scorewright.operators import latent
from scorewright.sources.views import table

SF = "/root/testdata/sf0.001"
TEXTS = ["The bank must hold capital.", "the bank may hold capital; the board must act", "A board must hold the bank", None, "", "Über-Bank hält Kapital", "the the the bank"]


def split(text):
    return re.findall(r"\w+|[^\s\w]", (text or "").lower())


class Plain:
    """Interpolated Kneser-Ney from its definition."""

    def __init__(self, texts):
        self.c3 = Counter()
        for t in texts:
            x = ["<s>", "<s>", *split(t), "</s>"]
            self.c3.update(zip(x, x[1:], x[2:], strict=False))
        self.c2 = Counter((v, w) for _, v, w in self.c3)
        self.c1 = Counter(w for _, w in self.c2)
        self.d = [self.discount(c) for c in (self.c1, self.c2, self.c3)]

    @staticmethod
    def discount(c):
        n1, n2 = (sum(n == k for n in c.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75

    def p(self, u, v, w):
        d1, d2, d3 = self.d
        total = sum(self.c1.values())
        p = (max(self.c1[w] - d1, 0) + d1 * len(self.c1) / (len(self.c1) + 1)) / total
        for counts, before, d in ((self.c2, (v,), d2), (self.c3, (u, v), d3)):
            found = [n for g, n in counts.items() if g[:-1] == before]
            if found:
                p = (max(counts[(*before, w)] - d, 0) + d * len(found) * p) / sum(found)
        return p


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.createDataFrame([(t, 1) for t in TEXTS], "text string, n int").repartition(3), "text")


def test_probabilities_are_those_of_the_definition_and_sum_to_one(spark, model):
    plain = Plain(TEXTS)
    vocabulary = [*plain.c1, "never-seen"]
    contexts = [("<s>", "<s>"), ("the", "bank"), ("bank", "must"), ("no", "bank"), ("no", "no"), ("<s>", "the")]
    grams = [(u, v, w) for u, v in contexts for w in vocabulary]
    got = {(r.u, r.v, r.w): r.p for r in L.probabilities(model, spark.createDataFrame(grams, "u string, v string, w string")).collect()}
    assert all(abs(got[g] - plain.p(*g)) < 1e-12 for g in grams)
    for u, v in contexts:
        assert abs(sum(got[u, v, w] for w in vocabulary) - 1) < 1e-9


def test_completions_are_scored_after_their_prompt(spark, model):
    plain = Plain(TEXTS)
    rows = [(1, "The bank", "must hold capital"), (2, None, "the bank"), (3, "the board", ""), (4, "the", None), (5, "", "unknown words, here"), (None, "a", "board")]
    df = spark.createDataFrame(rows, "k long, q string, u string")  # a clashing name
    for most in (None, 3):
        got = {r.k: (r.n_tokens, r.logprob) for r in L.score(model, df, ["k"], "q", "u", most).collect()}
        for k, q, a in rows:
            x = ["<s>", "<s>", *(split(q) + split(a))[:most]]
            logs = [math.log(plain.p(*x[i : i + 3])) for i in range(len(split(q)), len(x) - 2)]
            assert got[k][0] == len(logs) and abs(got[k][1] - sum(logs)) < 1e-9
    assert L.score(model, df.limit(0), ["k"], "q", "u").count() == 0


def test_no_table_of_words_is_broadcast(spark, model):
    import __spark_entry__

    rows = spark.createDataFrame([(1, "the bank", "must hold capital")], "id long, prompt string, answer string")
    for found in (L.score(model, rows, ["id"], "prompt", "answer"), __spark_entry__.queries()["completion_logprobs"](spark, SF)):
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
        found.collect()
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_trigrams_compute_their_words_once(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for first in (0, 2, 9):
        got = df.select("t", L.trigrams(L.tokens(df.t), first).alias("g"))
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()  # in one, the words would be split anew for each of them
        for t, grams in got.collect():
            x = ["<s>", "<s>", *split(t)]
            assert [tuple(g) for g in grams] == list(zip(x, x[1:], x[2:], strict=False))[first:]


def test_an_empty_model_gives_every_word_the_same(spark):
    model = L.fit(spark.createDataFrame([], "text string"), "text")
    assert L.score(model, spark.createDataFrame([(1, "a", "b c")], "k int, q string, t string"), ["k"], "q", "t").first().logprob == 0.0


def plain_scores(c, r, vectors, idf):
    c, r = ([t for t in x or [] if t in vectors] for x in (c, r))
    if not c or not r:
        return 0.0, 0.0, 0.0
    cos = lambda a, b: float(np.dot(vectors[a], vectors[b]) / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b]))
    p = sum(idf(t) * max(cos(t, x) for x in r) for t in c) / sum(map(idf, c))
    q = sum(idf(t) * max(cos(t, x) for x in c) for t in r) / sum(map(idf, r))
    return p, q, 2 * p * q / (p + q) if p + q > 0 else 0.0


@pytest.mark.parametrize("step", [2048, 2])
@pytest.mark.parametrize("weigh", [True, False])
def test_matching_is_greedy_in_both_ways(spark, monkeypatch, step, weigh):
    monkeypatch.setattr(B, "STEP", step)
    rng = np.random.default_rng(0)
    vectors = {f"t{k}": rng.normal(size=6) for k in range(12)}
    rows = [(k, [f"t{i}" for i in rng.integers(0, 14, rng.integers(0, 15))], [f"t{i}" for i in rng.integers(0, 14, rng.integers(0, 15))]) for k in range(20)]
    rows += [(30, None, ["t1"]), (31, ["t1"], []), (32, ["t1", "t1"], ["t1"]), (33, ["t13"], ["t1"])]
    pairs = spark.createDataFrame(rows, "id int, a array<string>, b array<string>").repartition(3)
    table_ = spark.createDataFrame([(t, v.tolist()) for t, v in vectors.items()] + [("t12", [0.0] * 6)], "token string, vector array<double>")
    seen = Counter(t for _, _, r in rows for t in set(r or []))
    idf = (lambda t: math.log((len(rows) + 1) / (seen[t] + 1))) if weigh else (lambda t: 1.0)
    got = {r.id: (r.precision, r.recall, r.f1) for r in B.bert_scores(pairs, "id", "a", "b", table_, weigh).collect()}
    for k, c, r in rows:
        assert np.allclose(got[k], plain_scores(c, r, vectors, idf), atol=1e-9), k


def test_words_of_the_same_neighbours_have_like_vectors(spark):
    rows = [["big", x, "runs", "fast", "home"] for x in ("dog", "cat") for _ in range(20)] + [["old", "law", "binds", "every", "bank"]] * 20 + [["one"], None, []]
    v = {r.token: np.array(r.vector) for r in B.word_vectors(spark.createDataFrame([(r,) for r in rows], "w array<string>"), "w", dims=32).collect()}
    cos = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    assert set(v) == {"big", "dog", "cat", "runs", "fast", "home", "old", "law", "binds", "every", "bank"} and all(len(x) == 32 for x in v.values())
    assert cos("dog", "cat") > 0.95 > 0.6 > cos("dog", "law")


def test_vectors_are_summed_over_batches_and_their_lengths_computed_once(spark):
    rows = spark.createDataFrame([(["big", x, "runs", "fast", "home"],) for x in ("dog", "cat", "fox", "hen")] + [(["old", "law", "binds", "every", "dog"],)], "w array<string>")
    got = lambda: {r.token: np.array(r.vector) for r in B.word_vectors(rows, "w", dims=16).collect()}
    want = got()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        parts = got()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(parts) == set(want) and all(np.allclose(parts[k], want[k], atol=1e-12) for k in want)
    pairs = spark.range(2).select(F.concat(F.lit("p"), "id").alias("pair"), F.array(F.lit("dog")).alias("a"), F.array(F.lit("cat")).alias("b"))
    plan = B.bert_scores(pairs, "pair", "a", "b", B.word_vectors(rows, "w", dims=16))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "map_from_entries" not in plan  # lengths and places in numpy, not once for each number


def exact_matrix(texts):
    docs = {k: Counter(re.findall(r"\w{2,}", (t or "").lower())) for k, t in texts}
    df = Counter(t for c in docs.values() for t in c)
    names = sorted(df)
    rows = {}
    for k, c in docs.items():
        x = np.array([c[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in names])
        if x.any():
            rows[k] = x / np.linalg.norm(x)
    return rows


def test_singular_values_and_vectors(spark):
    texts = [(r.conv_id * 100 + r.turn, r.text) for r in table(spark, SF, "conversations").collect()] + [(10**6, None), (10**6 + 1, "? !")]
    rows = exact_matrix(texts)
    u, s, vt = np.linalg.svd(np.array(list(rows.values())), full_matrices=False)
    space = latent.decomposed(spark.createDataFrame(texts, "id long, text string").repartition(3), "id", "text", 8)
    assert np.abs(space.values / s[:8] - 1).max() < 0.01
    assert np.abs(space.directions.T @ space.directions - np.eye(8)).max() < 1e-9
    # the first three stand apart from the others, so their space is well defined
    space = latent.decomposed(spark.createDataFrame(texts, "id long, text string"), "id", "text", 3)
    got = {r.id: np.array(r.vector) for r in latent.vectors(space, "id").collect()}
    assert set(got) == set(rows)
    want = {k: v / np.linalg.norm(v) for k, v in zip(rows, u[:, :3] * s[:3], strict=True)}
    keys = list(rows)[:40]
    assert max(abs(got[a] @ got[b] - want[a] @ want[b]) for a in keys for b in keys) < 0.02


def test_few_texts_and_terms(spark):
    df = spark.createDataFrame([(1, "one word"), (2, "word two"), (3, None)], "id int, text string")
    space = latent.decomposed(df, "id", "text", 50)
    assert len(space.values) == 3 and {r.id for r in latent.vectors(space, "id").collect()} == {1, 2}
    top = latent.decomposed(df, "id", "text", 2, terms=1)
    assert top.terms.collect()[0].term == "word" and abs(top.values[0] - math.sqrt(2)) < 1e-9
    none = latent.decomposed(df.limit(0), "id", "text", 2)
    assert len(none.values) == 0 and latent.vectors(none, "id").count() == 0


def test_a_group_of_pairs_gets_a_vector_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    given = {f"w{k}": rng.normal(size=6) for k in range(30)}
    rows = [(k, [f"w{i}" for i in rng.integers(0, 33, 9)], [f"w{i}" for i in rng.integers(0, 33, 7)]) for k in range(90)]  # w30 to w32 have no vector
    pairs = spark.createDataFrame(rows, "k long, a array<string>, b array<string>")
    vectors = spark.createDataFrame([(t, v.tolist()) for t, v in given.items()], "token string, vector array<double>")
    want = {}
    for k, a, b in rows:
        x, y = ([given[t] / np.sqrt((given[t] ** 2).sum()) for t in side if t in given] for side in (a, b))
        sim = np.array(x) @ np.array(y).T
        want[k] = (sim.max(1).mean(), sim.max(0).mean())
    found = B.bert_scores(pairs, "k", "a", "b", vectors, idf=False)
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    for size in ("10000", "7"):  # pairs go over batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r.k: (r.precision, r.recall) for r in found.collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
