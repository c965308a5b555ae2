"""Language identification: every language is learned, decoding against plain loops, long texts, any partitioning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import langid


def made(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def many():
    """70 invented languages over alphabets of their own, 6 documents each, and one language with one document."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzàâçéèêëîïôûùüÿñæœäöß"
    names = {f"l{k:02}": "".join(rng.sample(letters, 9)) for k in range(70)}
    rows = [(k * 10 + i, made(rng, a, 150), n) for k, (n, a) in enumerate(sorted(names.items())) for i in range(6)]
    return [*rows, (9999, made(rng, "абвгдежзик", 150), "one")], names


def test_every_language_is_learned(spark, many):
    rows, names = many
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.learn(docs, F.lit(True))
    assert model.languages == sorted([*names, "one"]) and model.code.shape[0] == 71
    rng = random.Random(3)
    new = [(k, made(rng, a, 150), n) for k, (n, a) in enumerate(sorted(names.items()))] + [(99, made(rng, "абвгдежзик", 80), "one")]
    got = langid.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()
    assert sum(r.lang_pred == new[min(r.doc_id, 70)][2] for r in got) >= 69
    assert next(r for r in got if r.doc_id == 99).lang_pred == "one"


def test_sample_is_bounded_and_the_same_for_any_partitioning(spark, many):
    rows, _ = many
    rows = [(i, t if j else None, n) for j in range(2) for i, t, n in rows] + [(5000 + i, rows[0][1], "l00") for i in range(200)]
    a, b = (langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n), F.lit(True), sample=4) for n in (1, 7))
    assert (a.weights == b.weights).all() and (a.rarity == b.rarity).all() and a.languages == b.languages


@pytest.mark.parametrize("copies", [1, 50, 4000])
def test_languages_of_copies_are_learned(spark, copies):
    """However many copies a language's few texts have, they are learned, and its rows keep their language."""
    rng = random.Random(7)
    letters = {"en": "abcdefghi", "de": "jklmnopqr", "fr": "stuvwxyzé"}
    texts = {"en": [made(rng, letters["en"], 80) for _ in range(400)], "de": [made(rng, letters["de"], 80) for _ in range(2)], "fr": [made(rng, letters["fr"], 80)]}
    rows = [(t, "en") for t in texts["en"]] + [(t, "de") for t in texts["de"]] * copies + [(texts["fr"][0], "fr")] * copies
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.learn(docs.repartition(4), F.lit(True))
    assert model.languages == ["de", "en", "fr"]
    other = langid.learn(docs.repartition(3), F.lit(True), sample=500)
    assert other.languages == model.languages and len(langid.sampled(docs.select("lang", F.xxhash64("text").alias("h")), 500, 20_000).collect()) == 403
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang <> lang_pred").count() == 0 and langid.recognised(docs, model).count() == len(rows)


def test_more_languages_than_the_sample_holds(spark):
    rows = [(k, f"text {chr(97 + k % 26)} {k}", f"l{k:03}") for k in range(60)] + [(100 + k, f"many {k}", "often") for k in range(5)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), sample=3, rows=10)
    assert model.languages == [f"l{k:03}" for k in range(9)] + ["often"]


def test_both_ways_of_solving_agree(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.random((60, langid.DIMS), np.float32)
    langs, sizes = ["a", "b", "b", "c"] * 15, np.full(60, 100)
    one = langid.fit(x.copy(), langs, sizes)
    monkeypatch.setattr(langid, "len", lambda z: langid.DIMS + 1 if getattr(z, "shape", None) == x.shape else len(z), raising=False)
    other = langid.fit(x.copy(), langs, sizes)
    assert np.allclose(one.weights, other.weights, rtol=1e-2, atol=1e-2 * np.abs(one.weights).max())
    probe = rng.random((20, langid.DIMS))
    assert np.allclose(probe @ one.weights + one.bias, probe @ other.weights + other.bias, atol=1e-2)


def plain(model, text):
    """Score and language of one text by loops over its n-grams."""
    lowered = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " ".join(lowered.split())
    lead = " " if lowered.startswith(" ") and line else ""
    assert not lead
    line += " "
    found = []
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            if line[i : i + n] != " ":
                h = 0
                for c in line[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                found.append(((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 52)
    margin = [sum(float(model.weights[g, j]) for g in found) / len(found) + model.bias[j] for j in range(model.weights.shape[1])]
    losses = [np.mean([np.exp(min(30, max(-30, -langid.SHARPNESS * c * m))) for c, m in zip(row, margin, strict=True)]) for row in model.code]
    share = np.exp(-np.array(losses))
    share /= share.sum()
    rare = [sum(float(model.rarity[g, k]) for g in found) / len(found) - langid.ERRORS * model.spread[k] / len(found) ** 0.5 > model.limit[k] for k in range(len(model.languages))]
    best = int(np.argmin(losses))
    return model.languages[best], share[best], all(rare)


def test_decoding_against_plain_loops(spark, many):
    rows, names = many
    model = langid.learn(spark.createDataFrame(rows[:60] + rows[-1:], "doc_id long, text string, lang string"), F.lit(True))
    rng = random.Random(4)
    texts = [made(rng, a, rng.choice([1, 2, 20])) + rng.choice(["", ".", "  12!"]) for a in list(names.values())[:14] for _ in range(3)] + ["a", "xyz, 1 b"]
    for group in (texts, texts[:1], texts[::-1]):
        for t, (lang, score, _, rejected) in zip(group, model.predict(group), strict=True):
            assert (lang, rejected) == (plain(model, t)[0], plain(model, t)[2]) and abs(score - plain(model, t)[1]) < 1e-5


def test_long_texts_go_piece_by_piece(spark, many, monkeypatch):
    rows, _ = many
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    texts = [rows[0][1] + " 12 ", "?" * 50, rows[7][1], "a", rows[0][1][:90]]
    want = [model.predict([t])[0] for t in texts]
    whole = [langid.histogram(t) for t in texts]
    assert all((langid.histogram(t, step) == h).all() for t, h in zip(texts, whole, strict=True) for step in (1, 2, 3, 7, 64))
    monkeypatch.setattr(langid, "BLOCK", 40)
    groups = list(langid.grouped([None, *texts, None]))
    assert sum(groups, []) == [None, *texts, None] and all(len(g) == 1 or sum(len(t or "") for t in g) <= 40 for g in groups)
    for t, w in zip(texts, want, strict=True):
        got = model.predict([t])[0]
        assert (got[0], *got[2:]) == (w[0], *w[2:]) and abs(got[1] - w[1]) < 1e-6


def test_the_code_corrects_bits_that_err(spark):
    """On short texts of like languages single bits are wrong more often than the decoded language."""
    rng = random.Random(9)
    alphabets = {f"l{k}": "".join(rng.sample("abcdefghijklmn", 9)) for k in range(6)}
    rows = [(k, made(rng, a, 120), n) for k, (n, a) in enumerate(list(alphabets.items()) * 12)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    texts = [(n, made(rng, a, 6)) for n, a in alphabets.items() for _ in range(60)]
    g, own, _ = langid.grams([t for _, t in texts])
    margins = model.margins(g, own, len(texts))
    want = np.array([model.languages.index(n) for n, _ in texts])
    wrong_bits = (np.sign(margins) != model.code[want]).any(axis=1)
    wrong = np.array([model.decoded(m)[0] for m in margins]) != want
    assert wrong_bits.sum() >= 20 and wrong.sum() < 0.5 * wrong_bits.sum()
    assert np.linalg.matrix_rank(model.weights.astype(float)) > 5  # bits are no linear mixes of one classifier for each language


def test_mixed_texts_are_ambiguous(spark, many):
    _, names = many
    rng = random.Random(10)
    a, b = sorted(names)[:2]
    rows = [(k, made(rng, names[n], 120), n) for k, n in enumerate([a, b] * 30)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    clear = model.predict([made(rng, names[n], 100) for n in (a, b) for _ in range(20)])
    mixed = model.predict([" ".join(made(rng, names[n], 1) for _ in range(60) for n in (a, b)) for _ in range(20)])
    assert sum(r[2] for r in clear) == 0 and sum(r[2] for r in mixed) >= 5
