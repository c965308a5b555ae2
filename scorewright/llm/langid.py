"""Language identification with error-correcting output codes.

Each language has a codeword of +1/-1; one binary classifier for each bit reads hashed character n-grams (1 to 3 letters,
lower case, one blank between words). The classifiers are ridge classifiers on a bounded sample of
labelled documents, each on one of `SUBSETS` random halves of the dimensions, so that not all bits err on the same text and the code can correct those that do. Decoding adds the exponential loss of every bit's margin and takes the codeword of the least loss; the
score is that codeword's share of exp(-loss), and a gap to the second best as small as that of the least sure fitted rows flags ambiguity. A text is rejected if its
n-grams are rarer in every language than those of that language's own sample (mean -log frequency, with an allowance
for short texts): the loss of the nearest codeword can't tell, as a text of an unlearned language may lie close to one. With few languages the
code has every split of them once (up to 7 languages: 63 bits); with more, random splits with distinct codewords, whose
number grows with the logarithm of the number of languages. Every language of the training rows is learned (of more than `ROWS`, those of the most rows).

The sample is the documents of the smallest text hashes, at most `SAMPLE` of a language and about `ROWS` in all: the same
however the table is partitioned. A longer text than `BLOCK` characters goes through a histogram of its n-grams, piece by
piece, so that memory does not grow with the n-grams of one text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import batch, checkpointed, filtered

#: Hashed n-gram dimensions; documents of each language in the sample at most, and of all (one of each language at least).
DIMS, SAMPLE, ROWS = 4096, 300, 20_000
#: The most that a row of a rare language weighs more than the average row.
HEAVIEST = 20.0
#: Share of the fitted rows that are ambiguous by their gap; bounds of that gap; margin scale.
UNSURE, AMBIGUOUS, MOST_AMBIGUOUS, SHARPNESS = 0.002, 0.05, 0.3, 4.0
#: Random halves of the dimensions; a bit's classifier reads one of them.
SUBSETS = 8
#: Rejection: standard errors allowed for a text's length; share of labelled rows that stay; nats above those; smoothing of frequencies.
ERRORS, STAY, SLACK, SMOOTH = 4.0, 0.99, 0.5, 0.02
#: Characters read at a time; longer texts go by themselves.
BLOCK = 1 << 19
ROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_()), ("rejected", pa.bool_())])
ROW_SQL = "doc_id long, lang_pred string, score double, ambiguous boolean, rejected boolean"
_LETTER: list[np.ndarray] = []
BLANK = np.array([32], np.uint32)


def letters(codes: np.ndarray) -> np.ndarray:
    """Code points with everything but letters as blanks; characters beyond the first plane are asked one by one."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16))
    high = codes >= 1 << 16
    ok = _LETTER[0][np.where(high, 0, codes)]
    if high.any():
        ok[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    return np.where(ok, codes, 32).astype(np.uint32)


def normal(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts one after another with one blank between and after words, each one's text, and each text's number of letters."""
    codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    own = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) + 1 for c in codes])
    c = letters(np.concatenate([x for t in codes for x in (t, BLANK)]))
    counts = np.bincount(own[c != 32], minlength=len(texts))
    keep = (c != 32) | np.r_[False, (c[:-1] != 32) & (own[:-1] == own[1:])]
    return c[keep], own[keep], counts


def hashed(c: np.ndarray, own: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and each one's text; those that end within the first `lead` characters are left out."""
    c, out, of = c.astype(np.uint64), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    a = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(c), np.uint64)
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = h[:m] * a + c[n - 1 :]
        same = own[:m] == own[n - 1 :]
        same[: max(0, lead - n + 1)] = False
        if n == 1:
            same &= c != 32
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((x >> np.uint64(52))[same].astype(np.int32))
        of.append(own[:m][same])
    return np.concatenate(out), np.concatenate(of)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts one after another, each gram's text, and each text's number of letters."""
    c, own, counts = normal(texts)
    return *hashed(c, own), counts


def histogram(text: str | None, step: int = BLOCK) -> np.ndarray:
    """Number of each hashed n-gram of one text, read `step` characters at a time."""
    c, own, _ = normal([text])
    out = np.zeros(DIMS, np.int64)
    for s in range(0, len(c), step):
        lead = min(s, 2)
        out += np.bincount(hashed(c[s - lead : s + step], own[s - lead : s + step], lead)[0], minlength=DIMS)
    return out


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """A +1/-1 matrix, a row for each class: all splits for up to 7 classes, else random ones."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 7:
        return np.array([[1 if i == 0 or not (s >> i - 1 & 1) else -1 for s in range(1, 1 << k - 1)] for i in range(k)], float)
    rng = np.random.default_rng(seed)
    while True:
        m = rng.choice([-1.0, 1.0], (k, 16 * k.bit_length()))
        if len(np.unique(m, axis=0)) == k and (np.abs(m.sum(axis=0)) < k).all():
            return m


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    #: -log frequency of each n-gram in each language; the highest mean that stays; the deviation of one n-gram.
    rarity: np.ndarray
    limit: np.ndarray
    spread: np.ndarray
    #: A smaller gap between the best and the second codeword is ambiguous.
    gap: float = 0.0

    def margins(self, g: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.weights.shape[1]))
        if len(g):
            # each text's n-grams of one length lie together, so a run of equal `own` is a part of a text
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for j in range(self.weights.shape[1]):
                np.add.at(out[:, j], own[starts], np.add.reduceat(self.weights[g, j], starts))
            out /= np.maximum(1, np.bincount(own, minlength=n))[:, None]
        return out + self.bias

    def strange(self, g: np.ndarray, own: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Whether each text's n-grams are too rare in every language; most texts are done with that of number `best`."""
        n = np.bincount(own, minlength=len(best))
        left, size = np.ones(len(best), bool), np.maximum(1, n)
        for j in (best, *(np.full(len(best), k) for k in range(len(self.languages)))):
            some = left[own]
            of = own[some]
            mean = np.bincount(of, self.rarity[g[some], j[of]], len(best)) / size
            left &= mean - ERRORS * self.spread[j] / np.sqrt(size) > self.limit[j]
            if not left.any():
                break
        return left

    def decoded(self, margin: np.ndarray) -> tuple[int, float, bool]:
        """Number of the nearest language, its score, whether the second is about as near."""
        loss = np.exp(-np.clip(SHARPNESS * self.code * margin, -30, 30)).mean(axis=1)
        share = np.exp(-(loss - loss.min()))
        share /= share.sum()
        order = np.argsort(loss, kind="stable")
        gap = 1.0 if len(order) < 2 else share[order[0]] - share[order[1]]
        return int(order[0]), float(share[order[0]]), bool(gap < self.gap)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, bool]]:
        """Language, score, ambiguous, rejected. No letters: `und`, score 0, rejected."""
        if not self.languages:
            return [("und", 0.0, False, True)] * len(texts)
        if len(texts) == 1 and len(texts[0] or "") > BLOCK:
            return [self.predict_long(texts[0])]
        g, own, counts = grams(texts)
        found = [self.decoded(m) if n else (0, 0.0, False) for m, n in zip(self.margins(g, own, len(texts)), counts, strict=True)]
        far = self.strange(g, own, np.array([f[0] for f in found], np.int64))
        return [(self.languages[k], s, a, bool(r)) if n else ("und", 0.0, False, True) for (k, s, a), n, r in zip(found, counts, far, strict=True)]

    def predict_long(self, text: str) -> tuple[str, float, bool, bool]:
        """The same for one long text."""
        h = histogram(text)
        n = h.sum()
        if not n:
            return "und", 0.0, False, True
        k, score, ambiguous = self.decoded(h @ self.weights.astype(np.float64) / n + self.bias)
        return self.languages[k], score, ambiguous, bool((h @ self.rarity.astype(np.float64) / n - ERRORS * self.spread / np.sqrt(n) > self.limit).all())


def grouped(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of at most `BLOCK` characters together; a longer one comes alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > BLOCK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def rarities(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, float, float]:
    """-log frequency of each n-gram in a language, the highest mean that stays, one n-gram's deviation.

    The limit is the `STAY` quantile of the language's own rows, each half held against the other half's frequencies, less
    the allowance for their lengths, and `SLACK`. A language of one row has no limit.
    """

    def profile(rows: np.ndarray) -> tuple[np.ndarray, float]:
        q = (rows.mean(axis=0, dtype=np.float64) + SMOOTH / DIMS) / (1 + SMOOTH)
        v = -np.log(q)
        return v, float(np.sqrt(max(0.0, q @ v**2 - (q @ v) ** 2)))

    rarity, spread = profile(x)
    if len(x) < 2:
        return rarity, np.inf, spread
    over = []
    for half in (0, 1):
        v, s = profile(x[1 - half :: 2])
        over.append(x[half::2] @ v - ERRORS * s / np.sqrt(sizes[half::2]))
    return rarity, max(float(np.quantile(np.concatenate(over), STAY)), float(np.exp(-rarity) @ rarity)) + SLACK, spread


def fit(x: np.ndarray, langs: list[str], sizes: np.ndarray, ridge: float = 1e-3) -> Model:
    """Ridge classifiers of all bits from n-gram frequencies; each language weighs the same, as far as `HEAVIEST` lets it. sizes: n-grams of each row.

    The normal equations are solved over the rows or over the dimensions, whichever are fewer; both give the same weights.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, 1)), np.zeros((DIMS, 1), np.float32), np.zeros(1), np.zeros((DIMS, 0), np.float32), np.zeros(0), np.zeros(0))
    code, number = codewords(len(names)), {n: k for k, n in enumerate(names)}
    of = np.array([number[v] for v in langs])
    y, count = code[of], np.bincount(of)
    w = np.minimum(len(langs) / len(names) / count, HEAVIEST)[of]
    rare, limit, spread = zip(*(rarities(x[of == k], sizes[of == k]) for k in range(len(names))), strict=True)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    z = x * scale
    mean = z.mean(axis=0)
    z -= mean
    centre = (w[:, None] * y).sum(axis=0) / w.sum()
    weights, few = np.zeros((DIMS, y.shape[1])), len(z) <= DIMS
    for group, some in enumerate(subsets()):
        bits = np.arange(group, y.shape[1], SUBSETS)
        if len(bits):
            weights[np.ix_(some, bits)] = solved(z[:, some], y[:, bits] - centre[bits], w, ridge, few)
    own = z @ weights + centre
    gaps = gaps_of(code, own)
    gap = float(np.clip(np.quantile(gaps, UNSURE), AMBIGUOUS, MOST_AMBIGUOUS)) if len(names) > 1 else 0.0
    return Model(names, code, (weights * scale[:, None]).astype(np.float32), centre - mean @ weights, np.array(rare, np.float32).T.copy(), np.array(limit), np.array(spread), gap)


def subsets(seed: int = 11) -> np.ndarray:
    """Dimensions that the classifiers of a group of bits read: a random half each, so that the bits of a text err apart from each other."""
    rng = np.random.default_rng(seed)
    return np.array([np.sort(rng.permutation(DIMS)[: DIMS // 2]) for _ in range(SUBSETS)])


def solved(z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, few: bool) -> np.ndarray:
    """Ridge weights of centred columns z for targets y, rows weighing w; over the rows if they are few, else over the dimensions."""
    damp = ridge * max(float(np.einsum("ij,ij->", z, z, dtype=np.float64)), 1e-9) / z.shape[0]
    if few:
        return z.T.astype(np.float64) @ np.linalg.solve((z @ z.T).astype(np.float64) + np.diag(damp / w), y)
    gram, right = damp * np.eye(z.shape[1]), np.zeros((z.shape[1], y.shape[1]))
    for s in range(0, z.shape[0], 2048):
        part = z[s : s + 2048].astype(np.float64)
        heavy = part * w[s : s + 2048, None]
        gram += heavy.T @ part
        right += heavy.T @ y[s : s + 2048]
    return np.linalg.solve(gram, right)


def gaps_of(code: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """How much larger the best codeword's share is than the second's, for each row of margins."""
    out = np.ones(len(margins))
    for s in range(0, len(margins), 256):
        loss = np.exp(-np.clip(SHARPNESS * code[None] * margins[s : s + 256, None], -30, 30)).mean(axis=2)
        share = np.exp(-(loss - loss.min(axis=1)[:, None]))
        share /= share.sum(axis=1)[:, None]
        if code.shape[0] > 1:
            top = np.sort(share, axis=1)
            out[s : s + 256] = top[:, -1] - top[:, -2]
    return out


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, hash, dimensions, numbers) of rows (lang, hash, text), the first of equal texts only; texts without letters teach nothing."""
    seen = set()
    for b in batches:
        for k, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if key in seen:
                continue
            seen.add(key)
            h = histogram(b.column(2)[k].as_py())
            at = np.flatnonzero(h)
            if len(at):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([at.astype("<u2").tobytes()]), pa.array([h[at].astype("<u4").tobytes()])], names=["lang", "h", "at", "n"])


def sampled(own: DataFrame, sample: int, rows: int) -> DataFrame:
    """(lang, h) of the smallest text hashes of each language: `sample` at most, about `rows` of all, one of each language at least.

    Copies have one hash, so a language of any number of copies keeps all its different texts up to that. With more than `rows` languages, those
    with the most rows in their samples are kept, ties in alphabetical order.
    """
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    top = own.groupBy("lang", "h").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample)
    top = checkpointed(top)
    langs = top.groupBy("lang").agg(F.sum("n").alias("n"))
    number = langs.count()
    if number > rows:
        top = top.join(F.broadcast(langs.orderBy(F.desc("n"), "lang").limit(rows)), "lang", "left_semi")
    return top.where(F.col("r") <= max(1, min(sample, rows // max(1, min(number, rows))))).select("lang", "h")


def learn(docs: DataFrame, train: Column, sample: int = SAMPLE, rows: int = ROWS) -> Model:
    """Fit on at most `sample` documents of each language, about `rows` of all (one of each language at least).

    Only text and non-null lang of rows where `train` holds are read; every language is learned, of more than `rows` languages those of the
    most rows. Copies of a text count as one document. The sample is the texts of the smallest hashes; its n-gram counts come to the driver.
    """
    own = docs.where(train).where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    kept = own.join(F.broadcast(sampled(own, sample, rows)), ["lang", "h"])  # at most 2 * rows hashes
    texts = kept.select("lang", "h", "text").mapInArrow(_histograms, "lang string, h long, at binary, n binary")
    found = texts.groupBy("lang", "h").agg(F.first("at").alias("at"), F.first("n").alias("n")).collect()  # a row for each text of the sample
    chosen = [(r["lang"], r["at"], r["n"]) for r in sorted(found, key=lambda r: (r["lang"], r["h"]))]
    x, sizes = np.zeros((len(chosen), DIMS), np.float32), np.zeros(len(chosen), np.int64)
    for i, (_, at, n) in enumerate(chosen):
        n = np.frombuffer(n, "<u4").astype(np.float64)
        sizes[i] = n.sum()
        x[i, np.frombuffer(at, "<u2")] = n / n.sum()
    return fit(x, [k for k, _, _ in chosen], sizes)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            s = 0
            for texts in grouped(t.as_py() for t in b.column(1)):
                yield batch(ROW, b.column(0).slice(s, len(texts)), *map(list, zip(*model.predict(texts), strict=True)))
                s += len(texts)

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous, rejected for every row; whole texts are read.

    A null text or one without letters gets `und` with score 0. `rejected` holds for those and for texts
    whose n-grams are rarer in every language than those of its sample. Ties of loss go to the language first in alphabetical order. Repeated
    rows and null ids are kept; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), ROW_SQL)


def _recognised(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            keep = [not r[3] for texts in grouped(t.as_py() for t in b.column(at)) for r in model.predict(texts)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that `identify` does not reject, whole; each is judged by its own text, whatever its doc_id. `text` is a string."""
    return filtered(docs, _recognised(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")))
