"""BERTScore of token sequences with given token vectors, and token vectors from co-occurrence counts.

Each token of the candidate is matched with the most similar token of the reference and the other way round; precision and recall are the
means of the similarities, weighed by inverse document frequency. Pairs lie in groups of bounded number; the different tokens of a group meet
their vectors in a join, so a vector is sent once for a group and not for each pair, and the similarities are blocked matrix products in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import matrix

#: Tokens of one side whose similarities are computed at a time.
STEP = 2048
#: Pairs of a group, in which a token's vector is sent once (about).
PAIRS = 1024


def matched(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest similarity of each row of x with a row of y, and of each row of y with one of x; rows have length 1."""
    best_x, best_y = np.full(len(x), -1.0), np.full(len(y), -1.0)
    for s in range(0, len(x), STEP):
        for t in range(0, len(y), STEP):
            sim = x[s : s + STEP] @ y[t : t + STEP].T
            best_x[s : s + STEP] = np.maximum(best_x[s : s + STEP], sim.max(1))
            best_y[t : t + STEP] = np.maximum(best_y[t : t + STEP], sim.max(0))
    return best_x, best_y


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, v) of (token, vector): vectors with a length, divided by it, as bytes."""
    for b in batches:
        keep, out = [], []
        for k in range(b.num_rows):
            numbers = b.column(1).slice(k, 1).flatten()
            if len(numbers) and not numbers.null_count:
                x = numbers.to_numpy()
                n = np.sqrt(np.add.accumulate(x * x)[-1])
                if n != 0:
                    keep.append(k), out.append((x / n).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["token", "v"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(number, precision, recall) of rows (group, role, number, token, c, r, w, v), sorted: a group's tokens with weight and vector (role 0), then its pairs' tokens."""
    now, rest, words = None, None, []
    tokens, weight, vectors = None, None, None

    def scored(rows: pa.Table) -> pa.RecordBatch:
        """Of whole pairs of the group."""
        rows = rows.combine_chunks().to_batches()[0]
        at = pc.index_in(rows.column(3), value_set=tokens)
        number = rows.column(2).filter(at.is_valid())
        known = at.is_valid().to_numpy(zero_copy_only=False)
        row = at.drop_null().to_numpy()
        n_c, n_r = (rows.column(c).to_numpy().astype(np.float64)[known] for c in (4, 5))
        code = number.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, np.diff(code) != 0]) if len(code) else np.zeros(0, np.int64)
        out = []
        for i, j in zip(starts, [*starts[1:], len(code)], strict=True):
            c, r, w, v = n_c[i:j], n_r[i:j], weight[row[i:j]], vectors[row[i:j]]
            x, y = c > 0, r > 0
            best_x, best_y = matched(v[x], v[y]) if x.any() and y.any() else (np.zeros(x.sum()), np.zeros(y.sum()))
            mean = lambda best, weight: float(best @ weight / weight.sum()) if weight.sum() > 0 else 0.0
            out.append((mean(best_x, (c * w)[x]), mean(best_y, (r * w)[y])))
        return pa.RecordBatch.from_arrays([number.take(pa.array(starts)), *(pa.array([r[j] for r in out], pa.float64()) for j in (0, 1))], names=["number", "precision", "recall"])

    for b in batches:
        group, role = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = np.flatnonzero((group[1:] != group[:-1]) | (role[1:] != role[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            if i == j:
                continue
            part = pa.Table.from_batches([b.slice(i, j - i)])
            if group[i] != now:
                if rest is not None and tokens is not None:
                    yield scored(rest)
                now, rest, words, tokens = group[i], None, [], None
            if role[i] == 0:
                words.append(part)
                continue
            if words:
                held = pa.concat_tables(words).combine_chunks().to_batches()[0]
                tokens, weight, vectors, words = held.column(3), held.column(6).to_numpy(), matrix(held.column(7)), []
            if tokens is None:
                continue
            rest = part if rest is None else pa.concat_tables([rest, part])
            number = rest.column(2).combine_chunks()
            last = pc.index(number, number[len(number) - 1]).as_py()  # the last pair may go on in the next batch
            if last:
                yield scored(rest.slice(0, last))
                rest = rest.slice(last)
    if rest is not None and tokens is not None:
        yield scored(rest)


def bert_scores(pairs: DataFrame, key: str, candidate: str, reference: str, vectors: DataFrame, idf: bool = True) -> DataFrame:
    """key, precision, recall, f1 of pairs(key, candidate, reference): arrays of tokens; vectors(token, vector), each token once.

    idf: tokens weigh ln((N + 1) / (n + 1)), n being the number of the N references with the token; else each weighs the same. Tokens
    without a vector, or with one of length 0, are left out. A pair with a null or empty side has 0 in all. key is unique and not null.
    """
    side = lambda c, *n: F.transform(F.coalesce(c, F.array()), lambda t: F.struct(t.alias("token"), F.lit(n[0]).alias("c"), F.lit(n[1]).alias("r")))
    kind = pairs.schema[candidate].dataType
    both = F.concat(side(F.col(candidate), 1, 0), side(F.col(reference).cast(kind), 0, 1))
    counts = pairs.select(F.col(key).alias("number"), F.explode(both).alias("x")).groupBy("number", "x.token").agg(F.sum("x.c").alias("c"), F.sum("x.r").alias("r"))
    # lengths in numpy: as a column the length would be added up anew for each number of the vector
    words = vectors.select("token", F.col("vector").cast("array<double>")).mapInArrow(_unit, f"token {vectors.schema['token'].dataType.simpleString()}, v binary")
    n = pairs.count()
    groups = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-n // PAIRS))
    counts = counts.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))
    # c is read too, so that this is the same exchange as that of the counts below
    own = counts.where("c + r > 0").groupBy("group", "token").agg(F.count_if(F.col("r") > 0).alias("df"))
    if idf:
        seen = own.groupBy("token").agg(F.sum("df").alias("df"))
        words = words.join(seen, "token", "left").select("token", "v", F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(0)) + 1)).alias("w"))
    else:
        words = words.withColumn("w", F.lit(1.0))
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    number = pairs.schema[key].dataType
    met = own.join(words, "token").select("group", F.lit(0).alias("role"), null("number", number), "token", null("c", "long"), null("r", "long"), "w", "v")
    rows = met.unionByName(counts.select("group", F.lit(1).alias("role"), "number", "token", "c", "r", null("w", "double"), null("v", "binary")))
    sorted_ = rows.repartition("group").sortWithinPartitions("group", "role", "number", "token")
    scores = sorted_.mapInArrow(_scores, f"number {number.simpleString()}, precision double, recall double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r))
    empty = (F.size(candidate) <= 0) | (F.size(reference) <= 0)
    every = pairs.join(scores, F.col(key) == F.col("number"), "left")
    return every.select(key, *(F.when(empty, 0.0).otherwise(zero(c)).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"))))


def word_vectors(texts: DataFrame, words: str, dims: int = 64, window: int = 2, signs: int = 4) -> DataFrame:
    """(token, vector): for each word, the sum over words next to it of positive pointwise mutual information times that word's signature.

    words is an array column. A signature has `signs` places of +1 or -1 out of dims, taken from hashes of the word: a random projection of the table of
    co-occurrences, for which no word's row of that table is gathered. Neighbours are up to `window` words before and after.
    """
    near = F.flatten(F.transform(F.filter(F.sequence(F.lit(-window), F.lit(window)), lambda k: k != 0), lambda k: F.transform(F.col(words), lambda w, i: F.struct(w.alias("token"), F.when(i + k >= 0, F.get(F.col(words), (i + k).cast("int"))).alias("by")))))
    pairs = texts.where(F.size(words) > 1).select(F.explode(near).alias("x")).where("x.by is not null and x.token is not null").groupBy("x.token", "x.by").agg(F.count("*").alias("n"))
    own = pairs.groupBy("token").agg(F.sum("n").alias("n_token"))
    by = own.select(F.col("token").alias("by"), F.col("n_token").alias("n_by"))  # the window is symmetric
    total = own.agg(F.sum("n_token").alias("all"))
    rows = pairs.join(own, "token").join(by, "by").crossJoin(F.broadcast(total))  # one row
    ppmi = F.log(F.col("n").cast("double") * F.col("all") / (F.col("n_token").cast("double") * F.col("n_by")))
    h = lambda k: F.xxhash64("by", F.lit(k))
    marks = F.array(*((2 * F.pmod(h(k), F.lit(dims)) + F.pmod(F.shiftrightunsigned(h(k), 40), F.lit(2))).cast("int") for k in range(signs)))  # twice the place, 1 more for -1
    cells = rows.select("token", ppmi.alias("x"), marks.alias("m")).where("x > 0").repartition("token").sortWithinPartitions("token")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, vector) of rows sorted by token; the last token of a batch may go on in the next."""
        listed = lambda names, v: pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * dims, pa.int32()), pa.array(v.ravel()))], names=["token", "vector"])
        last, held = None, None
        for b in batches:
            if b.num_rows:
                coded = b.column(0).dictionary_encode()  # numbers in order, as equal tokens follow each other
                names, row = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                m = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                v = np.bincount((row[:, None] * dims + (m >> 1)).ravel(), (b.column(1).to_numpy()[:, None] * (1.0 - 2 * (m & 1))).ravel(), len(names) * dims).reshape(-1, dims)
                if last is not None and last[0] == names[0]:
                    v[0] += held[0]
                elif last is not None:
                    yield listed(last, held)
                yield listed(names[:-1], v[:-1])
                last, held = names[-1:], v[-1:]
        if last is not None:
            yield listed(last, held)

    return cells.mapInArrow(summed, f"token {texts.schema[words].dataType.elementType.simpleString()}, vector array<double>")


def mean_scores(scores: DataFrame, by: Column, name: str) -> DataFrame:
    """name, n, precision, recall, f1: means by a column."""
    return scores.groupBy(by.alias(name)).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))
