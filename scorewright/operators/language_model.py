"""An interpolated Kneser-Ney model of word trigrams, counted in Spark, and log-probabilities of completions under it.

Tables of n-grams stay tables: counts are combinable aggregates, and a text's n-grams meet them in joins. Scoring first reduces
the n-grams to be looked up to different ones, so a frequent n-gram is looked up once; the rows of one key in those joins are at
most the words of the vocabulary. No table of n-grams is broadcast, whatever Spark estimates. Only nine totals of the model come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..sources.folders import checkpointed
from ..sources.views import dealt

START, END = "<s>", "</s>"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
#: The discount where counts of one and two don't give one.
DISCOUNT = 0.75
GRAMS = "array<struct<u:string,v:string,w:string>>"


def tokens(text: Column) -> Column:
    """Words and marks in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def trigrams(words: Column, first: Column | int = 0) -> Column:
    """(u, v, w) for each word w from number `first` on, u and v being the words before it or START.

    Without a lambda over the words: there Spark would compute `words` anew for each of its elements.
    """
    padded = F.concat(F.array(F.lit(START), F.lit(START)), words)
    n = F.size(words)
    grams = F.arrays_zip(padded, F.slice(padded, F.lit(2), n), F.slice(padded, F.lit(3), n)).cast(GRAMS)
    first = F.lit(first) if isinstance(first, int) else first
    return F.coalesce(F.slice(grams, first + 1, F.greatest(n - first, F.lit(0))), F.array().cast(GRAMS))


@dataclass
class Model:
    """n-gram tables with counts n, contexts with total and types, and what lower orders need."""

    three: DataFrame  # u, v, w, n
    after_two: DataFrame  # u, v, total, types
    two: DataFrame  # v, w, n: words before v w
    after_one: DataFrame  # v, total, types
    one: DataFrame  # w, n: words before w
    total: int
    types: int
    discounts: tuple[float, float, float]  # of one, two, three


def _discount(counts: DataFrame) -> float:
    """n1 / (n1 + 2 n2), of the n-grams seen once and twice."""
    n1, n2 = counts.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    return n1 / (n1 + 2 * n2) if n1 and n2 else DISCOUNT


def fit(texts: DataFrame, text: str) -> Model:
    """Count the texts; each begins with two START and ends with END. Null and empty texts are an END."""
    words = texts.select(once(F.concat(tokens(F.col(text)), F.array(F.lit(END)))).alias("words"))
    grams = words.select(F.explode(trigrams(F.col("words"))).alias("g")).select("g.*")
    three = checkpointed(grams.groupBy("u", "v", "w").agg(F.count("*").alias("n")))
    two = checkpointed(three.groupBy("v", "w").agg(F.count("*").alias("n")))
    one = checkpointed(two.groupBy("w").agg(F.count("*").alias("n")))
    context = lambda t, *by: checkpointed(t.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("types")))
    total, types = one.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Model(three, context(three, "u", "v"), two, context(two, "v"), one, total, types, (_discount(one), _discount(two), _discount(three)))


def probabilities(model: Model, grams: DataFrame) -> DataFrame:
    """(u, v, w, p) of different trigrams (u, v, w); a word that the model has not seen has the share of an unseen one."""
    d1, d2, d3 = model.discounts
    n = F.coalesce("n", F.lit(0))

    def mixed(d: float, below: str) -> Column:
        seen = (F.greatest(n - d, F.lit(0.0)) + d * F.col("types") * F.col(below)) / F.col("total")
        return F.when(F.col("total").isNull(), F.col(below)).otherwise(seen)

    pairs = grams.select("v", "w").distinct()
    if model.total:
        own = (F.greatest(n - d1, F.lit(0.0)) + F.lit(d1) * model.types / (model.types + 1)) / model.total
    else:
        own = F.lit(1.0)
    one = pairs.select("w").distinct().join(dealt(model.one), "w", "left").select("w", own.alias("p1"))
    two = pairs.join(dealt(model.two), ["v", "w"], "left").join(dealt(model.after_one), "v", "left").join(dealt(one), "w").select("v", "w", mixed(d2, "p1").alias("p2"))
    three = grams.join(dealt(model.three), ["u", "v", "w"], "left").join(dealt(model.after_two), ["u", "v"], "left").join(dealt(two), ["v", "w"])
    return three.select("u", "v", "w", mixed(d3, "p2").alias("p"))


def score(model: Model, rows: DataFrame, key: list[str], prompt: str, completion: str, most: int | None = None) -> DataFrame:
    """key, n_tokens, logprob of each row: the sum of ln P(word | two words before) over the completion's words, after the prompt's.

    most: words of prompt and completion together at most; the rest is cut off. Null texts are empty; without words of the completion the sum is
    0. Rows with one key are added up.
    """
    before, after = tokens(F.col(prompt)), tokens(F.col(completion))
    words = F.concat("_words.before", "_words.after")
    grams = trigrams(F.slice(words, 1, most) if most else words, F.size("_words.before"))
    split = rows.select(*key, once(F.struct(before.alias("before"), after.alias("after"))).alias("_words"))
    own = split.select(*key, F.explode(grams).alias("g")).groupBy(*key, "g.u", "g.v", "g.w").agg(F.count("*").alias("times"))
    p = probabilities(model, own.select("u", "v", "w").distinct())
    sums = own.join(dealt(p), ["u", "v", "w"]).groupBy(*key).agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.log("p")).alias("logprob"))
    named = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), "n_tokens", "logprob")
    same = None
    for i, k in enumerate(key):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    every = rows.select(*key).distinct().join(dealt(named), same, "left")
    return every.select(*key, F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("logprob", F.lit(0.0)).alias("logprob"))
