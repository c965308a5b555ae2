"""Importance resampling towards a target: documents whose word n-grams are more usual in the target are drawn more often.

A document's words lie in a table of positions (`posexplode`), and window `lead` gives each position the words that follow
it, so that a row starts one n-gram of every order. N-grams are hashed to buckets; a bucket's gain is the logarithm of its share
in the target over its share in the source, smoothed by one. The gains, one row for each bucket, are joined to the
n-grams, and a document's weight is their sum. Gumbel noise from a hash of doc_id turns weights into scores, of which the
highest are a sample without replacement in proportion to exp(weight / 1000).

Texts are dealt to tasks once, by a number for each row; windows and sums over a document then need no other exchange. The counting pass
and the weighing pass read the same exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import positions
from .blocks import checkpointed, partitions

#: Buckets of n-grams, orders, unit of gains and scores, seed of the noise.
BUCKETS, ORDERS, UNIT, SEED = 10_000, 3, 1000, 42
#: Documents with fewer words are not drawn; share drawn of the others, in percent.
LEAST_WORDS, PERCENT = 20, 5
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: MB of input for a task: a word takes some ten times its size in a sorted position table.
TASK_MB = 12


def lowered(word: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def position_table(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(row, doc_id, pos, word, next1, ...): each word of a document with those that follow it; a document without words has one row of nulls.

    `row` numbers the rows of docs, which must come in the same order when a task is repeated, as from files or a checkpoint.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition(partitions(docs, TASK_MB), "row", "doc_id")
    words = dealt.select("row", "doc_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word")).withColumn("word", lowered(F.col("word")))
    following = Window.partitionBy("row", "doc_id").orderBy("pos")
    return words.withColumns({f"next{k}": F.lead("word", k).over(following) for k in range(1, orders)})


def features(positions: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, bucket) for every n-gram that starts at a position; a null bucket where the text ends before."""
    gram, hashes = F.col("word"), []
    for k in range(orders):
        gram = gram if not k else F.concat(gram, F.lit(" "), F.col(f"next{k}"))
        hashes.append(F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int"))
    return positions.select("row", "doc_id", F.explode(F.array(*hashes)).alias("bucket"))


def counted(rows: DataFrame) -> DataFrame:
    """(bucket, n) of features; one row for each bucket at most."""
    return rows.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS, unit: int = UNIT) -> DataFrame:
    """(bucket, gain) for each bucket of source: unit * ln of the smoothed share in target over that in source, floored."""
    double = lambda c: F.col(c).cast("double")
    sums = lambda rows, name: rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    both = source.withColumnRenamed("n", "s").join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left")  # one row for each bucket
    both = both.fillna(0, ["t"]).crossJoin(F.broadcast(sums(source, "all_s"))).crossJoin(F.broadcast(sums(target, "all_t")))  # one row each
    ratio = (double("t") + 1) * (double("all_s") + buckets) / ((double("s") + 1) * (double("all_t") + buckets))
    return both.select("bucket", F.floor(unit * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED, unit: int = UNIT) -> Column:
    """Gumbel noise from the first 32 bits of sha256('<seed>:<doc_id>'), floored; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-unit * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """row, doc_id, n_features, weight of every row of docs: the sum of the gains of its n-grams against the texts of target."""
    found = features(position_table(docs))
    aim = counted(features(position_table(target.select(F.lit(None).alias("doc_id"), "text"))))
    gain = gains(counted(found), aim)
    joined = found.join(F.broadcast(gain), "bucket", "left")  # one row for each bucket
    return joined.groupBy("row", "doc_id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs(doc_id, text): rank 1, 2, ... for the drawn rows, null for the others.

    Of the N rows of at least `least` words, floor(percent * N / 100) of the highest scores are drawn, ties to the smaller doc_id (null
    first). Null and empty texts have no n-gram, weight 0 and a score. Repeated rows each count and may be drawn; rows equal in all are in any order. An empty table gives
    an empty result. target(text) may be empty.
    """
    n = F.col("n_features")
    words = F.when(n <= 1, n).when(n == 3, 2).otherwise((n + 3) / 3).cast("long")  # of w words, w + (w - 1) + (w - 2) n-grams
    rows = checkpointed(weights(docs, target).select("row", "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"))).alias("score"), words.alias("words")))
    able = rows.where(F.col("words") >= least)
    number = able.count() * percent // 100
    ranked = positions(able, [F.desc("score"), F.asc("doc_id"), F.asc("row")], "position")
    rank = F.when(F.col("position") < number, F.col("position") + 1)
    every = ranked.withColumn("rank", rank).drop("position").unionByName(rows.where(F.col("words") < least).withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", "rank")
