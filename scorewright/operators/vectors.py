"""Vector similarity to label centroids, and TF-IDF cosines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that may be carried by every task, and numbers in all their centroids.
FEW, NUMBERS = 10_000, 10_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid) by exploding positions; sums combine before the shuffle."""
    cells = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest(rows: DataFrame, labels: DataFrame, vector: str, own: str, label: str) -> DataFrame:
    """rows with predicted label, its similarity, the own label's, the best other one's and the margin between them.

    The label table is collected after a check of its size and lies in each row's expression as an array, so every
    row is scored where it is: no join and no group per row. Ties go to the smallest label.
    """
    table = labels.select(label, "centroid").orderBy(label).limit(FEW + 1).collect()
    if len(table) > FEW:
        raise ValueError(f"more than {FEW} labels: reduce them or block the rows")
    if sum(len(r[1]) for r in table) > NUMBERS:
        raise ValueError(f"centroids of more than {NUMBERS} numbers: reduce labels or dimensions")
    spark = rows.sparkSession
    # centroids of length 1, so that a row's own length is all that is left to divide by
    unit = [(r[0], [x / norm for x in r[1]] if (norm := math.sqrt(sum(x * x for x in r[1]))) else None) for r in table]
    one = spark.createDataFrame([(unit,)], f"_t array<struct<l:{labels.schema[label].dataType.simpleString()},c:array<double>>>")
    scored = rows.crossJoin(F.broadcast(one)).withColumn("_n", F.nullif(F.sqrt(dot(F.col(vector), F.col(vector))), F.lit(0.0)))  # one row, of a checked size
    scored = scored.withColumn("_s", F.transform("_t", lambda t: F.struct((dot(F.col(vector), t["c"]) / F.col("_n")).alias("sim"), t["l"].alias("l")))).drop("_t", "_n")
    top = F.aggregate("_s", F.struct(F.lit(-2.0).alias("sim"), F.lit(None).cast(labels.schema[label].dataType).alias("l")), lambda a, x: F.when(x["sim"] > a["sim"], x).otherwise(a))
    scored = scored.withColumn("_top", top)
    mine = F.get(F.filter("_s", lambda x: x["l"] == F.col(own)), F.lit(0))["sim"]
    other = F.array_max(F.transform(F.filter("_s", lambda x: x["l"] != F.col(own)), lambda x: x["sim"]))
    return scored.withColumns({"predicted": F.col("_top.l"), "similarity": F.col("_top.sim"), "own_similarity": mine, "best_other": other, "margin": mine - other}).drop("_s", "_top")


def tfidf(rows: DataFrame, key: list[str], text: str, token: str = r"[\p{L}\p{N}_]{2,}") -> DataFrame:
    """(key, term, weight): smooth idf ln((1+n)/(1+df))+1 times counts, each text of length 1."""
    n = rows.count()
    counts = rows.select(*key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(0))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    w = counts.join(df, "term").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def pair_cosine(weights: DataFrame, left: str, right: str, key: list[str], part: str) -> DataFrame:
    """(key, similarity) of the two parts of each key; 0 without a shared term."""
    side = lambda p: F.max(F.when(F.col(part) == p, F.col("weight")))
    both = weights.groupBy(*key, "term").agg(side(left).alias("a"), side(right).alias("b"))
    return both.groupBy(*key).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("similarity"))
