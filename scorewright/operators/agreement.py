"""Inter-rater agreement and rank statistics as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rater_pairs(rows: DataFrame, key: list[str], rater: str, score: str) -> DataFrame:
    """(key, rater_1, rater_2, a, b) for each unordered pair of raters of one item, from one aggregate; raters of an item are few."""
    one = F.struct(F.col(rater).alias("rater"), F.col(score).alias("score"))
    items = rows.where(F.col(score).isNotNull()).groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("_r"))
    pairs = F.flatten(F.transform("_r", lambda x, i: F.transform(F.filter("_r", lambda y, j: (j > i) & (y["rater"] > x["rater"])), lambda y: F.struct(x["rater"].alias("rater_1"), y["rater"].alias("rater_2"), x["score"].alias("a"), y["score"].alias("b")))))
    return items.select(*key, F.explode(pairs).alias("_p")).select(*key, "_p.*")


def kappa(pairs: DataFrame, by: list[str], power: int, labels: int = 5) -> DataFrame:
    """Weighted Cohen kappa of integer labels 1..labels; power 1 linear, 2 quadratic. Null where chance agreement is total.

    Everything comes from the confusion counts, at most labels^2 rows a group.
    """
    cells = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    cells = cells.withColumns({"total": F.sum("n").over(group)})
    rows = cells.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*by, "b").agg(F.sum("n").alias("nb"), F.max("total").alias("total"))
    weight = F.pow(F.abs(F.col("a") - F.col("b")).cast("double"), F.lit(float(power)))
    seen = cells.groupBy(*by).agg(F.sum(weight * F.col("n")).alias("seen"), F.max("total").alias("n"))
    expected = rows.join(cols, by).groupBy(*by).agg(F.sum(weight * F.col("na") * F.col("nb") / F.col("total")).alias("expected"))
    return seen.join(expected, by).select(*by, "n", F.when(F.col("expected") > 0, 1 - F.col("seen") / F.col("expected")).alias("kappa"))


def krippendorff(a: Column, b: Column) -> Column:
    """Interval alpha of two raters in one aggregate; null where all values are equal."""
    n = 2 * F.count("*").cast("double")
    s, q = F.sum(a + b).cast("double"), F.sum(a * a + b * b).cast("double")
    seen = F.avg(((a - b) * (a - b)).cast("double"))
    expected = (2 * n * q - 2 * s * s) / (n * (n - 1))
    return F.when(expected > 0, 1 - seen / expected)


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Rows with the average rank of value within a group.

    Equal values are counted first, so the window runs over distinct values and no unpartitioned window over rows
    is needed.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn(out, F.sum("_n").over(w) - (F.col("_n") - 1) / 2).drop("_n")
    return rows.join(ranks, [*by, value])


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation by group; null where a side is constant."""
    ranked = average_ranks(average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson("_rx", "_ry").alias("rho"))


def pearson(x: str, y: str) -> Column:
    """corr() with null where it is undefined."""
    return F.nanvl(F.corr(x, y), F.lit(None).cast("double"))
