"""Pointwise scores to pairwise preferences, votes and pair selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import DIMS

TIE, STRONG = 1e-9, 1.5


def flatten(records: DataFrame) -> DataFrame:
    """Nested judge records to one row per (question, answerer, judge): two map explodes."""
    a = records.select("question_id", "regulator", F.explode("answers").alias("answerer", "a"))
    j = a.select("question_id", "regulator", "answerer", F.explode("a.judge_scores").alias("judge", "s"))
    return j.select("question_id", "regulator", "answerer", "judge", *(F.col(f"s.{d}").alias(d) for d in DIMS))


def complete(rows: DataFrame) -> DataFrame:
    """Rows with all dimensions, and their mean."""
    return rows.dropna(subset=DIMS).withColumn("overall", sum((F.col(d) for d in DIMS[1:]), F.col(DIMS[0])).cast("double") / len(DIMS))


def comparisons(rows: DataFrame, tie: float = TIE, strong: float = STRONG) -> DataFrame:
    """Both answerers of each (question, judge) side by side, with the preferred one and its strength.

    The two sides meet in one aggregate by (question, judge), a map-side combined shuffle instead of a self-join;
    cells without exactly two complete answerers drop out.
    """
    key = ["question_id", "regulator", "judge"]
    first = lambda f: f(F.struct("answerer", "overall"))
    cells = complete(rows).groupBy(*key).agg(first(F.min).alias("a"), first(F.max).alias("b"), F.count("*").alias("n")).where("n = 2")
    d = F.col("overall_1") - F.col("overall_2")
    wide = cells.select(*key, F.col("a.answerer").alias("answerer_1"), F.col("b.answerer").alias("answerer_2"), F.col("a.overall").alias("overall_1"), F.col("b.overall").alias("overall_2"))
    wide = wide.withColumn("diff", d).withColumn("abs_diff", F.abs(d))
    even = F.col("abs_diff") <= tie
    return wide.withColumns({
        "preferred": F.when(even, "tie").when(F.col("diff") > 0, F.col("answerer_1")).otherwise(F.col("answerer_2")),
        "strength": F.when(even, "tie").when(F.col("abs_diff") >= strong, "strong").otherwise("weak"),
    })


def measures(answerers: list[str]) -> list[Column]:
    """Counts of a group of comparisons: wins by answerer, ties, strong, weak, strong rate, mean gap."""
    wins = [F.count_if(F.col("preferred") == a).alias(f"wins_{a}") for a in answerers]
    by = [F.count_if(F.col("strength") == s).alias(n) for s, n in (("tie", "ties"), ("strong", "n_strong"), ("weak", "n_weak"))]
    return [F.count("*").alias("n"), *wins, *by, F.round(F.avg((F.col("strength") == "strong").cast("double")), 6).alias("strong_rate"), F.round(F.avg("abs_diff"), 6).alias("mean_abs_diff")]


def consensus(rows: DataFrame) -> DataFrame:
    """Votes of a question's judges; a tied vote goes to the choice whose first judge sorts first."""
    votes = rows.groupBy("question_id", "regulator", "preferred").agg(F.count("*").alias("n"), F.min("judge").alias("judge"), F.bool_and(F.col("strength") == "strong").alias("strong"), F.max("abs_diff").alias("gap"))
    best = F.min_by(F.struct("preferred", "n", "strong"), F.struct(-F.col("n"), F.col("judge"))).alias("best")
    q = votes.groupBy("question_id", "regulator").agg(F.sum("n").alias("n_judges"), best, F.greatest(F.max("gap"), F.lit(0.0)).alias("max_abs_diff"))
    every = F.col("best.n") == F.col("n_judges")
    return q.select("question_id", "regulator", "n_judges", F.col("best.preferred").alias("majority_preferred"), F.col("best.n").alias("majority_count"), every.alias("unanimous"), (every & (F.col("best.preferred") != "tie") & F.col("best.strong")).alias("unanimous_strong"), "max_abs_diff")


def selected(votes: DataFrame, least: int = 3, gap: float = STRONG) -> DataFrame:
    """Questions fit for preference pairs, with the reason for each that is not."""
    reason = F.when(F.col("majority_count") < least, "no_majority").when(F.col("majority_preferred") == "tie", "tie").when(F.col("max_abs_diff") < gap, "small_gap").otherwise("selected")
    return votes.withColumn("reason", reason)
