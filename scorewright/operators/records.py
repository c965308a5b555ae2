"""Filters, joins and orders of evaluation records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of questions that their regulator deleted, and how the stub of a deleted one begins.
DELETED = ["ESMA_ESMA_QA_1580", "ESMA_ESMA_QA_1589", "ESMA_ESMA_QA_1668", "ESMA_ESMA_QA_1569"]
STUB = "^This question was deleted"
#: What counts as a number in a text column.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def blacklisted(question_id: Column) -> Column:
    """Whether a question is one of the deleted ones; false for null."""
    return F.coalesce(question_id.isin(DELETED), F.lit(False))


def stub(text: Column) -> Column:
    """Whether a reference answer only says that its question was deleted; false for null."""
    return F.coalesce(F.regexp_replace(text, r"^\s+", "").rlike(STUB), F.lit(False))


def one_of(value: Column, wanted: list[str] | None, missing: str) -> Column:
    """A filter on a value, `missing` where it is null; without a list everything passes."""
    return F.lit(True) if wanted is None else F.coalesce(value, F.lit(missing)).isin(wanted)


def number(text: Column) -> Column:
    """The number that a text holds, else null; suffixes that only some parsers take are no numbers."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def attached(rows: DataFrame, once: DataFrame, key: list[str]) -> DataFrame:
    """rows with the columns of a table that has one row for each key, such as a similarity that was computed once; null without one."""
    return rows.join(once, key, "left")


def merged(entries: DataFrame, full: DataFrame, key: str, status: str = "final_status") -> DataFrame:
    """The entries that passed, each with the columns of its full row (null where there is none)."""
    return entries.where(F.col(status) == "PASS").drop(status).join(full, key, "left")


def rows_of_top(rows: DataFrame, ranked: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """All rows of the n first keys of a ranked table; n is the feature."""
    return rows.join(F.broadcast(ranked.orderBy(*order).limit(n).select(*key)), key, "left_semi")  # n rows


def reindexed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows in an order given from outside, with its place `ord`: one row for each listed key, null values for those without a row."""
    spine = rows.sparkSession.createDataFrame(list(enumerate(order)), f"ord long, `{key}` string")
    return spine.join(rows, key, "left").orderBy("ord")


def article_pairs(articles: DataFrame, zone: str, regulation: str, label: str) -> DataFrame:
    """Pairs of articles of different regulations within a zone: zone, pair_id, and both sides' columns with suffixes _a and _b.

    Zones of one regulation drop out before the join on the zone.
    """
    many = articles.groupBy(zone).agg((F.min(regulation) < F.max(regulation)).alias("_many")).where("_many").select(zone)
    rows = articles.join(many, zone, "left_semi")
    side = lambda s: rows.select(F.col(zone).alias(zone), *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != zone))
    pairs = side("a").join(side("b"), zone).where(F.col(f"{regulation}_a") < F.col(f"{regulation}_b"))
    name = lambda s: F.concat(F.col(f"{regulation}_{s}"), F.lit("_Art"), F.col(f"{label}_{s}").cast("string"))
    return pairs.withColumn("pair_id", F.concat(name("a"), F.lit("_x_"), name("b")))


def sequence_id(rank: Column, tier: str = "T1") -> Column:
    """T1-001, T1-002, .."""
    return F.format_string(f"{tier}-%03d", rank)


def completion_logprob(logprobs: Column, prompt: Column) -> Column:
    """Sum of the token log-probabilities after a prompt of so many tokens; 0 if none is left."""
    return F.aggregate(F.slice(logprobs, prompt + 1, F.greatest(F.size(logprobs) - prompt, F.lit(0))), F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean_bert_score(rows: DataFrame, by: list[str], scorer=None) -> DataFrame:
    """by, mean score of an injected column function scorer(candidate, reference); null without one (models are the caller's)."""
    score = F.lit(None).cast("double") if scorer is None else scorer(F.col("candidate"), F.col("reference"))
    return rows.groupBy(*by).agg(F.avg(score).alias("bert_score"))
