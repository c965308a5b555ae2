"""Adapter views: evaluation records derived from the star-schema tables, the same in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMS = ["accuracy", "completeness", "topic_coherence", "citation_quality"]

JUDGMENTS_SQL = """judgments as (
select l_partkey as question_id, case when l_partkey % 2 = 0 then 'EBA' else 'ESMA' end as regulator,
       l_linestatus as answerer, l_returnflag as judge,
       1 + cast(max(l_quantity) as int) % 5 as accuracy, 1 + cast(min(l_quantity) as int) % 5 as completeness,
       1 + cast(round(max(l_discount) * 100) as int) % 5 as topic_coherence,
       case when cast(round(min(l_tax) * 100) as int) = 8 then null
            else 1 + cast(max(l_linenumber) + min(l_linenumber) as int) % 5 end as citation_quality
from lineitem group by l_partkey, l_linestatus, l_returnflag)"""
COMPLETE_SQL = (
    JUDGMENTS_SQL
    + """, complete as (select *, cast(accuracy + completeness + topic_coherence + citation_quality as double) / 4 as overall
from judgments where accuracy is not null and completeness is not null and topic_coherence is not null and citation_quality is not null)"""
)
COMPARISONS_SQL = (
    COMPLETE_SQL
    + """, gaps as (select a.question_id, a.regulator, a.judge, a.answerer as answerer_1, b.answerer as answerer_2, a.overall as overall_1,
  b.overall as overall_2, a.overall - b.overall as diff, abs(a.overall - b.overall) as abs_diff
  from complete a join complete b on a.question_id = b.question_id and a.judge = b.judge and a.answerer < b.answerer),
comparisons as (select *, case when abs_diff <= 1e-9 then 'tie' when diff > 0 then answerer_1 else answerer_2 end as preferred,
  case when abs_diff <= 1e-9 then 'tie' when abs_diff >= 1.5 then 'strong' else 'weak' end as strength from gaps)"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out by a hash of its keys where fewer tasks read it than can run: a small table in one file would keep one core busy.

    A table in many pieces stays as it is, without a shuffle.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= n else df.repartition(n, F.xxhash64(*keys))


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals both sides out by their keys.

    For texts, and tables of words made from them: Spark estimates them by the size of the compressed file, finds that small and sends the whole
    table through the driver.
    """
    return df.hint("merge")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (question, answerer, judge) with four scores of 1 to 5; citation_quality may be null."""
    i = lambda c: c.cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("question_id"), F.col("l_linestatus").alias("answerer"), F.col("l_returnflag").alias("judge"))
    return rows.agg(
        (1 + i(F.max("l_quantity")) % 5).alias("accuracy"),
        (1 + i(F.min("l_quantity")) % 5).alias("completeness"),
        (1 + i(F.round(F.max("l_discount") * 100)) % 5).alias("topic_coherence"),
        F.when(i(F.round(F.min("l_tax") * 100)) == 8, None).otherwise(1 + i(F.max("l_linenumber") + F.min("l_linenumber")) % 5).alias("citation_quality"),
    ).select("question_id", F.when(F.col("question_id") % 2 == 0, "EBA").otherwise("ESMA").alias("regulator"), "answerer", "judge", *DIMS)


def nested(rows: DataFrame) -> DataFrame:
    """The judge-record shape: answers map<answerer, struct<text, judge_scores map<judge, struct<dims>>>>."""
    inner = rows.groupBy("question_id", "regulator", "answerer").agg(F.map_from_entries(F.collect_list(F.struct("judge", F.struct(*DIMS)))).alias("judge_scores"))
    entry = F.struct("answerer", F.struct(F.concat(F.lit("answer "), "answerer").alias("text"), "judge_scores"))
    return inner.groupBy("question_id", "regulator").agg(F.map_from_entries(F.collect_list(entry)).alias("answers"))
