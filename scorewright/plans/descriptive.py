"""Descriptive statistics, agreement and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import correlation_p
from ..operators import agreement as A
from ..operators import preferences as P
from ..operators.sampling import ordered_ranks
from ..registry import query
from ..sources.views import COMPLETE_SQL, DIMS, JUDGMENTS_SQL, judgments

LONG_SQL = f"""{JUDGMENTS_SQL}, long as (select question_id, regulator, answerer, judge, unnest(['accuracy','completeness','topic_coherence','citation_quality']) as dim,
 unnest([accuracy, completeness, topic_coherence, citation_quality]) as score from judgments)"""


def _long(spark, sf_dir):
    return judgments(spark, sf_dir).unpivot(["question_id", "regulator", "answerer", "judge"], DIMS, "dim", "score")


@query(f"with {LONG_SQL} select judge, dim, round(avg(case when score is null then 100.0::double else 0.0::double end), 6) as pct_missing, count(*) as n from long group by judge, dim")
def judge_missingness(spark, sf_dir):
    return _long(spark, sf_dir).groupBy("judge", "dim").agg(F.round(F.avg(F.col("score").isNull().cast("double") * 100), 6).alias("pct_missing"), F.count("*").alias("n"))


@query(f"""with {JUDGMENTS_SQL}, k as (select judge, answerer, (accuracy is null)::int + (completeness is null)::int + (topic_coherence is null)::int + (citation_quality is null)::int as n_null from judgments)
select judge, count(*) filter (where answerer = 'F' and n_null = 4) as full_f, count(*) filter (where answerer = 'O' and n_null = 4) as full_o,
 count(*) filter (where n_null between 1 and 3) as partly, count(*) as n from k group by judge""")
def judge_null_pivot(spark, sf_dir):
    """Rows without any score by answerer, and rows with some."""
    n = sum((F.col(d).isNull().cast("int") for d in DIMS[1:]), F.col(DIMS[0]).isNull().cast("int"))
    rows = judgments(spark, sf_dir).withColumn("k", n)
    full = lambda a: F.count_if((F.col("answerer") == a) & (F.col("k") == 4))
    return rows.groupBy("judge").agg(full("F").alias("full_f"), full("O").alias("full_o"), F.count_if(F.col("k").between(1, 3)).alias("partly"), F.count("*").alias("n"))


@query(f"with {LONG_SQL} select answerer, regulator, dim, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, count(score) as n from long group by 1, 2, 3")
def judge_score_stats(spark, sf_dir):
    return _long(spark, sf_dir).groupBy("answerer", "regulator", "dim").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("std"), F.count("score").alias("n"))


@query(f"""with {LONG_SQL} select dim, count(score) as n, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as std, min(score) as least, quantile_cont(score, 0.25)::double as q1,
quantile_cont(score, 0.5)::double as median, quantile_cont(score, 0.75)::double as q3, max(score) as most from long group by dim""")
def judge_quartiles(spark, sf_dir):
    """describe() with exact, linearly interpolated quartiles."""
    q = lambda p: F.percentile("score", F.lit(p))
    return _long(spark, sf_dir).groupBy("dim").agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score"), 6).alias("std"), F.min("score").alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max("score").alias("most"))


SPREAD_SQL = f"{COMPLETE_SQL}, spread as (select question_id, answerer, avg(overall) as mean, max(overall) - min(overall) as spread, count(*) as n from complete group by 1, 2 having count(*) = 3)"


def _spread(spark, sf_dir):
    x = F.col("overall")
    return P.complete(judgments(spark, sf_dir)).groupBy("question_id", "answerer").agg(F.avg(x).alias("mean"), (F.max(x) - F.min(x)).alias("spread"), F.count("*").alias("n")).where("n = 3")


@query(f"with {SPREAD_SQL} select question_id, answerer, round(mean, 6) as mean, spread from spread order by spread desc, question_id, answerer limit 20")
def judge_spread_topk(spark, sf_dir):
    """The report's twenty answers on which a full panel disagrees most."""
    return _spread(spark, sf_dir).orderBy(F.desc("spread"), "question_id", "answerer").limit(20).select("question_id", "answerer", F.round("mean", 6).alias("mean"), "spread")


@query(f"with {SPREAD_SQL} select question_id, answerer, spread, row_number() over (partition by answerer order by spread desc, question_id) as rank from spread")
def judge_spread_rank(spark, sf_dir):
    return ordered_ranks(_spread(spark, sf_dir), "question_id", ["answerer"], "spread", descending=True).select("question_id", "answerer", "spread", "rank")


@query(f"""with {COMPLETE_SQL} select p_brand as topic, round(avg(overall), 6) as mean, count(*) as n from complete join part on p_partkey = question_id group by p_brand having count(*) >= 5
order by mean desc, topic limit 10""")
def group_top_support(spark, sf_dir):
    """Best topics by mean score among those with enough judgments."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("topic"))
    rows = P.complete(judgments(spark, sf_dir)).join(parts, "question_id").groupBy("topic").agg(F.round(F.avg("overall"), 6).alias("mean"), F.count("*").alias("n"))
    return rows.where("n >= 5").orderBy(F.desc("mean"), "topic").limit(10)


@query("select o_orderpriority as value, count(*) as n from orders where o_orderpriority is not null group by 1")
def value_counts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority is not null").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query(f"with {JUDGMENTS_SQL} select regulator, count(distinct question_id) as n_questions, array_to_string(list_sort(list(distinct judge)), ',') as judges from judgments group by regulator")
def distinct_entities(spark, sf_dir):
    return judgments(spark, sf_dir).groupBy("regulator").agg(F.count_distinct("question_id").alias("n_questions"), F.array_join(F.array_sort(F.collect_set("judge")), ",").alias("judges"))


@query(f"""with {JUDGMENTS_SQL} select judge, answerer, count(*) as n, count(accuracy + completeness + topic_coherence + citation_quality) as n_valid,
round(avg(cast(accuracy + completeness + topic_coherence + citation_quality as double) / 4), 6) as mean,
round(100.0::double * (count(*) - count(accuracy + completeness + topic_coherence + citation_quality)) / count(*), 6) as pct_missing from judgments group by judge, answerer""")
def judge_valid_summary(spark, sf_dir):
    x = sum((F.col(d) for d in DIMS[1:]), F.col(DIMS[0])).cast("double") / 4
    rows = judgments(spark, sf_dir).withColumn("x", x).groupBy("judge", "answerer")
    return rows.agg(F.count("*").alias("n"), F.count("x").alias("n_valid"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.lit(100.0) * (F.count("*") - F.count("x")) / F.count("*"), 6).alias("pct_missing"))


@query(f"""with {COMPLETE_SQL} select regulator, round(avg(overall), 6) as mean, quantile_cont(overall, 0.5) as median, count(*) as n from complete group by regulator""")
def mean_median(spark, sf_dir):
    return P.complete(judgments(spark, sf_dir)).groupBy("regulator").agg(F.round(F.avg("overall"), 6).alias("mean"), F.percentile("overall", F.lit(0.5)).alias("median"), F.count("*").alias("n"))


@query(f"""with {COMPLETE_SQL}, d as (select cast(round_even(overall, 0) as int) as score, count(*) as n from complete group by 1)
select score, n, (select max(n) > 2 * min(n) from d) as imbalanced from d""")
def score_distribution(spark, sf_dir):
    """Counts by rounded score, and whether the largest is over twice the smallest."""
    d = P.complete(judgments(spark, sf_dir)).groupBy(F.bround("overall", 0).cast("int").alias("score")).agg(F.count("*").alias("n"))
    return d.crossJoin(d.agg((F.max("n") > 2 * F.min("n")).alias("imbalanced")))  # one row of flags beside five of counts


@query(f"""with {COMPLETE_SQL}, r as (select question_id, answerer, judge, cast(least(greatest(round_even(overall, 0), 1), 5) as int) as s from complete),
m as (select a.s as a, b.s as b, count(*) as n from r a join r b using (question_id, answerer) where a.judge = 'A' and b.judge = 'N' group by 1, 2), g as (select unnest(range(1, 6))::int as s)
select s as score_a, coalesce((select n from m where a = s and b = 1), 0) as b1, coalesce((select n from m where a = s and b = 2), 0) as b2, coalesce((select n from m where a = s and b = 3), 0) as b3,
coalesce((select n from m where a = s and b = 4), 0) as b4, coalesce((select n from m where a = s and b = 5), 0) as b5 from g""")
def confusion_matrix(spark, sf_dir):
    """Rounded scores of two judges, 5 x 5, empty cells 0."""
    rows = P.complete(judgments(spark, sf_dir)).withColumn("s", F.greatest(F.least(F.bround("overall", 0), F.lit(5)), F.lit(1)).cast("int"))
    pairs = A.rater_pairs(rows.where("judge in ('A', 'N')"), ["question_id", "answerer"], "judge", "s")
    spine = spark.range(1, 6).select(F.col("id").cast("int").alias("score_a"))
    wide = pairs.groupBy(F.col("a").alias("score_a")).pivot("b", [1, 2, 3, 4, 5]).count()
    return spine.join(wide, "score_a", "left").fillna(0).toDF("score_a", "b1", "b2", "b3", "b4", "b5")


def _kappa_sql(power: int) -> str:
    return f"""with {LONG_SQL}, p as (select a.judge as rater_1, b.judge as rater_2, a.dim, a.score as a, b.score as b from long a join long b using (question_id, answerer, dim) where a.judge < b.judge and a.score is not null and b.score is not null),
g as (select rater_1, rater_2, dim, count(*) as n, sum(pow(abs(a - b), {power})) as seen from p group by 1, 2, 3),
ra as (select rater_1, rater_2, dim, a, count(*) as na from p group by 1, 2, 3, 4), rb as (select rater_1, rater_2, dim, b, count(*) as nb from p group by 1, 2, 3, 4),
e as (select rater_1, rater_2, dim, sum(pow(abs(a - b), {power}) * na * nb) as x from ra join rb using (rater_1, rater_2, dim) group by 1, 2, 3)
select rater_1, rater_2, dim, n, round(1 - seen / (x / n), 6) as kappa from g join e using (rater_1, rater_2, dim)"""


def _dim_pairs(spark, sf_dir):
    return A.rater_pairs(_long(spark, sf_dir), ["question_id", "answerer", "dim"], "judge", "score")


@query(_kappa_sql(1))
def kappa_linear(spark, sf_dir):
    return A.kappa(_dim_pairs(spark, sf_dir), ["rater_1", "rater_2", "dim"], 1).withColumn("kappa", F.round("kappa", 6))


@query(_kappa_sql(2))
def kappa_quadratic(spark, sf_dir):
    return A.kappa(_dim_pairs(spark, sf_dir), ["rater_1", "rater_2", "dim"], 2).withColumn("kappa", F.round("kappa", 6))


@query(f"""with {LONG_SQL}, p as (select a.judge as rater_1, b.judge as rater_2, a.dim, a.score::double as a, b.score::double as b from long a join long b using (question_id, answerer, dim) where a.judge < b.judge and a.score is not null and b.score is not null),
g as (select rater_1, rater_2, dim, 2.0::double * count(*) as n, avg((a - b) * (a - b)) as seen, sum(a + b) as s, sum(a * a + b * b) as q from p group by 1, 2, 3)
select rater_1, rater_2, dim, round(1 - seen / ((2 * n * q - 2 * s * s) / (n * (n - 1))), 6) as alpha from g""")
def kripp_alpha(spark, sf_dir):
    return _dim_pairs(spark, sf_dir).groupBy("rater_1", "rater_2", "dim").agg(F.round(A.krippendorff(F.col("a"), F.col("b")), 6).alias("alpha"))


@query(f"""with {JUDGMENTS_SQL} select judge, round(corr(accuracy, completeness), 6) as accuracy_completeness, round(corr(accuracy, topic_coherence), 6) as accuracy_topic_coherence,
round(corr(accuracy, citation_quality), 6) as accuracy_citation_quality, round(corr(completeness, topic_coherence), 6) as completeness_topic_coherence,
round(corr(completeness, citation_quality), 6) as completeness_citation_quality, round(corr(topic_coherence, citation_quality), 6) as topic_coherence_citation_quality from judgments group by judge""")
def dim_corr_matrix(spark, sf_dir):
    """Upper triangle of the dimensions' correlation matrix, one aggregate."""
    pairs = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[i + 1 :]]
    return judgments(spark, sf_dir).groupBy("judge").agg(*(F.round(A.pearson(a, b), 6).alias(f"{a}_{b}") for a, b in pairs))


@query(f"with {COMPLETE_SQL} select regulator, answerer, count(*) as n, round(corr(accuracy, overall), 6) as r from complete group by 1, 2")
def pearson_by_group(spark, sf_dir):
    return P.complete(judgments(spark, sf_dir)).groupBy("regulator", "answerer").agg(F.count("*").alias("n"), F.round(A.pearson("accuracy", "overall"), 6).alias("r"))


@query(f"""with {COMPLETE_SQL}, r as (select judge, rank() over (partition by judge order by accuracy) + (count(*) over (partition by judge, accuracy) - 1) / 2.0::double as x,
rank() over (partition by judge order by overall) + (count(*) over (partition by judge, overall) - 1) / 2.0::double as y from complete) select judge, count(*) as n, round(corr(x, y), 6) as rho from r group by judge""")
def spearman_by_judge(spark, sf_dir):
    return A.spearman(P.complete(judgments(spark, sf_dir)), ["judge"], "accuracy", "overall").withColumn("rho", F.round("rho", 6))


@query()
def correlation_p_values(spark, sf_dir):
    """r, rho and their two-sided p-values by judge (p-values in Python, on three aggregated rows)."""
    rows = P.complete(judgments(spark, sf_dir))
    r = rows.groupBy("judge").agg(F.count("*").alias("n"), A.pearson("accuracy", "overall").alias("r"))
    both = r.join(A.spearman(rows, ["judge"], "accuracy", "overall").drop("n"), "judge")
    p = F.udf(lambda x, n: correlation_p(x, n), "double")
    return both.select("judge", "n", "r", p("r", "n").alias("p"), "rho", p("rho", "n").alias("rho_p"))


@query(f"""with {JUDGMENTS_SQL}, s as (select question_id, answerer, judge, accuracy from judgments)
select question_id, answerer, max(case when judge = 'A' then accuracy end)::double as a, max(case when judge = 'N' then accuracy end)::double as n, max(case when judge = 'R' then accuracy end)::double as r from s group by 1, 2""")
def judge_pivot(spark, sf_dir):
    """One row per answer, a column per judge."""
    return judgments(spark, sf_dir).groupBy("question_id", "answerer").pivot("judge", ["A", "N", "R"]).agg(F.avg("accuracy")).toDF("question_id", "answerer", "a", "n", "r")
