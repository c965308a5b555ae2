"""Evaluation reports of trained against baseline answers, resumable runs and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bootstrap import exact_bootstrap
from ..operators.reports import MIX, POISSON, WORD, bootstrap, canonical, mean_present, pending, upsert
from ..registry import query
from ..sources.views import DIMS, JUDGMENTS_SQL, judgments

#: Answerer F is the baseline, O the trained model; folders are residues of the question id; raw judge names have two spellings.
EVAL_SQL = (
    JUDGMENTS_SQL
    + """, eval as (select 'run' || cast(question_id % 4 as varchar) as folder, question_id, case answerer when 'F' then 'baseline' else 'trained' end as side,
  case when question_id % 3 = 0 then 'org/' || judge else judge end as alias, judge, accuracy, completeness, topic_coherence, citation_quality from judgments),
per_judge as (select *, (accuracy + completeness + topic_coherence + coalesce(citation_quality, 0))::double / (3 + (citation_quality is not null)::int) as score from eval),
overall as (select folder, question_id, side, avg(score) as overall from per_judge group by 1, 2, 3),
sides as (select folder, question_id, max(case when side = 'baseline' then overall end) as baseline, max(case when side = 'trained' then overall end) as trained from overall group by 1, 2)"""
)


def evaluations(spark, sf_dir):
    j = judgments(spark, sf_dir)
    return j.select(
        F.concat(F.lit("run"), (F.col("question_id") % 4).cast("string")).alias("folder"), "question_id", F.when(F.col("answerer") == "F", "baseline").otherwise("trained").alias("side"),
        F.when(F.col("question_id") % 3 == 0, F.concat(F.lit("org/"), "judge")).otherwise(F.col("judge")).alias("alias"), *DIMS,
    )


def _sides(spark, sf_dir):
    rows = evaluations(spark, sf_dir).withColumn("score", mean_present(DIMS))
    overall = rows.groupBy("folder", "question_id", "side").agg(F.avg("score").alias("overall"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("overall"))).alias(s)
    return overall.groupBy("folder", "question_id").agg(side("baseline"), side("trained"))


@query(f"with {EVAL_SQL} select folder, question_id, round(baseline, 9) as baseline, round(trained, 9) as trained from sides")
def overall_by_side(spark, sf_dir):
    """Two-level mean: dimensions that are present, then judges."""
    return _sides(spark, sf_dir).select("folder", "question_id", F.round("baseline", 9).alias("baseline"), F.round("trained", 9).alias("trained"))


def _win_sql(eps: str) -> str:
    return f"""with {EVAL_SQL}, d as (select folder, trained - baseline as gap from sides where trained is not null and baseline is not null)
select folder, count(*) as n, round(avg(case when gap >= {eps} then 1.0::double else 0.0::double end), 6) as trained, round(avg(case when gap <= -{eps} then 1.0::double else 0.0::double end), 6) as baseline,
round(avg(case when abs(gap) < {eps} then 1.0::double else 0.0::double end), 6) as tie from d group by folder"""


def _wins(spark, sf_dir, eps):
    gap = F.col("trained") - F.col("baseline")
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    rows = _sides(spark, sf_dir).withColumn("gap", gap).where("gap is not null")
    g = F.col("gap")
    return rows.groupBy("folder").agg(F.count("*").alias("n"), rate(g >= eps).alias("trained"), rate(g <= -eps).alias("baseline"), rate(F.abs(g) < eps).alias("tie"))


@query(_win_sql("0.05::double"))
def win_rates_eval(spark, sf_dir):
    return _wins(spark, sf_dir, 0.05)


@query(_win_sql("1e-9::double"))
def win_rates_unified(spark, sf_dir):
    return _wins(spark, sf_dir, 1e-9)


@query(f"""with {EVAL_SQL}, l as (select folder, side, unnest(['accuracy','completeness','topic_coherence','citation_quality']) as dim, unnest([accuracy, completeness, topic_coherence, citation_quality]) as s from eval),
m as (select folder, side, dim, avg(s) as mean, sum(s) as total, count(s) as n from l group by 1, 2, 3)
select folder, side, round(sum(total)::double / sum(n), 6) as overall_pooled, round(avg(mean), 6) as overall_macro from m group by 1, 2""")
def overall_rollups(spark, sf_dir):
    """Two roll-ups of the dimensions: pooled over scores, and the mean of dimension means."""
    m = evaluations(spark, sf_dir).unpivot(["folder", "side"], DIMS, "dim", "s").groupBy("folder", "side", "dim").agg(F.avg("s").alias("mean"), F.sum("s").alias("total"), F.count("s").alias("n"))
    return m.groupBy("folder", "side").agg(F.round(F.sum("total").cast("double") / F.sum("n"), 6).alias("overall_pooled"), F.round(F.avg("mean"), 6).alias("overall_macro"))


@query(f"""with {EVAL_SQL}, a as (select folder, question_id, side, alias, accuracy as s, case when alias like 'org/%' then substr(alias, 5) else alias end as judge from eval
 union all select folder, question_id, side, 'org/' || judge, completeness, judge from eval where question_id % 3 <> 0),
last as (select folder, side, question_id, judge, arg_max(s, alias) as s from a group by 1, 2, 3, 4)
select a.folder, a.side, a.judge, cast(sum(a.s) as bigint) as total, count(*) as n_raw, any_value(l.mean) as last_mean from a
join (select folder, side, judge, round(avg(s), 6) as mean from last group by 1, 2, 3) l using (folder, side, judge) group by 1, 2, 3""")
def alias_rollup(spark, sf_dir):
    """Sums count every spelling of a judge; the mean keeps the last spelling of each."""
    e = evaluations(spark, sf_dir)
    rows = e.select("folder", "question_id", "side", "alias", F.col("accuracy").alias("s"))
    rows = rows.unionByName(e.where("question_id % 3 <> 0").select("folder", "question_id", "side", F.concat(F.lit("org/"), "alias").alias("alias"), F.col("completeness").alias("s")))
    rows = rows.withColumn("judge", canonical("alias", {f"org/{j}": j for j in "ANR"}))
    last = rows.groupBy("folder", "side", "question_id", "judge").agg(F.max_by("s", "alias").alias("s"), F.sum("s").alias("total"), F.count("*").alias("n"))
    return last.groupBy("folder", "side", "judge").agg(F.sum("total").alias("total"), F.sum("n").alias("n_raw"), F.round(F.avg("s"), 6).alias("last_mean"))


@query(f"""with {EVAL_SQL} select folder, bool_or(judge = 'A' and accuracy >= 4) as a, bool_or(judge = 'N' and accuracy >= 4) as n, bool_or(judge = 'R' and accuracy >= 4) as r, array_to_string(list_sort(list(distinct judge)), ',') as judges from eval group by folder""")
def judge_presence(spark, sf_dir):
    """Which judges occur in each folder, as a matrix and as a sorted list."""
    rows = evaluations(spark, sf_dir).withColumn("judge", canonical("alias", {f"org/{j}": j for j in "ANR"}))
    wide = [F.bool_or((F.col("judge") == j) & (F.col("accuracy") >= 4)).alias(j.lower()) for j in "ANR"]
    return rows.groupBy("folder").agg(*wide, F.array_join(F.array_sort(F.collect_set("judge")), ",").alias("judges"))


@query(f"with {EVAL_SQL} select e.question_id, e.side, e.judge from eval e anti join (select question_id, side, judge from eval where question_id % 5 = 0 and accuracy is not null) d using (question_id, side, judge)")
def resume_antijoin(spark, sf_dir):
    """Work left at the grain (question, side, judge)."""
    rows = evaluations(spark, sf_dir).select("question_id", "side", canonical("alias", {f"org/{j}": j for j in "ANR"}).alias("judge"), "accuracy")
    return pending(rows.drop("accuracy"), rows.where("question_id % 5 = 0 and accuracy is not null"), ["question_id", "side", "judge"])


@query("select p_partkey as question_id from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)")
def holdout_antijoin(spark, sf_dir):
    """Questions that no training pair was made of."""
    used = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 49").select(F.col("l_partkey").alias("question_id"))
    return pending(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("question_id")), used, ["question_id"])


@query(f"""with {JUDGMENTS_SQL}, fresh as (select question_id, answerer, judge, 5 as citation_quality from judgments where citation_quality is null)
select question_id, answerer, judge, accuracy, coalesce(f.citation_quality, j.citation_quality) as citation_quality, f.question_id is not null as redone from judgments j left join fresh f using (question_id, answerer, judge)""")
def rejudge_upsert(spark, sf_dir):
    """Incomplete judgments are judged again and replace the old rows."""
    old = judgments(spark, sf_dir).select("question_id", "answerer", "judge", "accuracy", "citation_quality")
    fresh = old.where("citation_quality is null").withColumn("citation_quality", F.lit(5))
    return upsert(old, fresh, ["question_id", "answerer", "judge"], ["accuracy", "citation_quality"])


RESAMPLES = 10_000


def _mixed_sql(x: str) -> tuple[str, str, str]:
    """Three steps of `mixed`, each on the column of the one before."""
    step = lambda c: f"(xor({c}, {c} >> 16) * {MIX}) & {WORD}"
    return step(x), step("x"), "xor(x, x >> 16)"


def _mix_sql(source: str, keep: str, x: str) -> str:
    a, b, c = _mixed_sql("x")
    return f"(select {keep}, {c} as x from (select {keep}, {b} as x from (select {keep}, {a} as x from (select {keep}, {x} as x from {source}))))"


@query(f"""with {EVAL_SQL}, d as (select folder, question_id, trained - baseline as d from sides where trained is not null and baseline is not null),
k as (select * from {_mix_sql("d", "folder, d", f"question_id & {WORD}")}), r as (select b, x as y from {_mix_sql(f"range({RESAMPLES}) t(b)", "b", "b + 1")}),
draw as (select folder, b, d, {" + ".join(f"(x >= {t})::int" for t in POISSON)} as w from {_mix_sql("(select folder, d, x as k, b, y from k, r)", "folder, d, b", "xor(k, y)")}),
means as (select folder, b, round(sum(w * d) / sum(w), 9) as m from draw group by 1, 2 having sum(w) > 0),
point as (select folder, avg(d) as point, count(*) as n from d group by 1),
ci as (select folder, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi, avg(case when m <= 0 then 1.0::double else 0.0::double end) as below from means group by 1)
select folder, n, round(point, 6) as point, round(lo, 6) as lo, round(hi, 6) as hi, round(least(1.0::double, 2 * least(below, 1 - below)), 6) as p, lo > 0 or hi < 0 as significant from point join ci using (folder)""")
def boot_ci(spark, sf_dir):
    """Paired bootstrap intervals of the trained side's gain by folder, 10,000 resamples; draws are hashes that both engines have."""
    rows = _sides(spark, sf_dir).select("folder", "question_id", (F.col("trained") - F.col("baseline")).alias("delta"))
    return bootstrap(rows, "folder", "question_id", "delta", RESAMPLES)


@query()
def boot_exact_ci(spark, sf_dir):
    """The same intervals from resamples of exactly n places each."""
    rows = _sides(spark, sf_dir).select("folder", "question_id", (F.col("trained") - F.col("baseline")).alias("delta"))
    return exact_bootstrap(rows, "folder", "question_id", "delta", RESAMPLES)


@query(f"""with {EVAL_SQL}, b as (select question_id + 1 as question_id, trained as base from sides where folder = 'run0')
select folder, s.question_id, round(trained - base, 9) as delta from sides s join b using (question_id) where trained is not null and base is not null""")
def rebased_delta(spark, sf_dir):
    """Deltas against another run's trained side instead of the own baseline."""
    rows = _sides(spark, sf_dir)
    base = rows.where("folder = 'run0'").select((F.col("question_id") + 1).alias("question_id"), F.col("trained").alias("base"))
    return rows.join(base, "question_id").select("folder", "question_id", F.round(F.col("trained") - F.col("base"), 9).alias("delta")).where("delta is not null")


@query(f"""with {JUDGMENTS_SQL}, s as (select question_id, judge, avg(accuracy) as x from judgments where judge in ('A', 'N') group by 1, 2)
select question_id, round(a.x, 6) as x_small, round(b.x, 6) as x_big from (select * from s where judge = 'A') a full join (select * from s where judge = 'N') b using (question_id)""")
def outer_alignment(spark, sf_dir):
    """Two judges' means side by side, one of them possibly missing."""
    side = lambda j, n: judgments(spark, sf_dir).where(F.col("judge") == j).groupBy("question_id").agg(F.round(F.avg("accuracy"), 6).alias(n))
    return side("A", "x_small").join(side("N", "x_big"), "question_id", "full")


