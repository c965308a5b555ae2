"""Preference queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preferences as P
from ..operators.sampling import ordered_ranks
from ..registry import query
from ..sources.views import COMPARISONS_SQL, DIMS, JUDGMENTS_SQL, judgments, nested

MEASURES_SQL = """count(*) as n, count(*) filter (where preferred = 'F') as "wins_F", count(*) filter (where preferred = 'O') as "wins_O",
 count(*) filter (where strength = 'tie') as ties, count(*) filter (where strength = 'strong') as n_strong, count(*) filter (where strength = 'weak') as n_weak,
 round(avg(case when strength = 'strong' then 1.0::double else 0.0::double end), 6) as strong_rate, round(avg(abs_diff), 6) as mean_abs_diff"""
VOTES_SQL = (
    COMPARISONS_SQL
    + """, votes as (select question_id, regulator, preferred, count(*) as n, min(judge) as judge, bool_and(strength = 'strong') as strong, max(abs_diff) as gap
  from comparisons group by question_id, regulator, preferred),
ranked as (select *, row_number() over (partition by question_id order by n desc, judge) as k, sum(n) over (partition by question_id) as total, max(gap) over (partition by question_id) as widest from votes),
consensus as (select question_id, regulator, cast(total as bigint) as n_judges, preferred as majority_preferred, n as majority_count, n = total as unanimous,
  n = total and preferred <> 'tie' and strong as unanimous_strong, greatest(widest, 0.0::double) as max_abs_diff from ranked where k = 1)"""
)


def _pairs(spark, sf_dir):
    return P.comparisons(judgments(spark, sf_dir))


@query(f"with {COMPARISONS_SQL} select judge, {MEASURES_SQL} from comparisons group by judge")
def pref_by_judge(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("judge").agg(*P.measures(["F", "O"]))


@query(f"with {COMPARISONS_SQL} select judge, regulator, {MEASURES_SQL} from comparisons group by grouping sets ((judge), (judge, regulator), ())")
def pref_grouping_sets(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    return rows.groupingSets([["judge"], ["judge", "regulator"], []], "judge", "regulator").agg(*P.measures(["F", "O"]))


@query(f"with {COMPARISONS_SQL} select question_id, regulator, judge, answerer_1, answerer_2, overall_1, overall_2, diff, abs_diff, preferred, strength from comparisons")
def pref_comparisons(spark, sf_dir):
    return _pairs(spark, sf_dir).select("question_id", "regulator", "judge", "answerer_1", "answerer_2", "overall_1", "overall_2", "diff", "abs_diff", "preferred", "strength")


@query(f"with {VOTES_SQL} select * from consensus")
def pref_consensus(spark, sf_dir):
    return P.consensus(_pairs(spark, sf_dir))


@query(f"""with {VOTES_SQL}, s as (select question_id, count(*) filter (where strength = 'strong') as k from comparisons where strength <> 'tie' group by question_id)
select count(*) as n_unanimous, count(*) filter (where coalesce(k, 0) = 3) as all_strong, count(*) filter (where coalesce(k, 0) >= 2) as two_strong, count(*) filter (where coalesce(k, 0) >= 1) as one_strong
from consensus left join s using (question_id) where unanimous and majority_preferred <> 'tie' and n_judges = 3""")
def pref_strong_defs(spark, sf_dir):
    """Unanimous questions under three definitions of strong: all, two or one of the judges."""
    rows = _pairs(spark, sf_dir)
    strong = rows.where("strength <> 'tie'").groupBy("question_id").agg(F.count_if(F.col("strength") == "strong").alias("k"))
    q = P.consensus(rows).where("unanimous and majority_preferred <> 'tie' and n_judges = 3").join(strong, "question_id", "left").fillna(0, ["k"])
    return q.agg(F.count("*").alias("n_unanimous"), F.count_if(F.col("k") == 3).alias("all_strong"), F.count_if(F.col("k") >= 2).alias("two_strong"), F.count_if(F.col("k") >= 1).alias("one_strong"))


@query(f"""with {VOTES_SQL} select question_id, majority_preferred as chosen, case majority_preferred when 'F' then 'O' else 'F' end as rejected, majority_count, unanimous, max_abs_diff
from consensus where majority_count >= 3 and majority_preferred <> 'tie' and max_abs_diff >= 1.5""")
def pref_pair_selection(spark, sf_dir):
    q = P.selected(P.consensus(_pairs(spark, sf_dir))).where("reason = 'selected'")
    return q.select("question_id", F.col("majority_preferred").alias("chosen"), F.when(F.col("majority_preferred") == "F", "O").otherwise("F").alias("rejected"), "majority_count", "unanimous", "max_abs_diff")


@query(f"""with {VOTES_SQL} select case when majority_count < 3 then 'no_majority' when majority_preferred = 'tie' then 'tie' when max_abs_diff < 1.5 then 'small_gap' else 'selected' end as reason,
count(*) as n from consensus group by 1""")
def skip_counters(spark, sf_dir):
    return P.selected(P.consensus(_pairs(spark, sf_dir))).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"with {JUDGMENTS_SQL} select question_id, regulator, answerer, judge, accuracy, completeness, topic_coherence, citation_quality::double as citation_quality from judgments")
def judge_long_form(spark, sf_dir):
    """Nested maps built and flattened again."""
    return P.flatten(nested(judgments(spark, sf_dir))).withColumn("citation_quality", F.col("citation_quality").cast("double"))


@query(f"""with {JUDGMENTS_SQL}, c as (select question_id, judge, count(*) as k, count(*) filter (where accuracy is null or completeness is null or topic_coherence is null or citation_quality is null) as bad from judgments group by 1, 2)
select case when k <> 2 then 'one_answerer' when bad > 0 then 'incomplete' else 'compared' end as reason, count(*) as n from c group by 1""")
def skip_reasons_by_cell(spark, sf_dir):
    """Why (question, judge) cells are or are not compared, in the order of the checks."""
    missing = F.greatest(*(F.col(d).isNull() for d in DIMS))
    cells = judgments(spark, sf_dir).groupBy("question_id", "judge").agg(F.count("*").alias("k"), F.count_if(missing).alias("bad"))
    return cells.groupBy(F.when(F.col("k") != 2, "one_answerer").when(F.col("bad") > 0, "incomplete").otherwise("compared").alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with {COMPARISONS_SQL}, r as (select preferred, strength, count(*) as n from comparisons group by 1, 2)
select preferred, sum(case when strength = 'strong' then n else 0 end)::bigint as strong, sum(case when strength = 'weak' then n else 0 end)::bigint as weak, sum(case when strength = 'tie' then n else 0 end)::bigint as tie, sum(n)::bigint as total,
round(sum(case when strength = 'strong' then n else 0 end)::double / sum(n), 6) as strong_share from r group by preferred""")
def crosstab_rates(spark, sf_dir):
    """Pivot of counts with row totals and row-normalised rates."""
    wide = _pairs(spark, sf_dir).groupBy("preferred").pivot("strength", ["strong", "weak", "tie"]).count().fillna(0)
    total = F.col("strong") + F.col("weak") + F.col("tie")
    return wide.withColumn("total", total).withColumn("strong_share", F.round(F.col("strong").cast("double") / F.col("total"), 6))


@query(f"""with {COMPARISONS_SQL} select question_id, judge, abs_diff, pick from (
select *, row_number() over (partition by judge order by abs_diff, question_id) as k, count(*) over (partition by judge) as n from comparisons) join (values (1, 'min'), (2, 'mid'), (3, 'max')) p(i, pick)
on k = case i when 1 then 1 when 2 then n // 2 + 1 else n end""")
def gap_picks(spark, sf_dir):
    """Smallest, middle and largest gap of each judge."""
    rows = ordered_ranks(_pairs(spark, sf_dir), "question_id", ["judge"], "abs_diff").withColumnsRenamed({"rank": "k", "size": "n"})
    at = F.explode(F.array(F.struct(F.lit("min").alias("pick"), F.lit(1).cast("long").alias("i")), F.struct(F.lit("mid").alias("pick"), F.expr("n div 2 + 1").alias("i")), F.struct(F.lit("max").alias("pick"), F.col("n").alias("i"))))
    return rows.select("question_id", "judge", "abs_diff", "k", at.alias("p")).where("k = p.i").select("question_id", "judge", "abs_diff", "p.pick")


@query(f"""with {COMPARISONS_SQL} select judge, cast(least(floor(abs_diff / 0.25), 15) as int) as bin, count(*) as n from comparisons group by 1, 2""")
def histogram_bins(spark, sf_dir):
    """Gap histogram with edges 0 to 4 by 0.25; the last bin is closed on the right."""
    b = F.least(F.floor(F.col("abs_diff") / 0.25), F.lit(15)).cast("int").alias("bin")
    return _pairs(spark, sf_dir).groupBy("judge", b).agg(F.count("*").alias("n"))


@query(f"""with {COMPARISONS_SQL} select regulator, round(avg(case when abs_diff >= 0.75 then 100.0::double else 0.0::double end), 6) as pct_above, round(min(abs_diff), 4) as least, round(avg(abs_diff), 4) as mean, round(max(abs_diff), 4) as most, count(*) as n
from comparisons group by regulator""")
def gap_summary(spark, sf_dir):
    x = F.col("abs_diff")
    return _pairs(spark, sf_dir).groupBy("regulator").agg(F.round(F.avg((x >= 0.75).cast("double") * 100), 6).alias("pct_above"), F.round(F.min(x), 4).alias("least"), F.round(F.avg(x), 4).alias("mean"), F.round(F.max(x), 4).alias("most"), F.count("*").alias("n"))


@query(f"""with {JUDGMENTS_SQL}, g as (select question_id, judge, unnest(['accuracy','completeness','topic_coherence','citation_quality']) as dim,
 unnest([max(accuracy)-min(accuracy), max(completeness)-min(completeness), max(topic_coherence)-min(topic_coherence), max(citation_quality)-min(citation_quality)]) as gap
 from (select * from judgments where citation_quality is not null) group by question_id, judge having count(*) = 2)
select dim, round(avg(gap), 6) as mean_gap, quantile_cont(gap, 0.5)::double as median_gap, round(stddev_samp(gap), 6) as std_gap, count(*) as n from g group by dim""")
def dim_gap_unpivot(spark, sf_dir):
    """Gap between the two answerers for each dimension: wide to long, then mean, median, deviation."""
    gaps = judgments(spark, sf_dir).dropna(subset=DIMS).groupBy("question_id", "judge").agg(*(F.abs(F.max(d) - F.min(d)).alias(d) for d in DIMS), F.count("*").alias("n")).where("n = 2")
    long = gaps.unpivot(["question_id"], DIMS, "dim", "gap")
    return long.groupBy("dim").agg(F.round(F.avg("gap"), 6).alias("mean_gap"), F.percentile("gap", F.lit(0.5)).alias("median_gap"), F.round(F.stddev_samp("gap"), 6).alias("std_gap"), F.count("*").alias("n"))
