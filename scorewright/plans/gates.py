"""Gates, seeded samples, judge requests and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import preferences as P
from ..operators import sampling as S
from ..operators.judging import DEFAULT
from ..operators.topics import clusters
from ..registry import query
from ..sources.views import COMPLETE_SQL, DIMS, judgments, table
from .reports import EVAL_SQL, evaluations
from .training import DRAW

PAIR_SQL = "o_orderstatus || '_Art' || (o_custkey % 4)::varchar"
#: Invented judges and their budgets.
MODELS, BUDGETS = ["lab/Qwen-a", "lab/GLM-b", "lab/plain-c"], {"lab/Qwen-a": 6144, "lab/GLM-b": 8192}


@query(f"""with checked as (select o_orderpriority as zone, {PAIR_SQL} as pair, o_orderkey % 3 <> 0 as ok, 1 + o_custkey % 5 as relevance from orders)
select zone, pair, count(*) as total, count(*) filter (where ok and relevance >= 4) as passed from checked group by grouping sets ((zone), (pair))""")
def gate_counters(spark, sf_dir):
    """Checked pairs and those that pass (flag set and relevance 4 or more), by zone and by pair of rules."""
    pair = F.concat("o_orderstatus", F.lit("_Art"), (F.col("o_custkey") % 4).cast("string"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("zone"), pair.alias("pair"), (F.col("o_orderkey") % 3 != 0).alias("ok"), (1 + F.col("o_custkey") % 5).alias("relevance"))
    passed = F.col("ok") & (F.col("relevance") >= 4)
    return rows.groupingSets([["zone"], ["pair"]], "zone", "pair").agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))


@query(f"""with {COMPLETE_SQL}, b as (select question_id, judge, answerer, round_even(overall, 0)::bigint as bucket from complete),
r as (select *, row_number() over (partition by judge, answerer, bucket order by {DRAW("question_id")}, question_id) as k from b) select question_id, judge, answerer, bucket from r where k <= 5""")
def bucket_sample(spark, sf_dir):
    """Five questions, by draw, of each judge, answerer and rounded score."""
    rows = P.complete(judgments(spark, sf_dir)).select("question_id", "judge", "answerer", F.bround("overall").cast("long").alias("bucket"))
    return S.hash_ranks(rows, "question_id", ["judge", "answerer", "bucket"]).where("rank <= 5").drop("rank", "size")


@query(f"""with r as (select o_orderkey as question_id, row_number() over (order by {DRAW("o_orderkey")}, o_orderkey) as k, count(*) over () as n from orders)
select question_id, case when k <= ceil(n * 0.05::double) then 'eval' else 'train' end as split from r""")
def train_eval_split(spark, sf_dir):
    rows = S.held_out(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id")), "question_id", 0.05)
    return rows.select("question_id", "split")


@query(f"""with l as (select 'output/eval_' || folder as path, side, unnest(['accuracy','completeness','topic_coherence','citation_quality']) as dim, unnest([accuracy, completeness, topic_coherence, citation_quality]) as score
from (with {EVAL_SQL} select * from eval)), m as (select regexp_replace(regexp_extract(path, '([^/]+)/*$', 1), '^eval_', '') as folder, dim, avg(score) filter (where side = 'baseline') as b, avg(score) filter (where side = 'trained') as t from l group by 1, 2)
select folder, dim, round(b, 6) as baseline, round(t, 6) as trained, round(t - b, 6) as gain from m""")
def folder_dim_gains(spark, sf_dir):
    """Means by run folder and dimension of both sides, and their difference."""
    rows = evaluations(spark, sf_dir).withColumn("folder", N.folder_name(F.concat(F.lit("output/eval_"), "folder")))
    long = rows.unpivot(["folder", "side"], DIMS, "dim", "score")
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("score")))
    m = long.groupBy("folder", "dim").agg(side("baseline").alias("b"), side("trained").alias("t"))
    return m.select("folder", "dim", F.round("b", 6).alias("baseline"), F.round("t", 6).alias("trained"), F.round(F.col("t") - F.col("b"), 6).alias("gain"))


@query("""with c as (select conv_id, count(*) as n_messages, arg_max(text, turn) as prompt, case conv_id % 3 when 0 then 'lab/Qwen-a' when 1 then 'lab/GLM-b' else 'lab/plain-c' end as judge from conversations where role = 'user' and length(coalesce(text, '')) > 0 group by conv_id)
select conv_id, n_messages, judge, case when regexp_matches(lower(judge), 'qwen|glm') then prompt || chr(10) || chr(10) || '/no_think' else prompt end as prompt,
(case judge when 'lab/Qwen-a' then 6144 when 'lab/GLM-b' then 8192 else 3072 end)::bigint as budget from c""")
def judge_requests(spark, sf_dir):
    """The newest non-empty user message of each conversation as a request to a judge."""
    said = table(spark, sf_dir, "conversations").where("role = 'user' and length(coalesce(text, '')) > 0")
    c = said.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max_by("text", "turn").alias("prompt"))
    judge = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("conv_id") % 3 + 1).cast("int"))
    c = c.withColumn("judge", judge)
    return c.select("conv_id", "n_messages", "judge", N.request(F.col("judge"), F.col("prompt")).alias("prompt"), N.budget(F.col("judge"), BUDGETS, DEFAULT).alias("budget"))


@query()
def topic_clusters(spark, sf_dir):
    """Vectors in at most ten topics; topics under ten members dissolve."""
    return clusters(table(spark, sf_dir, "embeddings"), "embedding", 10, 10).select("vec_id", "topic", "moved")
