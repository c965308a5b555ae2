"""Splits, samples, weights and training-data shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import preferences as P
from ..operators import sampling as S
from ..registry import query
from ..sources.files import manifest
from ..sources.views import judgments, table
from .preferences import VOTES_SQL

DRAW = lambda key, seed=42: f"(({key} % 1000003) * 48271 + {seed * 7919}) % 1000003"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("stratum"))


SPLIT_SQL = f"""r as (select o_orderkey as question_id, o_orderstatus as stratum, row_number() over (partition by o_orderstatus order by {DRAW("o_orderkey")}, o_orderkey) as k, count(*) over (partition by o_orderstatus) as n from orders),
split as (select question_id, stratum, case when k <= floor(n * 0.7::double) then 'train' when k <= floor(n * (0.7::double + 0.15::double)) then 'val' else 'test' end as split from r)"""


@query(f"with {SPLIT_SQL} select * from split")
def stratified_split(spark, sf_dir):
    return S.stratified_split(_orders(spark, sf_dir), "question_id", "stratum").select("question_id", "stratum", "split")


@query(f"with {SPLIT_SQL} select count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test, sha256(string_agg(question_id::varchar, '|' order by question_id::varchar)) as split_hash from split")
def split_hash(spark, sf_dir):
    m = manifest(S.stratified_split(_orders(spark, sf_dir), "question_id", "stratum"), 42)
    return m.select("sizes.train", "sizes.val", "sizes.test", "split_hash")


@query(f"select o_orderkey as question_id from orders order by {DRAW('o_orderkey')}, o_orderkey limit 100")
def simple_sample(spark, sf_dir):
    return S.sample(_orders(spark, sf_dir).select("question_id"), "question_id", 100)


WEIGHTS = [("F", 0.5), ("O", 0.3), ("P", 0.2)]
WEIGHTS_SQL = "weights(stratum, w) as (values " + ", ".join(f"('{g}', {w}::double)" for g, w in WEIGHTS) + ")"


@query(f"""with {WEIGHTS_SQL}, r as (select o_orderkey as question_id, o_orderstatus as stratum, row_number() over (partition by o_orderstatus order by {DRAW("o_orderkey")}, o_orderkey) as k from orders),
p as (select stratum, count(*) as pool from r group by 1), t as (select sum(w) as total from p join weights using (stratum)), n as (select stratum, pool, w, greatest(1, round_even(w / total * 9000, 0))::bigint as n from p join weights using (stratum), t)
select stratum, question_id, case when n <= pool then (k <= n)::bigint else n // pool + (k <= n % pool)::int end as copies from r join n using (stratum) where case when n <= pool then k <= n else n // pool + (k <= n % pool)::int > 0 end""")
def weighted_resample(spark, sf_dir):
    rows = _orders(spark, sf_dir)
    picked = S.weighted_sample(rows, "question_id", "stratum", spark.createDataFrame(WEIGHTS, "stratum string, w double"), 9000)
    return picked.groupBy("stratum", "question_id").agg(F.count("*").alias("copies"))


@query()
def weighted_draws(spark, sf_dir):
    """The same weights, with true draws with replacement where a stratum has too few rows."""
    rows = _orders(spark, sf_dir)
    target = 3 * rows.count()
    picked = S.weighted_draws(rows, "question_id", "stratum", spark.createDataFrame(WEIGHTS, "stratum string, w double"), target)
    return picked.groupBy("stratum", "question_id").agg(F.count("*").alias("copies"))


@query(f"""with {WEIGHTS_SQL}, m as (select l_linestatus as stratum, avg(l_discount - l_tax) as margin from lineitem group by 1 union all select 'P', 0.01::double), g as (select stratum, w, margin from weights join m using (stratum)),
e as (select stratum, exp(ln(w) - 0.5 * margin) as e from g), f as (select stratum, greatest(e / sum(e) over (), 0.25::double) as f from e) select stratum, round(f / sum(f) over (), 9) as new_w from f""")
def weight_update(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("stratum")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("margin"))
    m = m.unionByName(spark.createDataFrame([("P", 0.01)], "stratum string, margin double"))
    g = spark.createDataFrame(WEIGHTS, "stratum string, w double").join(m, "stratum")
    return S.updated_weights(g, 0.5, 0.25).select("stratum", F.round("new_w", 9).alias("new_w"))


@query("select l_orderkey, l_linenumber, case when l_discount <= l_tax then 4 else 1 end * count(*) as copies from lineitem group by l_orderkey, l_linenumber, l_discount <= l_tax")
def upsample_hard(spark, sf_dir):
    """Pairs with margin 0 or less come four times in total."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") <= F.col("l_tax")).alias("hard"))
    return S.upsampled(rows, F.col("hard")).groupBy("l_orderkey", "l_linenumber", "hard").agg(F.count("*").alias("copies")).drop("hard")


@query(f"""with {VOTES_SQL}, p as (select question_id, majority_preferred as chosen, case majority_preferred when 'F' then 'O' else 'F' end as rejected from consensus where majority_preferred <> 'tie')
select question_id, chosen as completion, true as label from p union all select question_id, rejected, false from p""")
def kto_explode(spark, sf_dir):
    q = P.consensus(P.comparisons(judgments(spark, sf_dir))).where("majority_preferred <> 'tie'")
    return S.labelled(q.select("question_id", F.col("majority_preferred").alias("chosen"), F.when(F.col("majority_preferred") == "F", "O").otherwise("F").alias("rejected")))


@query("""with c as (select conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) as ids from conversations), p as (select a.conv_id, a.turn // 2 as pair, a.ids as prompt, b.ids as answer from c a join c b on a.conv_id = b.conv_id and a.turn % 2 = 0 and b.turn = a.turn + 1),
s as (select conv_id, pair, list_concat(prompt, list_concat(answer, [1::bigint])) as ids, list_concat(list_transform(prompt, lambda x: -100::bigint), list_concat(answer, [1::bigint])) as labels from p where len(prompt) < 64)
select conv_id, pair, array_to_string(list_concat(ids, list_transform(range(64), lambda x: 0::bigint))[1:64], ' ') as input_ids, array_to_string(list_concat(labels, list_transform(range(64), lambda x: -100::bigint))[1:64], ' ') as labels from s""")
def sft_mask(spark, sf_dir):
    """Prompt and answer ids of every pair of turns (word lengths stand in for a tokenizer), with masked labels, in rows of 64."""
    ids, turn = F.transform(F.split("text", " ", -1), lambda x: F.char_length(x)), F.col("turn")
    sides = [F.max(F.when(turn % 2 == t, ids)).alias(n) for t, n in ((0, "prompt"), (1, "answer"))]
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", F.floor(turn / 2).alias("pair")).agg(*sides)
    a, b = S.masked(F.col("prompt"), F.col("answer"), 1, 64)
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), " ")
    return c.where("prompt is not null and answer is not null and size(prompt) < 64").select("conv_id", "pair", text(a).alias("input_ids"), text(b).alias("labels"))


@query("""with l as (select l_returnflag as grp, l_extendedprice / 1000 as x from lineitem) select grp, count(*) as n, round(any_value(low) - 0.5 * (ln(sum(exp((low - x) / 0.5))) - ln(count(*))), 6) as loss from l join (select grp, min(x) as low from l group by 1) using (grp) group by grp""")
def dr_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), (F.col("l_extendedprice") / 1000).alias("x"))
    return S.dr_loss(rows, ["grp"], "x", 0.5).withColumn("loss", F.round("loss", 6))


@query("select l_shipyear as grp, count(*) as n, round(avg(c - r), 6) as margin from (select year(l_shipdate) as l_shipyear, l_extendedprice / 1000 as c, l_quantity as r from lineitem) group by 1")
def group_margin(spark, sf_dir):
    """Mean margin of chosen over rejected log-probabilities by group."""
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("grp"), (F.col("l_extendedprice") / 1000 - F.col("l_quantity")).alias("m"))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("margin"))


@query("""select regulator || '_' || id as question_id, regulator, id, act as legal_act, answer from (
select 'EBA' as regulator, p_partkey::varchar as id, p_brand as act, p_type as answer from part where p_partkey % 2 = 0 union all select 'ESMA', p_partkey::varchar, p_type, p_brand from part where p_partkey % 2 = 1) where length(coalesce(answer, '')) > 0""")
def source_union(spark, sf_dir):
    """Two sources with different names for the same fields, renamed, united and keyed."""
    p = table(spark, sf_dir, "part").withColumn("id", F.col("p_partkey").cast("string"))
    eba = p.where("p_partkey % 2 = 0").select("id", F.col("p_brand").alias("legal_act"), F.col("p_type").alias("final_answer"))
    esma = p.where("p_partkey % 2 = 1").select("id", F.col("p_type").alias("level1_regulation"), F.col("p_brand").alias("answer"))
    names = {"level1_regulation": "legal_act", "final_answer": "answer"}
    both = eba.withColumnsRenamed(names).withColumn("regulator", F.lit("EBA")).unionByName(esma.withColumnsRenamed(names).withColumn("regulator", F.lit("ESMA")))
    both = both.where("length(coalesce(answer, '')) > 0").withColumn("question_id", F.concat_ws("_", "regulator", "id"))
    return both.select("question_id", "regulator", "id", "legal_act", "answer")
