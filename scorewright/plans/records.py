"""Queries on records: blacklists, stubs, coercion, merges, orders, pairs with texts, weights over epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import preferences as P
from ..operators import records as R
from ..operators import sampling as S
from ..registry import query
from ..sources.views import COMPLETE_SQL, DIMS, JUDGMENTS_SQL, judgments, table
from .descriptive import SPREAD_SQL, _spread
from .reports import EVAL_SQL, evaluations
from .texts import REGULATION
from .training import WEIGHTS, WEIGHTS_SQL
from .vectors import CENTROID_SQL, _nearest

QUESTION_SQL = "'ESMA_ESMA_QA_' || question_id"


@query(f"""with {JUDGMENTS_SQL}, q as (select *, {QUESTION_SQL} in ('ESMA_ESMA_QA_1580', 'ESMA_ESMA_QA_1589', 'ESMA_ESMA_QA_1668', 'ESMA_ESMA_QA_1569') as gone from judgments)
select judge, count(distinct question_id) filter (where gone) as skipped_questions, count(*) filter (where gone) as skipped_judgments, count(*) filter (where not gone) as kept, round(avg(accuracy) filter (where not gone), 6) as accuracy from q group by judge""")
def blacklist_filter(spark, sf_dir):
    """Judgments without those of deleted questions, and how many were skipped."""
    rows = judgments(spark, sf_dir).withColumn("gone", R.blacklisted(F.concat(F.lit("ESMA_ESMA_QA_"), "question_id")))
    kept = ~F.col("gone")
    return rows.groupBy("judge").agg(
        F.count_distinct(F.when(F.col("gone"), F.col("question_id"))).alias("skipped_questions"), F.count_if(F.col("gone")).alias("skipped_judgments"),
        F.count_if(kept).alias("kept"), F.round(F.avg(F.when(kept, F.col("accuracy"))), 6).alias("accuracy"),
    )


TRUTH_SQL = "case when conv_id % 5 = 0 then chr(10) || '  This question was deleted on ' || conv_id when conv_id % 7 = 0 then null when conv_id % 11 = 0 then 'No. ' || 'This question was deleted' else text end"


@query(f"select conv_id, turn, coalesce(regexp_matches(regexp_replace({TRUTH_SQL}, '^\\s+', ''), '^This question was deleted'), false) as deleted from conversations")
def deleted_stubs(spark, sf_dir):
    """Reference answers that only say that the question was deleted."""
    c = F.col("conv_id")
    truth = F.when(c % 5 == 0, F.concat(F.lit("\n  This question was deleted on "), c)).when(c % 7 == 0, None).when(c % 11 == 0, "No. This question was deleted").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.stub(truth).alias("deleted"))


@query("""select coalesce(v, 'original') as variant, count(*) as n from (select case when event_id % 4 = 0 then null else event_type end as v from events) where coalesce(v, 'original') in ('original', 'click', 'purchase') group by 1""")
def variant_filter(spark, sf_dir):
    """Pairs of the wanted corruption variants; one without a variant is an original."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("v"))
    kept = rows.where(R.one_of(F.col("v"), ["original", "click", "purchase"], "original"))
    return kept.groupBy(F.coalesce("v", F.lit("original")).alias("variant")).agg(F.count("*").alias("n"))


@query("""select p_partkey as id, try_cast(case p_partkey % 7 when 0 then '' when 1 then 'n/a' when 2 then p_size::varchar when 3 then ' ' || p_size || '.5 ' when 4 then '1e' || (p_size % 4) when 5 then '-' || p_size else p_size || 'd' end as double) as score from part""")
def numeric_coercion(spark, sf_dir):
    """Text to numbers; what is none becomes null."""
    k, s = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    text = F.when(k == 0, "").when(k == 1, "n/a").when(k == 2, s).when(k == 3, F.concat(F.lit(" "), s, F.lit(".5 "))).when(k == 4, F.concat(F.lit("1e"), (F.col("p_size") % 4).cast("string"))).when(k == 5, F.concat(F.lit("-"), s)).otherwise(F.concat(s, F.lit("d")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), R.number(text).alias("score"))


@query(f"""with {JUDGMENTS_SQL}, {CENTROID_SQL}, once as (select vec_id as question_id, 'F' as answerer, own_similarity as s from near union all select vec_id, 'O', best_other from near)
select question_id, answerer, judge, accuracy, round(s, 6) as similarity from judgments left join once using (question_id, answerer)""")
def similarity_back(spark, sf_dir):
    """A similarity computed once for each (question, answerer), attached to all judges' rows."""
    near = _nearest(spark, sf_dir)
    side = lambda a, c: near.select(F.col("vec_id").alias("question_id"), F.lit(a).alias("answerer"), F.round(c, 6).alias("similarity"))
    once = side("F", "own_similarity").unionByName(side("O", "best_other"))
    return R.attached(judgments(spark, sf_dir).select("question_id", "answerer", "judge", "accuracy"), once, ["question_id", "answerer"])


@query("""with entries as (select o_orderkey + o_orderkey % 2 as pair_id, o_custkey as relevance from orders where o_orderkey % 3 <> 0) select e.pair_id, e.relevance, o.o_orderpriority as zone, o.o_totalprice as price from entries e left join orders o on o.o_orderkey = e.pair_id""")
def passed_merge(spark, sf_dir):
    """Validated entries that passed, with the full rows of their pairs."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    entries = orders.select((k + k % 2).alias("pair_id"), F.col("o_custkey").alias("relevance"), F.when(k % 3 != 0, "PASS").otherwise("FAIL").alias("final_status"))
    return R.merged(entries, orders.select(k.alias("pair_id"), F.col("o_orderpriority").alias("zone"), F.col("o_totalprice").alias("price")), "pair_id")


@query(f"""with {SPREAD_SQL}, top as (select question_id, answerer from spread order by spread desc, question_id, answerer limit 5) select question_id, answerer, judge, overall from complete join top using (question_id, answerer)""")
def disagreement_rows(spark, sf_dir):
    """All judgments of the five answers on which judges disagree most."""
    rows = P.complete(judgments(spark, sf_dir)).select("question_id", "answerer", "judge", "overall")
    return R.rows_of_top(rows, _spread(spark, sf_dir), ["question_id", "answerer"], [F.desc("spread"), F.col("question_id"), F.col("answerer")], 5)


ORDER = ["citation_quality", "accuracy", "clarity", "topic_coherence", "completeness"]


@query(f"""with {JUDGMENTS_SQL}, l as (select unnest(['accuracy','completeness','topic_coherence','citation_quality']) as dim, unnest([accuracy, completeness, topic_coherence, citation_quality]) as s from judgments),
m as (select dim, round(avg(s), 6) as mean from l group by dim) select o.ord::bigint as ord, o.dim, m.mean from (values {", ".join(f"({i}, '{d}')" for i, d in enumerate(ORDER))}) o(ord, dim) left join m using (dim)""")
def external_order(spark, sf_dir):
    """Dimension means in a given order, with places for dimensions without scores."""
    m = judgments(spark, sf_dir).unpivot(["question_id", "judge"], DIMS, "dim", "s").groupBy("dim").agg(F.round(F.avg("s"), 6).alias("mean"))
    return R.reindexed(m, "dim", ORDER)


@query(f"""with {JUDGMENTS_SQL} select judge, citation_quality is null as missing, count(*) as n, round(avg(length(p_type)), 6) as mean_chars, max(length(p_type)) as most_chars from judgments join part on p_partkey = question_id group by 1, 2""")
def length_missingness(spark, sf_dir):
    """Lengths of the judged texts where a score is missing and where it is not."""
    texts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.char_length("p_type").cast("long").alias("chars"))
    rows = judgments(spark, sf_dir).join(texts, "question_id").groupBy("judge", F.col("citation_quality").isNull().alias("missing"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("chars"), 6).alias("mean_chars"), F.max("chars").alias("most_chars"))


@query("""select conv_id, turn, regexp_replace('<think>' || role || chr(10) || '</think>A ' || text || case when turn % 2 = 0 then '<think>x</think>' else '<think>open' end, '(?s)<think>.*?</think>', '', 'g') as answer,
right(text, 300) as tail from conversations""")
def think_strip(spark, sf_dir):
    """Replies without what was thought aloud, and the last 300 characters of the texts."""
    end = F.when(F.col("turn") % 2 == 0, "<think>x</think>").otherwise("<think>open")
    reply = F.concat(F.lit("<think>"), "role", F.lit("\n</think>A "), "text", end)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.strip_think(reply).alias("answer"), T.last_chars(F.col("text"), 300).alias("tail"))


_CUT = "string_split_regex(t, '(?im)^[ \\t]*Article\\s+1[ \\t]*$')"


@query(f"""with t as (select s_suppkey as id, case when s_suppkey % 3 = 0 then 'No articles here.' else replace('{REGULATION}', '{{n}}', s_suppkey::varchar) end as t from supplier)
select id, case when len({_CUT}) > 1 then substr(t, length({_CUT}[1]) + 1) else t end as text from t""")
def preamble_strip(spark, sf_dir):
    """Regulations from their first article on; whole where there is none."""
    t = F.when(F.col("s_suppkey") % 3 == 0, "No articles here.").otherwise(F.replace(F.lit(REGULATION), F.lit("{n}"), F.col("s_suppkey").cast("string")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), T.without_preamble(t).alias("text"))


@query("select c_custkey as id, printf('T1-%03d', row_number() over (order by c_nationkey, c_custkey)) as sequence_id from customer")
def sequence_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return S.ordered_ranks(rows, "id", [], "c_nationkey").select("id", R.sequence_id(F.col("rank")).alias("sequence_id"))


PROMPT = "Topic: {zone}\nA ({name_a}): {text_a}\nB ({name_b}): {text_b}\nAsk one question."


@query("""with a as (select l_orderkey as zone, l_returnflag as regulation, l_partkey as id, 'Quantity ' || cast(l_quantity as int) || ', line ' || l_linenumber as text from lineitem)
select a.zone, a.regulation || '_Art' || a.id || '_x_' || b.regulation || '_Art' || b.id as pair_id, a.text as text_a, b.text as text_b,
'Topic: ' || a.zone || chr(10) || 'A (' || a.regulation || '): ' || a.text || chr(10) || 'B (' || b.regulation || '): ' || b.text || chr(10) || 'Ask one question.' as prompt
from a join a b on a.zone = b.zone and a.regulation < b.regulation""")
def pair_export(spark, sf_dir):
    """Article pairs with both texts and the prompt to make a question of."""
    text = F.concat(F.lit("Quantity "), F.col("l_quantity").cast("int"), F.lit(", line "), "l_linenumber")
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("zone"), F.col("l_returnflag").alias("regulation"), F.col("l_partkey").alias("id"), text.alias("text"))
    pairs = R.article_pairs(a, "zone", "regulation", "id")
    prompt = T.render(PROMPT, zone=F.col("zone"), name_a=F.col("regulation_a"), text_a=F.col("text_a"), name_b=F.col("regulation_b"), text_b=F.col("text_b"))
    return pairs.select("zone", "pair_id", "text_a", "text_b", prompt.alias("prompt"))


def _epochs_sql(n: int) -> str:
    """Weights of n epochs, each from the one before."""
    out = [f"with {WEIGHTS_SQL}, w0 as (select stratum, w from weights)"]
    for k in range(n):
        margins = f"select l_linestatus as stratum, avg(l_discount - l_tax) as margin from lineitem where l_linenumber % {n} = {k} group by 1 union all select 'P', 0.01::double"
        out.append(f"w{k + 1} as (select stratum, f / sum(f) over () as w from (select stratum, greatest(e / sum(e) over (), 0.2::double) as f from (select stratum, exp(ln(w) - 0.5 * margin) as e from w{k} join ({margins}) using (stratum))))")
    return ", ".join(out) + " " + " union all ".join(f"select {k} as epoch, stratum, round(w, 9) as w from w{k}" for k in range(n + 1))


@query(_epochs_sql(4))
def epoch_weights(spark, sf_dir):
    """Group weights after each of four epochs, every epoch with margins of its own rows."""
    rows = table(spark, sf_dir, "lineitem")

    def margins(epoch):
        m = rows.where(F.col("l_linenumber") % 4 == epoch).groupBy(F.col("l_linestatus").alias("stratum")).agg(F.avg(F.col("l_discount") - F.col("l_tax")).alias("margin"))
        return m.unionByName(spark.createDataFrame([("P", 0.01)], "stratum string, margin double"))

    steps = S.weights_over_epochs(spark.createDataFrame(WEIGHTS, "stratum string, w double"), margins, 4, 0.5, 0.2)
    return steps.select("epoch", "stratum", F.round("w", 9).alias("w"))


@query(f"""with {EVAL_SQL} select judge, {", ".join(f"coalesce(bool_or(folder = 'run{k}' and accuracy >= 4), false) as run{k}" for k in range(4))} from eval group by judge""")
def presence_transposed(spark, sf_dir):
    """In which folders a judge gave high scores: judges as rows, folders as columns."""
    rows = evaluations(spark, sf_dir).withColumn("judge", F.regexp_replace("alias", "^org/", ""))
    return rows.groupBy("judge").agg(*(F.coalesce(F.bool_or((F.col("folder") == f"run{k}") & (F.col("accuracy") >= 4)), F.lit(False)).alias(f"run{k}") for k in range(4)))


@query(f"with {COMPLETE_SQL} select question_id, answerer, judge, round(overall, 6) as overall from complete where overall >= 3 and accuracy < completeness order by overall desc, question_id, answerer, judge limit 10")
def range_filter(spark, sf_dir):
    """The report's ten best judgments whose accuracy lies below their completeness."""
    rows = P.complete(judgments(spark, sf_dir)).where("overall >= 3 and accuracy < completeness")
    return rows.orderBy(F.desc("overall"), "question_id", "answerer", "judge").limit(10).select("question_id", "answerer", "judge", F.round("overall", 6).alias("overall"))
