"""Log-probabilities, token matching and latent vectors of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bert_score as B
from ..operators import density, latent
from ..operators import language_model as L
from ..operators import vectors as V
from ..registry import query
from ..sources.views import dealt, table


def _pairs(spark, sf_dir):
    """(conv_id, turn, prompt, answer): each assistant turn with the turn before it."""
    rows = table(spark, sf_dir, "conversations")
    before = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    return rows.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(dealt(before), ["conv_id", "turn"])


TOKEN_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]')"
PAIRS_SQL = "pairs as (select a.conv_id, a.turn, b.text as prompt, a.text as answer from conversations a join conversations b on a.conv_id = b.conv_id and a.turn = b.turn + 1 where a.role = 'assistant')"
_D = "coalesce(nullif(count(*) filter (where n = 1), 0)::double / (count(*) filter (where n = 1) + nullif(2 * count(*) filter (where n = 2), 0)), 0.75)"


@query(rf"""with {PAIRS_SQL}, t as (select list_concat(['<s>', '<s>'], coalesce({TOKEN_SQL.format("text")}, []), ['</s>']) as x from conversations),
g as (select x[i] as u, x[i + 1] as v, x[i + 2] as w from (select x, unnest(range(1, len(x) - 1)) as i from t)),
c3 as (select u, v, w, count(*) as n from g group by all), c2 as (select v, w, count(*) as n from c3 group by all), c1 as (select w, count(*) as n from c2 group by all),
k as (select (select {_D} from c1) as d1, (select {_D} from c2) as d2, (select {_D} from c3) as d3, (select sum(n) from c1)::double as total, (select count(*) from c1)::double as types),
s3 as (select u, v, sum(n) as total, count(*) as types from c3 group by all), s2 as (select v, sum(n) as total, count(*) as types from c2 group by all),
q as (select conv_id, turn, x[i] as u, x[i + 1] as v, x[i + 2] as w from (select conv_id, turn, x, unnest(range(n + 1, len(x) - 1)) as i
      from (select conv_id, turn, len({TOKEN_SQL.format("prompt")}) as n, list_concat(['<s>', '<s>'], {TOKEN_SQL.format("prompt")}, {TOKEN_SQL.format("answer")}) as x from pairs))),
p1 as (select w, (greatest(coalesce(n, 0) - d1, 0) + d1 * types / (types + 1)) / total as p from (select distinct w from q) left join c1 using (w), k),
p2 as (select v, w, case when s2.total is null then p else (greatest(coalesce(n, 0) - d2, 0) + d2 * s2.types * p) / s2.total end as p
       from (select distinct v, w from q) left join c2 using (v, w) left join s2 using (v) join p1 using (w), (select d2 from k)),
p3 as (select u, v, w, case when s3.total is null then p else (greatest(coalesce(n, 0) - d3, 0) + d3 * s3.types * p) / s3.total end as p
       from (select distinct u, v, w from q) left join c3 using (u, v, w) left join s3 using (u, v) join p2 using (v, w), (select d3 from k)),
sums as (select conv_id, turn, count(*) as n_tokens, sum(ln(p)) as logprob from q join p3 using (u, v, w) group by all)
select conv_id, turn, coalesce(n_tokens, 0) as n_tokens, round(coalesce(logprob, 0.0::double), 4) as logprob from pairs left join sums using (conv_id, turn)""")
def completion_logprobs(spark, sf_dir):
    """Log-probability of each answer after its prompt, under a trigram model of all turns."""
    model = L.fit(table(spark, sf_dir, "conversations"), "text")
    return L.score(model, _pairs(spark, sf_dir), ["conv_id", "turn"], "prompt", "answer").withColumn("logprob", F.round("logprob", 4))


#: A stand-in vector of each word: one of the given embeddings, by the word's length and first letter.
_VEC = "(ascii({0}) + 31 * length({0})) % 500"


@query(rf"""with {PAIRS_SQL}, v as (select vec_id, embedding[1:8]::double[] as e from embeddings where vec_id < 500),
w as (select conv_id, turn, unnest({TOKEN_SQL.format("answer")}) as t, 1 as c, 0 as r from pairs union all select conv_id, turn, unnest({TOKEN_SQL.format("prompt")}), 0, 1 from pairs),
n as (select conv_id, turn, {_VEC.format("t")} as token, sum(c) as c, sum(r) as r from w group by all),
df as (select token, count(*) as df from n where r > 0 group by 1), total as (select count(*) as n from pairs),
x as (select conv_id, turn, n.token, c, r, e, ln((total.n + 1.0::double) / (coalesce(df, 0) + 1)) as w from n join v on n.token = vec_id left join df on df.token = n.token, total),
m as (select a.conv_id, a.turn, a.token as x, b.token as y, a.c * a.w as wc, b.r * b.w as wr, list_cosine_similarity(a.e, b.e) as s from x a join x b on a.conv_id = b.conv_id and a.turn = b.turn and a.c > 0 and b.r > 0),
p as (select conv_id, turn, sum(best * wc) / sum(wc) as p from (select conv_id, turn, x, wc, max(s) as best from m group by all) group by all),
r as (select conv_id, turn, sum(best * wr) / sum(wr) as r from (select conv_id, turn, y, wr, max(s) as best from m group by all) group by all),
f as (select conv_id, coalesce(p, 0) as p, coalesce(r, 0) as r, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from pairs left join p using (conv_id, turn) left join r using (conv_id, turn))
select case when conv_id % 2 = 0 then 'baseline' else 'trained' end as side, count(*) as n, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(f1), 6) as bert_score from f group by 1""")
def bert_score_mean(spark, sf_dir):
    """Mean BERTScore of answers against their prompts by side, over given vectors."""
    number = lambda ws: F.transform(ws, lambda w: ((F.ascii(w) + 31 * F.length(w)) % 500).cast("long"))
    pairs = _pairs(spark, sf_dir).select(F.struct("conv_id", "turn").alias("pair"), number(L.tokens(F.col("answer"))).alias("answer"), number(L.tokens(F.col("prompt"))).alias("prompt"))
    pairs = pairs.withColumn("pair", F.concat_ws("-", "pair.conv_id", "pair.turn"))
    given = table(spark, sf_dir, "embeddings").where("vec_id < 500").select(F.col("vec_id").alias("token"), F.slice("embedding", 1, 8).alias("vector"))
    scores = B.bert_scores(pairs, "pair", "answer", "prompt", given)
    side = F.when(F.split("pair", "-")[0].cast("long") % 2 == 0, "baseline").otherwise("trained")
    return B.mean_scores(scores, side, "side").select("side", "n", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("bert_score"))


@query()
def bert_score_words(spark, sf_dir):
    """BERTScore of each answer against its prompt, over word vectors from the co-occurrences in all turns."""
    words = table(spark, sf_dir, "conversations").select(L.tokens(F.col("text")).alias("words"))
    pairs = _pairs(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("pair"), L.tokens(F.col("answer")).alias("answer"), L.tokens(F.col("prompt")).alias("prompt"))
    scores = B.bert_scores(pairs, "pair", "answer", "prompt", B.word_vectors(words, "words"))
    return scores.select("pair", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


#: More than the turns of a conversation.
TURNS = 1 << 24


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * TURNS + F.col("turn")).alias("id"), "conv_id", "turn", "text")


@query()
def latent_similarity(spark, sf_dir):
    """Cosine of the latent semantic vectors of each question and the turn that follows it."""
    found = latent.vectors(latent.decomposed(_turns(spark, sf_dir), "id", "text", 32), "id")
    next_one = found.select((F.col("id") - 1).alias("id"), F.col("vector").alias("answer"))
    both = found.where("id % 2 = 0").join(next_one, "id")
    return both.select(F.expr(f"id div {TURNS}").alias("conv_id"), F.expr(f"(id % {TURNS}) div 2").alias("pair"), F.round(V.dot(F.col("vector"), F.col("answer")), 5).alias("similarity"))


@query()
def conversation_topics(spark, sf_dir):
    """Density topics of all turns over latent vectors; outliers go to the topic of their words."""
    turns = _turns(spark, sf_dir)
    found = latent.vectors(latent.decomposed(turns, "id", "text", 16), "id")
    topics = density.clusters(found, "id", "vector", least=15, samples=5).select("id", "topic")
    rows = turns.join(topics, "id", "left").withColumn("topic", F.coalesce("topic", F.lit(-1)))
    return density.reassigned(rows, "id", "text").select("conv_id", "turn", "topic", "moved")
