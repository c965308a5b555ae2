"""Embedding and TF-IDF queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density
from ..operators import vectors as V
from ..operators.nearest_label import nearest_labels
from ..registry import query
from ..sources.folders import checkpointed
from ..sources.views import spread, table

CENTROID_SQL = """cells as (select label, i, avg(x::double) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2),
centroids as (select label, list(m order by i) as c from cells group by label),
scored as (select e.vec_id, e.label, c.label as l, list_cosine_similarity(e.embedding::double[], c.c) as sim from embeddings e cross join centroids c),
near as (select vec_id, label, arg_min(l, struct_pack(a := -sim, b := l)) as predicted, max(sim) as similarity, max(sim) filter (where l = label) as own_similarity, max(sim) filter (where l <> label) as best_other from scored group by 1, 2)"""


def _nearest(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return V.nearest(rows, V.centroids(rows, "label", "embedding"), "embedding", "label", "label")


@query(f"with {CENTROID_SQL} select vec_id, round(own_similarity, 6) as similarity from near")
def embed_cosine(spark, sf_dir):
    """Cosine of each vector and its own label's centroid."""
    return _nearest(spark, sf_dir).select("vec_id", F.round("own_similarity", 6).alias("similarity"))


@query(f"with {CENTROID_SQL} select vec_id, label, predicted, round(similarity, 6) as similarity, predicted = label as correct from near")
def topic_nn(spark, sf_dir):
    return _nearest(spark, sf_dir).select("vec_id", "label", "predicted", F.round("similarity", 6).alias("similarity"), (F.col("predicted") == F.col("label")).alias("correct"))


@query(f"with {CENTROID_SQL} select label, count(*) as n, round(avg(own_similarity - best_other), 6) as mean_margin, round(min(own_similarity - best_other), 6) as min_margin, round(avg(case when predicted = label then 1.0::double else 0.0::double end), 6) as accuracy, round(corr(own_similarity, best_other), 5) as r from near group by label")
def topic_margin_stats(spark, sf_dir):
    g = _nearest(spark, sf_dir).groupBy("label")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("margin"), 6).alias("mean_margin"), F.round(F.min("margin"), 6).alias("min_margin"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("double")), 6).alias("accuracy"), F.round(F.corr("own_similarity", "best_other"), 5).alias("r"))


@query("""with c as (select conv_id, turn // 2 as pair, turn % 2 as part, text from conversations), n as (select count(*) as n from c),
t as (select conv_id, pair, part, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term from c), tf as (select conv_id, pair, part, term, count(*) as tf from t group by all),
df as (select term, count(*) as df from tf group by 1), w as (select conv_id, pair, part, term, tf * (ln((1 + n)::double / (1 + df)) + 1) as w from tf join df using (term), n),
x as (select *, w / sqrt(sum(w * w) over (partition by conv_id, pair, part)) as weight from w)
select conv_id, pair, round(coalesce(sum(x0 * x1), 0.0::double), 6) as similarity from (select conv_id, pair, term, max(case when part = 0 then weight end) as x0, max(case when part = 1 then weight end) as x1 from x group by 1, 2, 3) group by 1, 2""")
def tfidf_cosine(spark, sf_dir):
    """TF-IDF cosine of each question and the answer that follows it, over all turns of all conversations."""
    turn = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.floor(turn / 2).alias("pair"), (turn % 2).cast("string").alias("part"), "text")
    w = V.tfidf(rows, ["conv_id", "pair", "part"], "text")
    return V.pair_cosine(w, "0", "1", ["conv_id", "pair"], "part").withColumn("similarity", F.round("similarity", 6))


@query("""with t as (select lang, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as term from documents), tf as (select lang, term, count(*) as tf, count(distinct doc_id) as df from t group by 1, 2 having count(distinct doc_id) >= 2),
a as (select term, sum(tf) as f from tf group by 1), n as (select avg(s) as avg_words from (select sum(tf) as s from tf group by lang)), c as (select lang, sum(tf) as total from tf group by 1)
select lang, term, tf, round(tf::double / total * ln(1 + avg_words / f), 9) as score from tf join a using (term) join c using (lang), n""")
def class_tfidf(spark, sf_dir):
    """Class-based TF-IDF of the terms of each language, in two or more documents."""
    t = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id").select("lang", F.array_sort(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("terms"))
    first = F.transform("terms", lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (x != F.get("terms", i - 1)), 1).otherwise(0).alias("new")))  # a document's first of a term
    counts = t.select("lang", F.explode(first).alias("x")).groupBy("lang", "x.term").agg(F.count("*").alias("tf"), F.sum("x.new").alias("df")).where("df >= 2")
    per = checkpointed(counts)  # used three times; the texts are read once
    every = per.groupBy("term").agg(F.sum("tf").alias("f"))
    total = per.groupBy("lang").agg(F.sum("tf").alias("total"))
    mean = total.agg(F.avg("total").alias("avg_words"))
    rows = per.join(every, "term").join(total, "lang").crossJoin(mean)  # one row
    return rows.select("lang", "term", "tf", F.round(F.col("tf").cast("double") / F.col("total") * F.log(1 + F.col("avg_words") / F.col("f")), 9).alias("score"))


@query()
def density_topics(spark, sf_dir):
    """Density clusters of all vectors, outliers -1."""
    return density.clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", least=10).select("vec_id", "topic")


@query("""with s as (select a.vec_id, b.vec_id as label, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 12) as sim from embeddings a cross join embeddings b),
t as (select vec_id, arg_min(label, struct_pack(a := -sim, b := label)) as predicted, max(sim) as similarity, max(sim) filter (where label = vec_id) as own, max(sim) filter (where label <> vec_id) as best_other from s group by 1)
select vec_id, predicted, round(similarity, 6) as similarity, round(best_other, 6) as best_other, round(own - best_other, 6) as margin from t""")
def vector_neighbours(spark, sf_dir):
    """Each vector among all vectors as labels: the most similar one, and how far the best other one is."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest_labels(rows, "vec_id", "embedding", "vec_id", rows.select(F.col("vec_id").alias("label"), F.col("embedding").alias("centroid")), "label")
    return found.select("vec_id", "predicted", *(F.round(c, 6).alias(c) for c in ("similarity", "best_other", "margin")))
