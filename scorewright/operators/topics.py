"""Topics of vectors by k-means, in place of a density-based clustering."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V


def clusters(rows: DataFrame, vector: str, k: int, least: int, seed: int = 42) -> DataFrame:
    """rows with `topic` (a cluster, -1 if none) and `moved`, whether its first cluster was too small.

    Cosine k-means. Clusters of fewer than `least` members dissolve; the rest get centroids of their members, and each
    vector goes to the nearest of them. Null and zero vectors and those of other lengths than most have topic -1. An empty
    table gives an empty result. Only centroids come to the driver.
    """
    size = F.size(vector)
    widths = rows.where(size > 0).groupBy(size.alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 0
    usable = F.coalesce((size == width) & ~F.exists(vector, lambda x: x.isNull()) & (V.dot(F.col(vector), F.col(vector)) > 0), F.lit(False))
    fit = rows.where(usable).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    rest = rows.where(~usable).withColumns({"topic": F.lit(-1), "moved": F.lit(False)})
    if fit.isEmpty():
        return rest
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_v", predictionCol="_first").fit(fit)
    first = model.transform(fit).drop("_v")
    big = first.groupBy("_first").count().where(F.col("count") >= least).select("_first")
    kept = first.join(F.broadcast(big), "_first", "left_semi")  # k rows at most
    near = V.nearest(first, V.centroids(kept, "_first", vector), vector, "_first", "_first")
    topic = F.coalesce(F.col("predicted"), F.lit(-1))
    out = near.select(*rows.columns, topic.alias("topic"), F.col("own_similarity").isNull().alias("moved"))
    return out.unionByName(rest)
