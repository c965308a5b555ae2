"""Places in a sorted table, whatever the sizes of groups."""

from pyspark.sql import functions as F

from scorewright.operators import ranks


def test_positions_are_those_of_a_sort(spark):
    rows = [(k % 3, (k * 7919) % 101, k) for k in range(5000)]
    df = spark.createDataFrame(rows, "g int, v int, k int").repartition(7)
    got = ranks.positions(df, [F.desc("v"), F.asc("k")]).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert sorted((r.position, (r.g, r.v, r.k)) for r in got) == list(enumerate(order))
    assert ranks.positions(df.limit(0), [F.col("v")]).count() == 0


def test_ranks_and_quantiles_of_odd_groups(spark):
    import numpy as np

    rows = [("a", float((k * 37) % 11), k) for k in range(200)] + [("b", 1.5, 1)] + [(None, float(k), 3) for k in range(5)] + [("c", None, 1), ("a", None, 2)]
    df = spark.createDataFrame(rows, "g string, v double, _at int").repartition(5)
    got = {r.g: (r.n, r.quantiles) for r in ranks.quantiles(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    groups = {g: np.array([v for h, v, _ in rows if h == g and v is not None]) for g in ("a", "b", None)}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g][0] == len(x) and np.allclose(got[g][1], np.quantile(x, [0.0, 0.3, 0.5, 1.0]))
    found = ranks.average_ranks(df.drop("_at"), ["g"], "v", "r").collect()
    for g, x in groups.items():
        assert sorted((r.v, r.r) for r in found if r.g == g) == sorted((v, float((x < v).sum() + ((x == v).sum() + 1) / 2)) for v in x)
    assert ranks.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0 and ranks.average_ranks(df.limit(0).drop("_at"), ["g"], "v", "r").count() == 0


def test_a_group_that_is_all_rows_is_many_partitions(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), (F.col("id") * 7919 % 10_007).alias("v"), "id").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table's partitions are merged otherwise
    try:
        placed = ranks.positions(df, [F.col("g"), F.col("v"), F.col("id")])
        sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 10_000 and placed.agg(F.countDistinct("position")).first()[0] == 20_000
