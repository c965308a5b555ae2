"""Exact positions in a sorted table, and ranks and quantiles from them, for values of any kind and groups of any size.

Spark sorts slim rows over range partitions, the sorted table is checkpointed, and a row's place is the number of rows in
the partitions before its own and its index there. So no window and no buffer holds a group: a group that is all of the
table is as many partitions as the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folders import checkpointed

#: Bits of a row's index in its partition in monotonically_increasing_id.
INDEX = 33


def positions(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """rows with their place (0, 1, ...) in an order. Columns of order that leave ties give any order among them.

    The order should end with a key, so that rows of equal values are spread over tasks too. rows are computed
    twice (for the ranges, then sorted): give a table or checkpoint where that is dear.
    """
    placed = checkpointed(rows.orderBy(*order)).withColumn("_i", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_i", INDEX)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    index = F.col("_i").bitwiseAND(F.lit((1 << INDEX) - 1))
    return placed.withColumn("_p", part).join(F.broadcast(before), "_p").select(*rows.columns, (F.col("_before") + index).alias(name))


def _in_groups(rows: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """rows in the order of (by, value) with their place in it, and (by, start, size) of each group. Null values are left out."""
    placed = positions(rows.where(F.col(value).isNotNull()), [*(F.col(c) for c in by), F.col(value)], "_at")
    groups = placed.groupBy(*by).agg(F.min("_at").alias("_start"), F.count("*").alias("_size"))
    return placed, groups


def _same(by: list[str], left: DataFrame, right: DataFrame) -> Column:
    """Equal group columns, null like any other."""
    same = F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(right[f"_{c}"])
    return same


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """rows with the rank of value in its group (1, 2, ...), equal values sharing the mean of theirs. Rows without value are left out.

    Of equal values only their first and last place is needed: one row for each different value of a group meets the rows in a join.
    """
    placed, groups = _in_groups(rows, by, value)
    ends = placed.groupBy(*by, value).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    named = groups.select(*(F.col(c).alias(f"_{c}") for c in by), "_start")
    ends = ends.join(named, _same(by, ends, named)).select(*(F.col(c).alias(f"_{c}") for c in by), F.col(value).alias("_v"), ((F.col("_lo") + F.col("_hi")) / 2 - F.col("_start") + 1).alias(out))
    return placed.join(ends, _same(by, placed, ends) & (F.col(value) == F.col("_v"))).select(*rows.columns, out)


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, rho: rank correlation of the rows that have both; null where one of them is constant."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.nanvl(F.corr("_rx", "_ry"), F.lit(None).cast("double")).alias("rho"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, n, quantiles: exact quantiles of value in each group by linear interpolation, in the order of shares. Null values are left out.

    Two places of the order for each share are looked up; no task holds a group.
    """
    placed, groups = _in_groups(rows.select(*by, F.col(value).cast("double").alias("_v")), by, "_v")
    groups = checkpointed(groups)
    want = groups.select(*(F.col(c).alias(f"_{c}") for c in by), "_start", "_size", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(s)).alias("share")) for k, s in enumerate(shares)))).alias("q"))
    at = (F.col("_size") - 1) * F.col("q.share")
    want = want.select(*(f"_{c}" for c in by), "_size", "q.k", (at - F.floor(at)).alias("part"), F.explode(F.array(F.struct((F.col("_start") + F.floor(at)).alias("at"), F.lit(0).alias("end")), F.struct((F.col("_start") + F.ceil(at)).alias("at"), F.lit(1).alias("end")))).alias("p"))
    found = want.join(placed.select("_at", "_v"), F.col("p.at") == F.col("_at"))
    ends = found.groupBy(*(f"_{c}" for c in by), "_size", "k", "part").agg(F.max(F.when(F.col("p.end") == 0, F.col("_v"))).alias("lo"), F.max(F.when(F.col("p.end") == 1, F.col("_v"))).alias("hi"))
    one = F.struct("k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("x"))
    return ends.groupBy(*(f"_{c}" for c in by), "_size").agg(F.array_sort(F.collect_list(one)).alias("x")).select(*(F.col(f"_{c}").alias(c) for c in by), F.col("_size").alias("n"), F.col("x.x").alias("quantiles"))
