"""Ranks and quantiles of values of many levels, in groups of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks as R
from ..registry import query
from ..sources.views import table


@query("""select l_returnflag, count(*) as n, round(quantile_cont(l_extendedprice::double, 0.25), 6) as q1, round(quantile_cont(l_extendedprice::double, 0.5), 6) as median,
round(quantile_cont(l_extendedprice::double, 0.75), 6) as q3, round(quantile_cont(l_extendedprice::double, 0.99), 6) as p99 from lineitem where l_extendedprice is not null group by 1""")
def price_quantiles(spark, sf_dir):
    """Exact quantiles of line prices by return flag."""
    q = R.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75, 0.99])
    return q.select("l_returnflag", "n", *(F.round(F.get("quantiles", F.lit(k)), 6).alias(c) for k, c in enumerate(("q1", "median", "q3", "p99"))))


@query("""with r as (select l_linestatus, rank() over (partition by l_linestatus order by l_extendedprice) + (count(*) over (partition by l_linestatus, l_extendedprice) - 1) / 2.0::double as x,
rank() over (partition by l_linestatus order by l_quantity) + (count(*) over (partition by l_linestatus, l_quantity) - 1) / 2.0::double as y from lineitem where l_extendedprice is not null and l_quantity is not null)
select l_linestatus, count(*) as n, round(corr(x, y), 6) as rho from r group by 1""")
def price_spearman(spark, sf_dir):
    """Rank correlation of price and quantity by line status: many levels in one, long ties in the other."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_extendedprice", "l_quantity")
    return R.spearman(rows, ["l_linestatus"], "l_extendedprice", "l_quantity").withColumn("rho", F.round("rho", 6))
