"""Deterministic splits, samples and re-weighting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folders import checkpointed
from .bootstrap import draws

#: Hash values and cells of them in which ranks are counted.
RANGE, CELLS = 1_000_003, 1024


def draw(key: Column, seed: int = 42) -> Column:
    """An integer 0..RANGE-1 for each key, the same in any SQL engine."""
    return F.pmod(key.cast("long") % RANGE * 48271 + seed * 7919, F.lit(RANGE))


def cell_ranks(rows: DataFrame, by: list[str], cells: dict[str, Column], order: list[Column], cell_order: list[Column]) -> DataFrame:
    """rows with `rank` (1..) in an order within a group and `size` of the group; rank follows cells, then order.

    A group can be a third of the table, so rows are ranked inside cells of the order, and the sizes of the cells before
    are added: one row for each cell of a group, not the group, is what a task holds.
    """
    rows = rows.withColumns(cells)
    counts = rows.groupBy(*by, *cells).agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*by).orderBy(*cell_order).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_below": F.coalesce(F.sum("_n").over(below), F.lit(0)), "size": F.sum("_n").over(Window.partitionBy(*by))})
    inside = F.row_number().over(Window.partitionBy(*by, *cells).orderBy(*order))
    ranked = rows.withColumn("_r", inside).join(counts.drop("_n"), [*by, *cells])
    return ranked.withColumn("rank", F.col("_below") + F.col("_r")).drop("_r", "_below", *cells)


def hash_ranks(rows: DataFrame, key: str, by: list[str], seed: int = 42) -> DataFrame:
    """rows with `rank` (1..) by draw order within a group and `size` of the group; CELLS cells a group."""
    rows = rows.withColumn("_d", draw(F.col(key), seed))
    return cell_ranks(rows, by, {"_c": F.floor(F.col("_d") * CELLS / RANGE)}, [F.col("_d"), F.col(key)], [F.col("_c")]).drop("_d")


def ordered_ranks(rows: DataFrame, key: str, by: list[str], value: str, descending: bool = False) -> DataFrame:
    """rows with `rank` (1..) by value, then integer key, within a group and `size` of the group.

    Made for scores of few levels: a cell is one level and one of CELLS ranges of the key, because a single level can
    hold most rows. Null values and keys are left out.
    """
    rows = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull())
    ends = rows.agg(F.min(key).cast("long").alias("_lo"), F.max(key).cast("long").alias("_hi"))
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    cell = F.floor((F.col(key) - F.col("_lo")) / (F.floor((F.col("_hi") - F.col("_lo")) / CELLS) + 1))
    level = F.col("_v").desc() if descending else F.col("_v")
    return cell_ranks(rows, by, {"_v": F.col(value), "_c": cell}, [F.col(key)], [level, F.col("_c")]).drop("_lo", "_hi")


#: Rows of a table of cut points that every task may carry; a larger one is joined by an exchange on the groups.
CARRIED = 100_000


def _few(table: DataFrame) -> bool:
    return table.limit(CARRIED + 1).count() <= CARRIED


def _beside(rows: DataFrame, table: DataFrame, by: list[str], few: bool, how: str = "inner") -> DataFrame:
    """rows joined with a table on the columns `by`, null like any other value; few: every task may carry the table."""
    named = table.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & rows[c].eqNullSafe(named[f"_by{i}"])
    return rows.join(F.broadcast(named) if few else named, same, how).drop(*(f"_by{i}" for i in range(len(by))))


def _located(counts: DataFrame, want: DataFrame, by: list[str], part: str, few: bool) -> DataFrame:
    """For each wanted place (by, cut, n) the part of its group that holds it, and the place within that part. counts: by, part, _n."""
    up_to = F.sum("_n").over(Window.partitionBy(*by).orderBy(part))
    return _beside(counts.withColumn("_up", up_to), want, by, few).where("n <= _up and n > _up - _n").select(*by, "cut", part, (F.col("n") - F.col("_up") + F.col("_n")).alias("n"))


def cut_points(rows: DataFrame, key: str, by: list[str], wanted: Callable[[DataFrame], DataFrame], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sizes, points): by, size of each group; by, cut, point: the (draw, key) of the row at a place of a group in draw order.

    wanted(sizes) gives by, cut, n: the places, from 1; others have no point. No row moves: rows are counted where they are in CELLS cells of
    the draw, then the rows of the cells that hold a wanted place by their draw, then keys of a wanted draw (one in RANGE of a group) are
    ranked. Rows without a key are left out.
    """
    slim = rows.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("_k"), draw(F.col(key), seed).alias("_d")).withColumn("_c", F.floor(F.col("_d") * CELLS / RANGE))
    counts = checkpointed(slim.groupBy(*by, "_c").agg(F.count("*").alias("_n")))
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("size"))
    want = checkpointed(wanted(sizes).where("n >= 1").select(*by, "cut", F.col("n").cast("long").alias("n")))
    few, place = _few(want), by  # a wanted place is in one cell, one draw and one key: no later table is larger
    for part, inner in (("_c", "_d"), ("_d", "_k"), ("_k", None)):
        want = checkpointed(_located(counts, want, place, part, few))
        place = [*place, part]
        if inner:
            counts = _beside(slim, want.select(*place).distinct(), place, few).groupBy(*place, inner).agg(F.count("*").alias("_n"))
    return sizes, want.select(*by, "cut", F.struct("_d", "_k").alias("point"))


def cut_rows(rows: DataFrame, key: str, by: list[str], points: DataFrame, cuts: list[str], seed: int = 42) -> DataFrame:
    """rows with a key, and for each cut a boolean column: whether the row lies at its place or before, false where the cut has no point."""
    wide = points.groupBy(*by).agg(*(F.max(F.when(F.col("cut") == c, F.col("point"))).alias(f"_{c}") for c in cuts))
    own = F.struct(draw(F.col(key), seed).alias("_d"), F.col(key).alias("_k"))
    joined = _beside(rows.where(F.col(key).isNotNull()), wide, by, _few(points), "left")
    return joined.select(*rows.columns, *(F.coalesce(own <= F.col(f"_{c}"), F.lit(False)).alias(c) for c in cuts))


def _places(by: list[str], **places: Column) -> Callable[[DataFrame], DataFrame]:
    """The places of each group, of its size."""
    return lambda sizes: sizes.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), n.cast("long").alias("n")) for c, n in places.items()))).alias("x")).select(*by, "x.*")


def stratified_split(rows: DataFrame, key: str, stratum: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with `split`: exact shares of each stratum (null is one). Keys are unique; rows stay where they are."""
    _, points = cut_points(rows, key, [stratum], _places([stratum], _train=F.floor(F.col("size") * train), _val=F.floor(F.col("size") * (train + val))), seed)
    r = cut_rows(rows, key, [stratum], points, ["_train", "_val"], seed)
    return r.withColumn("split", F.when(F.col("_train"), "train").when(F.col("_val"), "val").otherwise("test")).drop("_train", "_val")


def held_out(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """rows with `split`: `eval` for an exact share (rounded up) of all rows in draw order, else `train`. Keys are unique; rows stay where they are."""
    _, points = cut_points(rows, key, [], _places([], _eval=F.ceil(F.col("size") * share)), seed)
    return cut_rows(rows, key, [], points, ["_eval"], seed).withColumn("split", F.when(F.col("_eval"), "eval").otherwise("train")).drop("_eval")


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in draw order (a top-n, not a sort of everything)."""
    return rows.orderBy(draw(F.col(key), seed), key).limit(n)


def weighted_sample(rows: DataFrame, key: str, group: str, weights: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Rows by group weight: max(1, round(w / W * target)) of each group, without replacement while the pool lasts, else with.

    weights(group, w) has a row for each group; W is the sum over groups that occur.
    """
    def wanted(sizes: DataFrame) -> DataFrame:
        n = F.when(F.col("places") <= F.col("pool"), F.col("places")).otherwise(F.col("places") % F.col("pool"))
        return _wanted(sizes, group, weights, target).select(group, F.lit("_more").alias("cut"), n.alias("n"))

    sizes, points = cut_points(rows, key, [group], wanted, seed)
    want = _wanted(sizes, group, weights, target)
    picked = _beside(cut_rows(rows, key, [group], points, ["_more"], seed), want, [group], _few(want))
    every = F.when(F.col("places") > F.col("pool"), F.floor(F.col("places") / F.col("pool"))).otherwise(0)
    picked = picked.withColumn("_t", every + F.col("_more").cast("long")).where("_t > 0")
    return picked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_t")))).select(*rows.columns, "copy")


def _wanted(sizes: DataFrame, group: str, weights: DataFrame, target: int) -> DataFrame:
    """group, pool, places: max(1, round(w / W * target)) rows of each group that occurs and has a weight."""
    sizes = sizes.withColumnRenamed("size", "pool").join(weights, group)
    total = sizes.agg(F.sum("w").alias("total"))
    want = sizes.crossJoin(total)  # one row of totals
    return checkpointed(want.select(group, "pool", F.greatest(F.lit(1), F.bround(F.col("w") / F.col("total") * target)).cast("long").alias("places")))


def weighted_draws(rows: DataFrame, key: str, group: str, weights: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Rows by group weight as `weighted_sample`, but groups that are asked for more rows than they have are drawn with replacement.

    Each of a group's n places is an independent draw, so a row may come often or never (n places of a multinomial). `copy` numbers a row's
    copies from 1. key is an integer, unique and not null; groups without a weight are left out.
    """
    def wanted(sizes: DataFrame) -> DataFrame:
        return _wanted(sizes, group, weights, target).where("places <= pool").select(group, F.lit("_in").alias("cut"), F.col("places").alias("n"))

    sizes, points = cut_points(rows, key, [group], wanted, seed)
    once = cut_rows(rows, key, [group], points, ["_in"], seed).where("_in")
    want = _wanted(sizes, group, weights, target)
    times = draws(rows, group, key, want.where("places > pool"), seed)
    often = rows.join(times, F.col(key) == F.col("k")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return once.select(*rows.columns, F.lit(1).cast("long").alias("copy")).unionByName(often.select(*rows.columns, "copy"))


def updated_weights(groups: DataFrame, eta: float = 0.1, floor: float = 0.05) -> DataFrame:
    """groups(group, w, margin) with new_w: softmax of ln w - eta * margin, floored and normalised. There are few groups."""
    every = groups.agg(F.max(F.log("w") - eta * F.col("margin")).alias("top"))
    x = groups.crossJoin(every).withColumn("e", F.exp(F.log("w") - eta * F.col("margin") - F.col("top")))
    s = x.crossJoin(x.agg(F.sum("e").alias("s"))).withColumn("f", F.greatest(F.col("e") / F.col("s"), F.lit(floor)))
    return s.crossJoin(s.agg(F.sum("f").alias("t"))).withColumn("new_w", F.col("f") / F.col("t")).drop("top", "e", "s", "f", "t")


#: Groups whose weights the driver carries from epoch to epoch.
GROUPS = 10_000


def weights_over_epochs(weights: DataFrame, margins: Callable[[int], DataFrame], epochs: int, eta: float = 0.1, floor: float = 0.05) -> DataFrame:
    """(epoch, <group>, w) before the first and after each epoch: margins(epoch) gives (<group>, margin) under the weights so far.

    weights(<group>, w) has few rows (GROUPS at most, else an error), which are the state between epochs.
    """
    spark, group = weights.sparkSession, weights.columns[0]
    schema = f"`{group}` {weights.schema[group].dataType.simpleString()}, w double"
    rows = weights.select(group, "w").limit(GROUPS + 1).collect()
    if len(rows) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    states = [(0, *r) for r in rows]
    for epoch in range(epochs):
        now = spark.createDataFrame([s[1:] for s in states if s[0] == epoch], schema)
        new = updated_weights(now.join(margins(epoch), group), eta, floor).select(group, "new_w").collect()  # at most GROUPS
        states += [(epoch + 1, *r) for r in new]
    return spark.createDataFrame(states, f"epoch int, {schema}")


def upsampled(rows: DataFrame, hard: Column, times: int = 4) -> DataFrame:
    """Hard rows `times` times in total, others once."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(hard, times).otherwise(1))))


def labelled(pairs: DataFrame) -> DataFrame:
    """Each preference pair as two rows: the chosen text labelled true, the rejected false."""
    two = F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))
    return pairs.withColumn("_x", F.explode(two)).select(*(c for c in pairs.columns if c not in ("chosen", "rejected")), "_x.completion", "_x.label")


def masked(prompt: Column, answer: Column, end: int, width: int, pad: int = 0, ignore: int = -100) -> tuple[Column, Column]:
    """(input ids, labels) of width: prompt, answer and end id, truncated, padded; labels ignore prompt and padding."""
    fill = lambda xs, v: F.slice(F.concat(xs, F.array_repeat(F.lit(v), width)), 1, width)
    out = F.concat(answer, F.array(F.lit(end)))
    return fill(F.concat(prompt, out), pad), fill(F.concat(F.transform(prompt, lambda x: F.lit(ignore)), out), ignore)


def dr_loss(rows: DataFrame, by: list[str], x: str, beta: float) -> DataFrame:
    """by, n, loss: -beta * ln(mean(exp(-x / beta))), in two passes so that large values do not overflow.

    The formula is a soft minimum: its gradient favours small losses.
    """
    low = rows.groupBy(*by).agg(F.min(x).alias("_low"))
    parts = rows.join(low, by).groupBy(*by).agg(F.first("_low").alias("low"), F.sum(F.exp((F.col("_low") - F.col(x)) / beta)).alias("s"), F.count(x).alias("n"))
    return parts.select(*by, "n", (F.col("low") - beta * (F.log("s") - F.log("n"))).alias("loss"))
