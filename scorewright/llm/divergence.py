"""How the sources of a language differ: divergence of term shares between sources, and the terms that mark each source.

Terms are counted by DuckDB where the documents are read, in bounded tables; the partial counts are dealt by a hash of (lang, term), so
that a shard has all of a term. In each shard DuckDB adds them up, drops terms of few documents, and later adds the divergences of
pairs of sources over the terms that both have; Spark merges the sums of shards and ranks.

The divergence of two sources is a sum over all kept terms of the language, also those that only one or neither has. As a
term's share depends only on its count, those parts come from the numbers of terms with each count, without a row for
each term and pair. All shares and sums are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import checkpointed, partitions

#: Documents of a language that a kept term is in, unit of shares, terms shown for each group.
LEAST_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of partial counts that a task holds before it hands them on; bytes of texts that are counted at a time; bytes of a term's shard.
HELD, BLOCK, SHARD_MB = 400_000, 16 << 20, 16

_COUNT = f"""
select lang, source, term, sum(n)::bigint as n, count(*) as docs from (
  select r, lang, source, case when strlen(t) = length(t) then lower(t) else translate(t, '{UPPER}', '{LOWER}') end as term, count(*) as n
  from (select r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) as t from (select row_number() over () as r, lang, source, text from texts))
  group by all) group by lang, source, term
"""
_ADD = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from held group by all"
_KEEP = """
with parts as (select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from rows group by all)
select lang, source, term, n, sum(n) over t::bigint as total, (row_number() over (partition by lang, term order by source) = 1) as lead
from parts window t as (partition by lang, term) qualify sum(docs) over t >= {least}
"""
_F = "(({0} - {1}) * ({0} - {1})) // ({0} + {1})"
#: The terms that two sources both have: their number, and by how much the divergence over them is more than that of each source's terms if the other had none.
_PAIRS = f"""
select a.lang, a.source, b.source as item, count(*) as "both",
       sum({_F.format("a.p", "b.p")} - {_F.format("a.p", "b.zero")} - {_F.format("a.zero", "b.p")})::bigint as value
from rows a join rows b on a.lang = b.lang and a.term = b.term and a.source < b.source group by a.lang, a.source, b.source
"""
_TERMS = f"""
select lang, source, term as item, cast(null as bigint) as "both", {_F.format("p", "q")} as value from rows where p > q
qualify row_number() over (partition by lang, source order by value desc, encode(term)) <= {{top}}
"""


def _duck():
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": ""})  # bounded tables, nothing on a local disk


def _slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about BLOCK bytes of text; a longer text comes alone."""
    start = size = 0
    for k, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
        if k > start and size + n > BLOCK:
            yield b.slice(start, k - start)
            start, size = k, 0
        size += n
    if start < b.num_rows:
        yield b.slice(start)


def _arrow(relation) -> pa.Table:
    found = relation.to_arrow_table() if hasattr(relation, "to_arrow_table") else relation.arrow()
    return found if isinstance(found, pa.Table) else found.read_all()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of terms: (lang, source, term, n, docs), added up until HELD rows are there."""
    c, tables, rows = _duck(), [], 0
    for b in batches:
        for part in _slices(b, 2):
            c.register("texts", pa.Table.from_batches([part]))
            tables.append(_arrow(c.sql(_COUNT)))
            rows += tables[-1].num_rows
            if rows > HELD:
                c.register("held", pa.concat_tables(tables))
                tables = [_arrow(c.sql(_ADD))]
                rows = tables[0].num_rows
                if rows > HELD // 2:
                    yield from tables.pop().to_batches()
                    rows = 0
    if tables:
        c.register("held", pa.concat_tables(tables))
        yield from _arrow(c.sql(_ADD)).to_batches()


def _shard(*statements: str):
    """The rows of a shard, a task's partition, through SQL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            c = _duck()
            c.register("rows", pa.Table.from_batches(parts))
            for sql in statements:
                yield from _arrow(c.sql(sql)).to_batches()

    return run


def named(docs: DataFrame) -> DataFrame:
    """(lang, source, text) with nulls as ''."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, shards: int | None = None) -> DataFrame:
    """(lang, source, term, n, total, lead): counts of the terms in at least `least` documents of a lang; total is the lang's, lead is true in one row of a (lang, term)."""
    counts = named(docs).mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    dealt = counts.repartition(shards or partitions(docs, SHARD_MB), "lang", "term")
    return dealt.mapInArrow(_shard(_KEEP.format(least=least)), "lang string, source string, term string, n long, total long, lead boolean")


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (size + 2 * terms)), in exact decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(F.lit(UNIT)) * (wide(count) + wide(F.lit(2))), wide(size) + wide(F.lit(2)) * wide(terms)) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. docs(lang, source, text) may have nulls, which count as ''.

    Part `pair`: the divergence from each other source of the lang. Part `term`: the `top` terms that a source has more of than its
    lang. A lang without kept terms has pairs of value 0; a lang of one source has no pairs; an empty table gives an empty result. Each
    row is a document, whatever its doc_id.
    """
    terms = checkpointed(kept_terms(docs, least))
    langs = terms.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum("n").alias("size_lang"))
    sizes = terms.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    groups = named(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("size"), F.col("v")))
    groups = checkpointed(groups.withColumn("zero", zero))
    # shards: what pairs of sources have in common, and the terms that stand out
    rows = terms.join(groups.drop("own"), ["lang", "source"])
    rows = rows.select("lang", "source", "term", "zero", share(F.col("n"), F.col("size"), F.col("v")).alias("p"), share(F.col("total"), F.col("size_lang"), F.col("v")).alias("q"))
    dealt = rows.repartition(partitions(terms, SHARD_MB), "lang", "term")
    parts = checkpointed(dealt.mapInArrow(_shard(_PAIRS, _TERMS.format(top=top)), "lang string, source string, item string, both long, value long"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    shown = parts.where("both is null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    # the divergence of a source's terms from each other source, if that had none of them
    left, right = (groups.select("lang", F.col("source").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("zero", "own"))) for n in ("a", "b"))
    levels = terms.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")).join(groups, ["lang", "source"])
    levels = levels.select("lang", F.col("source").alias("a"), "terms", share(F.col("n"), F.col("size"), F.col("v")).alias("p"))
    alone = levels.join(right, "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * gap(F.col("p"), F.col("zero_b"))).alias("alone"))
    mirrored = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("alone_b"))
    common = parts.where("both is not null").groupBy("lang", F.col("source").alias("a"), F.col("item").alias("b")).agg(F.sum("both").alias("both"), F.sum("value").alias("value"))
    pairs = left.join(right, "lang").where("a < b").join(groups.select("lang", "v").distinct(), "lang")
    for other in (alone, mirrored, common):
        pairs = pairs.join(other, ["lang", "a", "b"], "left")
    neither = (F.col("v") - F.col("own_a") - F.col("own_b") + F.col("both")) * gap(F.col("zero_a"), F.col("zero_b"))
    pairs = pairs.fillna(0, ["alone", "alone_b", "both", "value"])
    every = F.col("alone") + F.col("alone_b") + F.col("value") + neither
    pairs = pairs.withColumn("all", F.coalesce(every, F.lit(0)))  # no kept terms: no shares
    both = pairs.select("lang", F.inline(F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item"), F.col("all").alias("value")) for x, y in (("a", "b"), ("b", "a"))))))
    ranked = both.withColumn("rank", F.row_number().over(best))
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(ranked, "pair").unionByName(columns(shown, "term"))
