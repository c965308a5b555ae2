"""Deliberate errors in cited texts. Random choices are integer functions of (id, seed), so rows are independent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .citations import INSTRUMENTS, span_instrument, with_spans

#: Fabricated claims.
CLAIMS = [
    "Notably, this requirement was permanently waived for institutions headquartered outside the EU following the latest amendment.",
    "It should also be noted that the relevant competent authority may, at its sole discretion, exempt branches with fewer than 50 employees from this obligation.",
    "This obligation does not apply during the first three years following the entity's initial authorisation.",
    "In practice, supervisory guidance has confirmed that this provision is no longer enforced following the 2021 simplification package.",
    "This requirement was subsequently superseded by a transitional carve-out applicable to all subsidiaries established before 2018.",
]
#: Fixed value: the invented citation.
INVENTED = " This conclusion is further reinforced by Regulation (EU) No {act}, Article {article}, which explicitly mandates additional disclosure requirements not otherwise referenced here."


def pick(key: Column, n: Column | int, salt: int) -> Column:
    """A number 0..n-1 for each key."""
    return F.try_mod(F.pmod(key.cast("long") * 48271 + salt * 7919, F.lit(2147483647)), F.lit(n) if isinstance(n, int) else n).cast("int")


def splice(text: Column, spans: Column) -> Column:
    """The text with spans struct(start, end, new) replaced, from right to left."""
    return F.aggregate(F.reverse(spans), text, lambda t, s: F.concat(F.substr(t, F.lit(1), s["start"]), s["new"], F.substr(t, s["end"] + 1, F.char_length(t))))


def law_swap(df: DataFrame, text: str, key: str, out: str, salt: int = 1) -> DataFrame:
    """Every mention of the most frequent instrument (the first among equals) becomes another one; null if there is none."""
    df = with_spans(df, text, "_s").withColumn("_laws", F.transform(F.filter("_s", lambda s: s["kind"] != "article"), lambda s: F.struct(s.alias("s"), span_instrument(s).alias("i"))))
    df = df.withColumn("_names", F.transform("_laws", lambda x: x["i"]))
    ranked = F.array_sort(F.transform("_names", lambda n, i: F.struct((-F.size(F.filter("_names", lambda m: m == n))).alias("n"), i.alias("at"), n.alias("name"))))
    df = df.withColumn("_target", F.get(ranked, F.lit(0))["name"])
    names = F.array(*map(F.lit, INSTRUMENTS))
    df = df.withColumn("_others", F.filter(names, lambda a: a != F.col("_target")))
    df = df.withColumn("_new", F.get("_others", pick(F.col(key), F.size("_others"), salt)))
    full = F.create_map(*(F.lit(x) for kv in INSTRUMENTS.items() for x in kv))[F.col("_new")]
    cut = F.transform(F.filter("_laws", lambda x: x["i"] == F.col("_target")), lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), F.when(x["s"]["kind"] == "acronym", F.col("_new")).otherwise(full).alias("new")))
    return df.withColumn(out, F.when(F.size("_laws") > 0, splice(F.col(text), cut))).drop("_s", "_laws", "_names", "_target", "_others", "_new")


def article_swap(df: DataFrame, text: str, key: str, out: str, salt: int = 2) -> DataFrame:
    """Article numbers shifted in a circle; a single one becomes another of 1 to 600. Null if there is none."""
    df = with_spans(df, text, "_s").withColumn("_arts", F.filter("_s", lambda s: s["kind"] == "article"))
    df = df.withColumn("_old", F.array_distinct(F.transform("_arts", lambda s: s["g1"])))
    number = F.try_to_number(F.regexp_replace(F.get("_old", F.lit(0)), "[a-zA-Z]", ""), F.lit("9999999999")).cast("int")
    other = F.pmod(F.coalesce(number, F.lit(0)) + pick(F.col(key), 599, salt), F.lit(600)) + 1
    df = df.withColumn("_new", F.when(F.size("_old") >= 2, F.concat(F.slice("_old", 2, F.greatest(F.size("_old") - 1, F.lit(1))), F.slice("_old", 1, 1))).otherwise(F.array(other.cast("string"))))

    def cut(s: Column) -> Column:
        at = s["start"] + F.instr(s["text"], s["g1"]) - 1
        return F.struct(at.alias("start"), (at + F.char_length(s["g1"])).alias("end"), F.get("_new", (F.array_position("_old", s["g1"]) - 1).cast("int")).alias("new"))

    return df.withColumn(out, F.when(F.size("_arts") > 0, splice(F.col(text), F.transform("_arts", cut)))).drop("_s", "_arts", "_old", "_new")


def hallucinate_citation(text: Column, key: Column, salt: int = 3) -> Column:
    act = F.concat((9000 + pick(key, 1000, salt)).cast("string"), F.lit("/"), (2030 + pick(key, 70, salt + 10)).cast("string"))
    article = (500 + pick(key, 500, salt + 20)).cast("string")
    return F.concat(F.regexp_replace(text, r"\s+$", ""), F.replace(F.replace(F.lit(INVENTED), F.lit("{act}"), act), F.lit("{article}"), article))


def hallucinate_text(text: Column, key: Column, salt: int = 4) -> Column:
    return F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(" "), F.get(F.array(*map(F.lit, CLAIMS)), pick(key, len(CLAIMS), salt)))


def combined(df: DataFrame, text: str, key: str, out: str, applied: str) -> DataFrame:
    """All corruptions in order, and the list of those that changed the text; null text and empty list if none did."""
    df = law_swap(df, text, key, "_a").withColumn("_b0", F.coalesce("_a", text))
    df = article_swap(df, "_b0", key, "_b").withColumn("_c", F.coalesce("_b", "_b0"))
    done = F.array_compact(F.array(F.when(F.col("_a") != F.col(text), "law_swap"), F.when(F.col("_b") != F.col("_b0"), "article_swap"), F.lit("hallucinate_citation"), F.lit("hallucinate_text")))
    return df.withColumn(applied, done).withColumn(out, hallucinate_text(hallucinate_citation(F.col("_c"), F.col(key)), F.col(key))).drop("_a", "_b0", "_b", "_c")
