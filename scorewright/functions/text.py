"""Text cleaning, section and article parsing, keyword zones, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A control character that never occurs in texts marks where to cut.
MARK = "\x01"


def once(value: Column) -> Column:
    """value by a generator of one row: no later step is merged with it and no filter goes below it, so it is computed once a row."""
    return F.explode(F.array(value))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """At most one blank line, every line stripped, then the whole."""
    lines = F.split(F.regexp_replace(text, r"\n{3,}", "\n\n"), "\n")
    return strip(F.array_join(F.transform(lines, strip), "\n"))


def marked(text: Column, pattern: str) -> Column:
    """Pieces of a text, each but the first starting at a match of the pattern."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1"), MARK)


def field(text: Column, pattern: str) -> Column:
    """The first group of a pattern that may span lines; empty if absent."""
    return strip(F.regexp_extract(text, f"(?s){pattern}", 1))


def strip_think(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def last_chars(text: Column, n: int) -> Column:
    """The last n characters."""
    return F.right(text, F.lit(n))


def cut_text(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def zones(text: Column, keywords: dict[str, list[str]], least: int = 2) -> Column:
    """Zones of which at least `least` distinct keywords occur in the lower-cased text, in the given order."""
    low = F.lower(text)
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int"))
    return F.array_compact(F.array(*(F.when(hits(w) >= least, z) for z, w in keywords.items())))


#: Titles of articles that are not of substance.
SKIP_TITLES = [
    r"^Subject\s*matter$", r"^Scope$", r"^Definitions?$", r"^Amendment", r"^Repeal", r"^Entry\s*into\s*force", r"^Transitional\s*(provisions?|measures?|arrangements?)$", r"^Review$", r"^Transposition",
    r"^Addressees$", r"^Exercise\s*of\s*the\s*delegation$", r"^Committee\s*procedure$",
]
#: The highest article of substance of some regulations.
HIGHEST = {"DORA": 56, "GDPR": 91, "MiFID2": 90, "MiCA": 140, "NIS2": 41}


def skip_titles(keep: tuple[str, ...] = ()) -> str:
    """A pattern of the titles that are left out; keep: words ("Definitions", "Scope") whose titles stay."""
    return "(?i)" + "|".join(t for t in SKIP_TITLES if not any(k in t for k in keep))


def highest(regulation: Column, default: int = 999) -> Column:
    """The highest article number to keep of a regulation."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in HIGHEST.items() for x in kv))[regulation], F.lit(default))


def without_preamble(text: Column) -> Column:
    """The text from its first line `Article 1` on; whole if there is none."""
    return F.regexp_replace(text, r"(?ism)\A.*?^(?=[ \t]*Article\s+1[ \t]*$)", "")


def articles(df: DataFrame, key: str, text: str, skip_above: int | Column = 999, least: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, article_number, title, body, chapter, char_count) of the articles of a regulation text.

    An article is a line `Article n`, a title line and the body up to the next line that starts with Article and a
    number. Left out: titles that start with a digit, bracket or small letter, titles of no substance, numbers above the cap,
    short bodies. The chapter is the last heading before the article. keep: see `skip_titles`.
    """
    head = r"(?im)^[ \t]*Article\s+\d"
    pieces = df.select(key, F.posexplode(marked(F.col(text), head)).alias("at", "piece"))
    heading = F.regexp_extract_all(F.col("piece"), F.lit(r"(?m)^((?:CHAPTER|TITLE|SECTION)\s+[IVXLC\d]+[^\n]*)$"), F.lit(1))
    from pyspark.sql.window import Window

    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("chapter", F.coalesce(F.last(F.nullif(F.try_element_at(heading, F.lit(-1)), F.lit("")), True).over(before), F.lit("")))
    form = r"(?is)^\s*Article\s+(\d+[a-z]?)[ \t]*\n([^\n]+)\n(.*)$"
    rows = pieces.where(F.col("piece").rlike(form)).select(key, "at", "chapter", *(strip(F.regexp_extract("piece", form, g)).alias(n) for g, n in ((1, "article_number"), (2, "title"), (3, "body"))))
    rows = rows.withColumn("body", strip(F.regexp_replace(F.regexp_replace("body", r"--- PAGE \d+ ---", ""), r"\n{3,}", "\n\n")))
    number = F.regexp_extract("article_number", r"^(\d+)", 1).cast("int")
    ok = ~F.col("title").rlike(r"^[\d(a-z]") & (number <= skip_above) & ~F.col("title").rlike(skip_titles(keep)) & (F.char_length("body") >= least)
    return rows.where(ok).select(key, "article_number", "title", "body", "chapter", F.char_length("body").cast("long").alias("char_count"))


def render(template: str, **values: Column) -> Column:
    """A prompt with {name} places filled; other braces stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def messages(system: Column, user: Column) -> Column:
    """Chat messages without empty ones."""
    both = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return F.filter(both, lambda m: F.char_length(F.coalesce(m["content"], F.lit(""))) > 0)
