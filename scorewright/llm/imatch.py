"""I-Match document fingerprints, in DataFrame functions only.

Terms are runs of letters and digits in lower case. The lexicon holds the terms whose document frequency lies in a band
(inverse document frequency neither low nor high). A fingerprint has one hash for each of several randomised lexicon
subsets: the document's distinct terms in that subset, sorted and hashed. Subsets keep 1/16 down to 1/1024 of the
lexicon, so that texts of any length have a few terms in some. A short text may have no term in any: then all its hashes are that of
all its lexicon terms, or of all its terms if none is in the lexicon. The likeness of two fingerprints is the share of equal
hashes among subsets that keep a term of either text.

Document frequencies are counted for each term. The band's terms are bounded by the band's lower end: a document with T distinct terms on
average leaves T / `LEAST` terms at most in it, at any corpus size. They are carried as a literal bit map of 32 bits or more for each
term (`MOST_BITS` at most, for 2^21 terms), so that of the terms outside the band one in 32 or fewer shares a bit
and is taken for one inside, alike in every text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import checkpointed, partitions

#: Bits of the map, and bits for each term.
LEAST_BITS, MOST_BITS, BITS = 1 << 20, 1 << 26, 32
#: Band of df / documents: idf = -ln of it lies between 2.3 and 9.2.
LEAST, MOST = 1e-4, 0.1
#: Randomised subsets: (first bit, bits of the term hash that must be 0).
SHIFTS, ZEROS = tuple(range(0, 48, 6)), (4, 6, 8, 10)
#: Spark's hash of an empty array: its seed.
NONE = 42
#: Ranges of neighbours for each partition, and at most; sampled keys for each range, and at most.
RANGES, MOST_RANGES, KEYS, MOST_KEYS = 8, 1 << 17, 8, 1 << 20
KEY = "array<struct<known:boolean,id:bigint,h:bigint>>"


def term_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def band(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(h) of the terms whose document frequency lies in the band; a term that only one document has is in it if one document is enough."""
    total = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col("text").cast("string"))).alias("h")).groupBy("h").count()
    return terms.where((F.col("count") >= least * total) & (F.col("count") <= max(most * total, 1.0))).select("h")


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> tuple[Column, int]:
    """A literal array of longs with a bit for each place of a band's term, and its number of bits (a power of two)."""
    terms = checkpointed(band(docs, least, most))
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS * terms.count()):
        size *= 2
    at = terms.select(place(F.col("h"), size).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).collect()  # MOST_BITS / 64 rows at most
    bits = [0] * (size // 64)
    for r in words:
        bits[r["w"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>"), size  # folded to one literal


def place(h: Column, size: int) -> Column:
    return F.shiftrightunsigned(h, 38).bitwiseAND(F.lit(size - 1))


def fingerprint(rows: DataFrame, text: str, out: str, known: tuple[Column, int]) -> DataFrame:
    """rows with a column `out`, array<long>: a hash for each subset, by first bit and then by size, NONE where the subset keeps no term.

    Where no subset keeps one, each has the hash of all lexicon terms, else of all terms; NONE only for a text without terms.
    """
    bits, size = known
    inside = lambda h: F.call_function("getbit", F.get(bits, F.shiftright(place(h, size), 6).cast("int")), place(h, size).bitwiseAND(F.lit(63)).cast("int")) == 1
    rows = rows.withColumn("_terms", F.array_sort(F.filter(term_hashes(F.col(text)), inside)))  # a step of its own: Catalyst computes it once
    rows = rows.withColumns({f"_at{s}": subset("_terms", s, ZEROS[0]) for s in SHIFTS})  # the smaller subsets of a first bit are parts of its largest
    rows = rows.withColumn(out, F.array(*(F.xxhash64(subset(f"_at{s}", s, n)) for s in SHIFTS for n in ZEROS)))
    whole = F.when(F.size("_terms") > 0, F.xxhash64("_terms")).otherwise(F.xxhash64(F.array_sort(term_hashes(F.col(text)))))
    return rows.withColumn(out, F.when(F.exists(out, lambda h: h != NONE), F.col(out)).otherwise(F.array_repeat(whole, len(SHIFTS) * len(ZEROS)))).drop("_terms", *(f"_at{s}" for s in SHIFTS))


def subset(terms: str, shift: int, zeros: int) -> Column:
    return F.filter(terms, lambda h: h.bitwiseAND(F.lit(((1 << zeros) - 1) << shift)) == 0)


def shown(fingerprint: Column) -> Column:
    """16 hex digits for each subset."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among subsets that keep a term of either; 1 if none does."""
    used = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: (x["a"] != NONE) | (x["b"] != NONE))
    return F.coalesce(F.try_divide(F.size(F.filter(used, lambda x: x["a"] == x["b"])).cast("double"), F.size(used)), F.lit(1.0))


def limits(rows: DataFrame, ranges: int) -> list[tuple[bool, int, int]]:
    """Keys that cut rows(key) into about equal ranges, descending, the highest key first; from a sample of the keys by their hash."""
    want = min(KEYS * ranges, MOST_KEYS)
    rate = F.lit(int(min(1.0, want / max(1, rows.count())) * (1 << 30)))
    chosen = F.when(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < rate, F.col("key"))
    top, some = rows.agg(F.max("key"), F.collect_set(chosen)).first()  # about `want` keys
    if top is None:
        return [(False, 0, 0)]
    keys = sorted({tuple(k) for k in some} - {tuple(top)}, reverse=True)
    step = max(1, -(-len(keys) // ranges))
    return [tuple(top), *keys[step - 1 :: step]]


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, own) with next_text and next_own of the next row by descending doc_id; after the last, the first.

    Rows with one doc_id follow by descending hash of the text, null ids come last. Rows are dealt into ranges of
    these keys (`limits`), about equal in rows whatever the ids. A limit is the highest key of its range: the rows that
    have it are also sent to the range before, as the neighbours of its last row. Only rows that repeat whole can't be
    parted. Limits are few (`MOST_RANGES`) and go with the plan.
    """
    n = partitions(docs)
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    cuts = limits(docs.select(key.alias("key")), min(RANGES * n, MOST_RANGES))
    literal = F.from_json(F.lit(json.dumps([dict(zip(("known", "id", "h"), k, strict=True)) for k in cuts])), KEY)
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))))
    # the last limit that is not below the key, by binary search
    rows = docs.withColumn("k", key).withColumn("c", F.aggregate(steps, F.lit(0), lambda p, s: F.when(F.get(literal, p + s) >= F.col("k"), p + s).otherwise(p)))
    before = F.when(F.col("c") > 0, F.col("c") - 1).otherwise(F.lit(len(cuts) - 1))
    ghost = F.when(F.get(literal, F.col("c")) == F.col("k"), F.struct(before.alias("c"), F.lit(True).alias("ghost")))
    copies = F.array_compact(F.array(F.struct(F.col("c").alias("c"), F.lit(False).alias("ghost")), ghost))
    placed = rows.select(F.explode(copies).alias("at"), "k", "doc_id", "text", "own").select("at.c", "at.ghost", "k", "doc_id", "text", "own").repartition(n, "c")
    w = Window.partitionBy("c").orderBy("ghost", F.desc("k"))
    return placed.withColumns({"next_text": F.lead("text").over(w), "next_own": F.lead("own").over(w)}).where("not ghost").drop("c", "ghost", "k")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document (`with_next`; a single row is its own next). Null texts count as empty. Only texts without terms have an all-empty fingerprint, which is
    like any other such (likeness 1). Equal texts have equal fingerprints. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = lexicon(own)
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(char_length(text) / 2) as int))"))
    rows = fingerprint(with_next(fingerprint(own, "text", "own", known)).withColumn("edited", edited), "edited", "other", known)
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"),
        shown(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
