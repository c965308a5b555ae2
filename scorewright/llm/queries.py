"""The queries of this subpackage: each operator with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import spread
from . import decontam, divergence, imatch, langid, license_rules, piece_bpe, quality, resampling, simhash, substring_dedup, token_counts, token_packs, vector_packing


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; another folder can be named by SCOREWRIGHT_TOKENIZERS."""
    if folder := os.environ.get("SCOREWRIGHT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a small table in one file is dealt out to all cores."""
    return spread(table(spark, sf_dir, "documents"), "doc_id", "text")


def crc_mod(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.learn(docs, crc_mod(4) != 2)
    return langid.identify(docs, model).select("doc_id", F.coalesce(crc_mod(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_token_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packs.digest(token_packs.pack_ids(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), ids=False).drop("ids")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_rules.scan(documents(spark, sf_dir))
    return rows.select("doc_id", "license", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"), crc_mod(3) != 1)
    return quality.score(docs, model).select("doc_id", F.coalesce(crc_mod(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id", "text"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digest(piece_bpe.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), decode=True))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: What a sequence of instruction data holds: tokens, segments, loss-bearing tokens; tokens that may stay empty.
INSTRUCTIONS = vector_packing.Limits(1024, 4, 900, spare=64)


def instruction_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 on instruction data: each assistant turn after the turn before it, under limits that all bind. doc_id is conv_id * 2^24 + turn."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    pairs = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left")
    rows = pairs.select((F.col("conv_id") * (1 << 24) + F.col("turn")).alias("doc_id"), "prompt", F.col("text").alias("answer"))
    return vector_packing.pack_pairs(rows, tokenizer_path("byte_bpe_50k.json"), INSTRUCTIONS, ids=False).drop("ids")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_language_id, op2_substring_dedup, op3_imatch, op4_token_counts, op5_token_packs, op6_vector_packing, op7_simhash, op8_decontamination, op9_license_scan, op10_quality, op11_source_divergence, op12_sentencepiece, op13_importance_resampling)
    return {f.__name__: f for f in ops} | {"instruction_packs": instruction_packs, "pipeline": _pipeline}


def license_sql() -> str:
    """op9 in DuckDB's SQL: the same normal form, table and rules; a known sentence over several pieces, as when wrapped, is not found by it."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    every = [(f, k) for k, fs in license_rules.SENTENCES.items() for f in fs]
    forms, gapped = (", ".join(f"({quote(license_rules.form_pattern(f))}, {quote(k)})" for f, k in every if bool(set("~*") & set(f)) == gap) for gap in (False, True))
    rules = ", ".join(f"({i}, {quote(name)}, {quote('>' + '>'.join(ids) + '>')})" for i, (name, ids) in enumerate(license_rules.RULES))
    return f"""
with known(form, id) as (values {forms}), gapped(form, id) as (values {gapped}), rules(n, license, needle) as (values {rules}),
cut as (select rowid as r, doc_id, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '[.;:!?]+(\\s|$)', chr(10) || '\\1', 'g'), '[\\r\\n]+', chr(10), 'g'), chr(10)) as parts
        from (select row_number() over () as rowid, doc_id, text from documents)),
parts as (select r, unnest(parts) as part, generate_subscripts(parts, 1) as i from cut),
norm as (select r, i, trim(regexp_replace(lower(part), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as form from parts),
hits as (select r, i, id from norm join known using (form) union all
         select r, i, min(id) from (select * from norm where form like '%free software%' or form like '%name%' or form like '%distributed%') n join gapped g on regexp_full_match(n.form, g.form) group by r, i),
ids as (select r, string_agg(id, '>' order by i) as line, string_agg(id, ',' order by i) as sentence_ids from hits group by r),
hit as (select r, license, min(n) as n from ids join rules on contains('>' || line || '>', needle) group by r, license),
named as (select r, string_agg(license, ',' order by n) as licenses, arg_min(license, n) as license from hit group by r)
select doc_id, license, coalesce(licenses, '') as licenses, coalesce(sentence_ids, '') as sentence_ids
from cut left join ids using (r) left join named using (r)
"""


#: op2 in DuckDB's SQL: every window as text with the smallest document that has it; a word goes if any of the 13 windows that cover it repeats.
SUBSTRING_SQL = """
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
spot as (select r, doc_id, words, unnest(range(1, len(words) - 11)) as i from docs where len(words) >= 13 and doc_id is not null),
win as (select r, doc_id, i, array_to_string(words[i : i + 12], ' ') as w from spot),
least as (select w, min(doc_id) as first_doc from win group by w),
hit as (select r, i from win join least using (w) where doc_id > first_doc),
gone as (select distinct r, i + unnest(range(13)) as i from hit),
word as (select r, unnest(words) as w, generate_subscripts(words, 1) as i from docs),
kept as (select word.r, string_agg(w, ' ' order by i) as kept from word anti join gone on word.r = gone.r and word.i = gone.i group by word.r),
lost as (select r, count(*) as n from gone group by r)
select doc_id, len(words) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join lost using (r) left join kept using (r)
"""


#: op11 in DuckDB's SQL: every kept term of a lang with every source, also where it doesn't occur.
DIVERGENCE_SQL = """
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
occ as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
kept as (select lang, term from occ group by all having count(distinct r) >= 10),
cnt as (select lang, source, term, count(*)::hugeint as n from occ join kept using (lang, term) group by all),
grp as (select distinct lang, source from docs),
dense as (select grp.lang, grp.source, kept.term, coalesce(n, 0)::hugeint as n from grp join kept using (lang) left join cnt on cnt.lang = grp.lang and cnt.source = grp.source and cnt.term = kept.term),
p1 as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * count(*) over (partition by lang, source)) as p from dense),
total as (select lang, term, sum(n) as n from dense group by all),
q1 as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * count(*) over (partition by lang)) as q from total),
div as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p1 a join p1 b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from grp a join grp b on a.lang = b.lang and a.source <> b.source
          left join div on div.lang = a.lang and div.source = a.source and div.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p1 join q1 using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRING_SQL, "op9_license_scan": license_sql(), "op11_source_divergence": DIVERGENCE_SQL}
