"""Text, HTML and model-reply queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import judgejson as J
from ..functions import text as T
from ..operators.records import article_pairs
from ..registry import query
from ..sources.views import table

#: Keywords of three zones, frequent words of the synthetic prose.
ZONES = {"romance": ["que", "los", "ción", "les"], "german": ["der", "und", "keit", "ung"], "english": ["that", "with", "tion", "from"]}


@query("""select doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10)), '^\\s+|\\s+$', '', 'g') as text from documents""")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


def _zone_sql() -> str:
    hits = lambda ws: " + ".join(f"contains(lower(text), '{w}')::int" for w in ws)
    return ", ".join(f"case when {hits(w)} >= 2 then '{z}' end" for z, w in ZONES.items())


@query(f"select doc_id, array_to_string(list_filter([{_zone_sql()}], lambda x: x is not null), ',') as zones from documents")
def keyword_zones(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.zones(F.col("text"), ZONES), ",").alias("zones"))


ARTICLES_SQL = "a as (select l_orderkey as zone, l_returnflag as regulation, l_partkey as id from lineitem)"


def _articles(spark, sf_dir):
    """Articles of regulations in zones: the lines of orders, so that zones are many and small at any scale."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("zone"), F.col("l_returnflag").alias("regulation"), F.col("l_partkey").alias("id"))


@query(f"""with {ARTICLES_SQL} select a.zone, a.regulation || '_Art' || a.id || '_x_' || b.regulation || '_Art' || b.id as pair_id from a join a b on a.zone = b.zone and a.regulation < b.regulation""")
def zone_pairs(spark, sf_dir):
    """Article pairs of different regulations within a zone that involves two or more: an equi-join on the zone."""
    return article_pairs(_articles(spark, sf_dir), "zone", "regulation", "id").select("zone", "pair_id")


@query(f"with {ARTICLES_SQL} select zone, regulation, array_to_string(list(cast(id as varchar) order by id), ',') as articles, count(*) as n from a group by zone, regulation")
def zone_lists(spark, sf_dir):
    """Ordered article lists by zone and regulation."""
    a = _articles(spark, sf_dir).groupBy("zone", "regulation")
    return a.agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("articles"), F.count("*").alias("n"))


#: A regulation for each supplier: preamble, chapters and articles, of which some are to be left out.
_BODY = "The entity shall report within {n} days. " * 4
REGULATION = (
    "Preamble of act {n}\nCHAPTER I General\nArticle 1\nScope\n" + _BODY + "\nArticle 2\nReporting duties\n" + _BODY + "\n--- PAGE 3 ---\nArticle 5 of another act is meant.\nCHAPTER II Special\n"
    "Article 3a\nOversight\n" + _BODY + "\n\n\n\nmore\nArticle 4\nlower title\n" + _BODY + "\nArticle 5\nShort\nToo short.\nArticle 950\nLate matters\n" + _BODY
)


@query(f"""with t as (select s_suppkey as id, replace('{REGULATION}', '{{n}}', cast(s_suppkey as varchar)) as t from supplier),
p as (select id, unnest(string_split(regexp_replace(t, '(?im)^([ \\t]*Article\\s+\\d)', chr(1) || '\\1', 'g'), chr(1))) as piece, generate_subscripts(string_split(regexp_replace(t, '(?im)^([ \\t]*Article\\s+\\d)', chr(1) || '\\1', 'g'), chr(1)), 1) as pos from t),
c as (select *, coalesce(last_value(nullif(list_last(regexp_extract_all(piece, '(?m)^((?:CHAPTER|TITLE|SECTION)\\s+[IVXLC\\d]+[^\\n]*)$', 1)), '') ignore nulls) over (partition by id order by pos rows between unbounded preceding and 1 preceding), '') as chapter from p),
f as (select id, chapter, trim(regexp_extract(piece, '(?is)^\\s*Article\\s+(\\d+[a-z]?)[ \\t]*\\n([^\\n]+)\\n(.*)$', 1)) as article_number, trim(regexp_extract(piece, '(?is)^\\s*Article\\s+(\\d+[a-z]?)[ \\t]*\\n([^\\n]+)\\n(.*)$', 2)) as title,
 regexp_replace(regexp_replace(regexp_replace(regexp_extract(piece, '(?is)^\\s*Article\\s+(\\d+[a-z]?)[ \\t]*\\n([^\\n]+)\\n(.*)$', 3), '--- PAGE \\d+ ---', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as body
 from c where regexp_matches(piece, '(?is)^\\s*Article\\s+(\\d+[a-z]?)[ \\t]*\\n([^\\n]+)\\n(.*)$'))
select id, article_number, title, body, chapter, length(body) as char_count from f where not regexp_matches(title, '^[\\d(a-z]') and cast(regexp_extract(article_number, '^(\\d+)', 1) as int) <= 900
and not regexp_matches(title, '(?i){"|".join(T.SKIP_TITLES)}') and length(body) >= 100""")
def article_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.replace(F.lit(REGULATION), F.lit("{n}"), F.col("s_suppkey").cast("string")).alias("t"))
    return T.articles(rows, "id", "t", skip_above=900)


QA = "header\nSubmission Date\nESMA_QA_{n}\nSubject Matter\nReports {n}\nQuestion\nMust entity {n} report?\nESMA Answer\nYes, it must.\nSubmission Date\nESMA_QA_9{n}\nSubject Matter\nOther\nQuestion\nAnd then?\n"


@query(f"""with s as (select s_suppkey as id, unnest(string_split(regexp_replace(replace('{QA}', '{{n}}', cast(s_suppkey as varchar)), '(Submission Date\\s*\\n\\s*ESMA_QA_\\d+)', chr(1) || '\\1', 'g'), chr(1))) as x from supplier)
select id, regexp_extract(x, 'ESMA_QA_\\d+') as qa_id, trim(regexp_extract(x, '(?s)Subject Matter\\n(.*?)\\nQuestion', 1)) as subject, trim(regexp_extract(x, '(?s)\\nQuestion\\n(.*?)\\nESMA Answer', 1)) as question,
trim(regexp_extract(x, '(?s)ESMA Answer\\n(.*)', 1), chr(10) || ' ') as answer from s where x like 'Submission Date%' and contains(x, 'ESMA Answer')""")
def section_split(spark, sf_dir):
    """Question sections of a page text, with fields between markers; sections without an answer go."""
    t = F.replace(F.lit(QA), F.lit("{n}"), F.col("s_suppkey").cast("string"))
    x = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(T.marked(t, r"Submission Date\s*\n\s*ESMA_QA_\d+")).alias("x"))
    x = x.where(F.col("x").startswith("Submission Date") & F.contains("x", F.lit("ESMA Answer")))
    f = lambda p: T.field(F.col("x"), p)
    return x.select("id", F.regexp_extract("x", r"ESMA_QA_\d+", 0).alias("qa_id"), f(r"Subject Matter\n(.*?)\nQuestion").alias("subject"), f(r"\nQuestion\n(.*?)\nESMA Answer").alias("question"), f(r"ESMA Answer\n(.*)").alias("answer"))


@query("""select page_id, link, cast(min(i) as int) as first_at from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as link, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) as i from pages) group by page_id, link""")
def html_links(spark, sf_dir):
    """Distinct links of each page with the place of the first."""
    x = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("i", "link"))
    return x.groupBy("page_id", "link").agg((F.min("i") + 1).alias("first_at"))


@query("""select page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title, coalesce(list_max(list_transform(regexp_extract_all(html, 'page=(\\d+)', 1), lambda x: cast(x as int))), 0) as last_page,
length(regexp_replace(html, '(?is)<[^>]*>', '', 'g')) as text_chars from pages""")
def html_fields(spark, sf_dir):
    """Title, last page number of a pager (0 without one) and length of the text without tags."""
    pages = F.transform(F.regexp_extract_all("html", F.lit(r"page=(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.coalesce(F.array_max(pages), F.lit(0)).alias("last_page"), F.char_length(F.regexp_replace("html", r"(?is)<[^>]*>", "")).cast("long").alias("text_chars"))


def replies(spark, sf_dir):
    """Model replies made from events: fenced, wrapped in prose, nested, cut off, or with a trailing comma."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5 + 1).cast("int").cast("string").alias("s"), (F.col("event_id") % 6).alias("k"))
    good = F.concat(F.lit('{"accuracy": '), "s", F.lit(', "completeness": 3, "topic_coherence": 4, "citation_quality": '), "s", F.lit(', "reasoning": {"accuracy": "ok"}}'))
    old = F.concat(F.lit('{"accuracy": '), "s", F.lit(', "completeness": 3, "clarity": 2, "overall": 4}'))
    text = F.when(F.col("k") == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(F.col("k") == 1, F.concat(F.lit("Here: {}. Then "), good, F.lit(" done"))).when(F.col("k") == 2, F.concat(good, F.lit(" or "), F.replace(good, F.lit('"completeness": 3'), F.lit('"completeness": true'))))
    text = text.when(F.col("k") == 3, F.substring(good, 1, 40)).when(F.col("k") == 4, F.concat(F.lit("x "), old, F.lit(" y"))).otherwise(F.concat(F.substring(old, 1, 30), F.lit(",}")))
    return e.select("event_id", text.alias("reply"))


_KEYS = "select event_id, (event_id % 5 + 1)::varchar as s, event_id % 6 as k from events"
_GOOD = """'{"accuracy": ' || s || ', "completeness": 3, "topic_coherence": 4, "citation_quality": ' || s || ', "reasoning": {"accuracy": "ok"}}'"""
_OLD = """'{"accuracy": ' || s || ', "completeness": 3, "clarity": 2, "overall": 4}'"""


@query(f"""select event_id, case when k in (0, 1) then {_GOOD} when k = 2 then replace({_GOOD}, '"completeness": 3', '"completeness": true') end as scores from ({_KEYS})""")
def parse_scores_last(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", J.scores_udf("last")("reply").alias("scores"))


@query(f"select event_id, case when k in (0, 1, 2) then {_GOOD} end as scores from ({_KEYS})")
def parse_scores_first(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", J.scores_udf("first")("reply").alias("scores"))


@query(f"select event_id, case when k = 4 then {_OLD} end as scores from ({_KEYS})")
def parse_scores_flat(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", J.scores_udf("flat")("reply").alias("scores"))


@query(f"""select event_id, case k when 0 then '{{"accuracy": ' || s || ', "citation_quality": ' || s || ', "completeness": 3, "reasoning": {{"accuracy": "ok"}}, "topic_coherence": 4}}'
 when 4 then '{{"accuracy": ' || s || ', "clarity": 2, "completeness": 3, "overall": 4}}' end as json from ({_KEYS})""")
def json_repair(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", J.repair_udf("reply").alias("json"))


@query("""select conv_id, turn, 'Role: ' || role || chr(10) || 'Question: ' || case when length(text) > 80 then substr(text, 1, 80) || '...' else text end || chr(10) || 'Score {1-5}.' as prompt, case when role = 'system' then 1 else 2 end as n_messages from conversations""")
def prompt_render(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    prompt = T.render("Role: {role}\nQuestion: {question}\nScore {1-5}.", role=F.col("role"), question=T.cut_text(F.col("text"), 80))
    chat = T.messages(F.when(F.col("role") == "system", "").otherwise("Be strict."), prompt)
    return rows.select("conv_id", "turn", prompt.alias("prompt"), F.size(chat).alias("n_messages"))
