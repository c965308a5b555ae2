"""Citation queries over texts made from part keys, which hold the known traps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import corruptions as X
from ..registry import query
from ..sources.views import JUDGMENTS_SQL, judgments, spread, table

#: {n}: a number from the key.
TEMPLATES = [
    "Under Regulation (EU) No 575/2013 (CRR), Article {n}(2)(c) applies.",
    "See Article {n} (CRR) and Directive 2013/36/EU.",
    "part {n} of the text in Mar, then MiFID II and art. {n}a (1) (b).",
    "CRD IV differs from Directive 2013/36/eu; Article {n} of the former.",
    "Regulation (EU) 2019/876 and Regulation 2020/1503 say nothing.",
    "No citation here.",
    "",
    "EBA/GL/2017/12 and Article {n}; Article {n}(1); Article 7 of EMIR, Article 7.",
    "UCITS V, AIFMD and UCITS; Directive 2009/65/EC Article {n}(4).",
    "Article 5 before any act. Regulation (EU) No. 600/2014, Art 39a(2).",
    "DORA Article {n}, PSD2 Article 97 (1) (a), DORA Article {n}.",
]
N = len(TEMPLATES)


def _case_sql(index: str) -> str:
    rows = " ".join(f"when {i} then replace('{t}', '{{n}}', cast(1 + p_partkey % 400 as varchar))" for i, t in enumerate(TEMPLATES))
    return f"case {index} {rows} end"


def _template(index):
    texts = F.array(*map(F.lit, TEMPLATES))
    return F.replace(F.get(texts, index.cast("int")), F.lit("{n}"), (1 + F.col("p_partkey") % 400).cast("string"))


def texts(spark, sf_dir):
    """(id, candidate, truth, act) by part key."""
    parts = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    k = F.col("p_partkey")
    return parts.select(k.alias("id"), _template(k % N).alias("candidate"), _template(F.floor(k / 3) % N).alias("truth"), _template(F.floor(k / 2) % 3).alias("act"))


TEXTS_SQL = f"texts as (select p_partkey as id, {_case_sql(f'(p_partkey % {N})')} as candidate, {_case_sql(f'(p_partkey // 3 % {N})')} as truth, {_case_sql('(p_partkey // 2 % 3)')} as act from part)"


def _spans_sql(source: str) -> str:
    """Spans of source(id, what, t) by split and extract, one branch for each pattern."""
    parts = []
    for rank, (kind, p) in enumerate(C.PATTERNS):
        groups = ", ".join(f"nullif(regexp_extract_all(t, '(?i){p}', {g})[i], '') as g{g}" if g == 1 or kind == "article" else f"null::varchar as g{g}" for g in (1, 2, 3))
        parts.append(
            f"select id, what, {rank} as rank, '{kind}' as kind, m[i] as text, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as start, {groups} "
            f"from (select *, unnest(range(1, len(m) + 1)) as i from (select id, what, t, regexp_extract_all(t, '(?i){p}') as m, string_split_regex(t, '(?i){p}') as gaps from {source}))"
        )
    return " union all ".join(parts)


def _named_sql() -> str:
    acronyms = ", ".join(f"'{a}'" for a in C.INSTRUMENTS)
    numbers = ", ".join(f"('{n}', '{a}')" for n, a in C.NUMBERS.items())
    return f"""numbers(num, acr) as (values {numbers}),
named as (select s.*, case kind when 'article' then null when 'guideline' then upper(g1) when 'acronym' then upper(regexp_replace(g1, '[\\s\\-]+', '', 'g'))
  else case when upper(replace(g1, ' ', '')) in ({acronyms}) then upper(replace(g1, ' ', '')) else coalesce(acr, g1) end end as own from spans s left join numbers on num = g1 and kind in ('regulation_eu', 'regulation_short', 'directive')),
carried as (select *, coalesce(last_value(own ignore nulls) over (partition by id, what order by start, rank rows between unbounded preceding and current row), '') as instrument from named),
cites as (select id, what, start, rank, upper(replace(instrument, ' ', '')) as inst, upper(replace(instrument, ' ', '')) || case when kind = 'article' then ':art' || lower(g1) || coalesce(':(' || g2 || ')', '') || coalesce(':(' || lower(g3) || ')', '') else '' end as key from carried)"""


LONG_SQL = f"{TEXTS_SQL}, long as (select id, 'candidate' as what, candidate as t from texts union all select id, 'truth', truth from texts union all select id, 'act', act from texts), spans as ({_spans_sql('long')})"


@query(f"with {LONG_SQL} select id, cast(start as int) as start, kind, text, g1, g2, g3 from spans where what = 'candidate'")
def cite_spans(spark, sf_dir):
    s = C.with_spans(texts(spark, sf_dir), "candidate", "s").select("id", F.explode("s").alias("s"))
    return s.select("id", "s.start", "s.kind", "s.text", "s.g1", "s.g2", "s.g3")


@query(f"with {LONG_SQL}, {_named_sql()} select id, key from cites where what = 'candidate' group by id, key")
def cite_keys(spark, sf_dir):
    c = C.with_citations(texts(spark, sf_dir), "candidate", "c")
    return c.select("id", F.explode(C.keys(F.col("c"))).alias("key"))


def _scores_sql(key: str, truth: str, source: str = "cites") -> str:
    return f"""select id, t, f, coalesce(hit, 0) as hit from (select id, (select count(distinct {key}) from {source} c where c.id = texts.id and what = '{truth}') as t, (select count(distinct {key}) from {source} c where c.id = texts.id and what = 'candidate') as f,
 (select count(distinct a.{key}) from {source} a join {source} b on a.id = b.id and a.{key} = b.{key} where a.id = texts.id and a.what = '{truth}' and b.what = 'candidate') as hit from texts)"""


def _f1_sql(s: str) -> str:
    return f"case when {s}.t = 0 and {s}.f = 0 then 1.0::double when {s}.hit = 0 then 0.0::double else 2.0::double * {s}.hit / ({s}.t + {s}.f) end"


def _prf(s: str) -> str:
    p = f"case when {s}.t = 0 and {s}.f = 0 then 1.0::double when {s}.f = 0 then 0.0::double else {s}.hit::double / {s}.f end"
    r = f"case when {s}.t = 0 and {s}.f = 0 then 1.0::double when {s}.t = 0 then 0.0::double else {s}.hit::double / {s}.t end"
    return ", ".join(f"round(avg({x}), 4) as {s}_{n}" for n, x in (("precision", p), ("recall", r), ("f1", _f1_sql(s))))


@query(f"""with {LONG_SQL}, {_named_sql()}, instrument as ({_scores_sql("inst", "act")}), full_ as ({_scores_sql("key", "truth")})
select case when instrument.id % 2 = 0 then 'EBA' else 'ESMA' end as regulator, case when instrument.id % 3 = 0 then 'F' else 'O' end as answerer, count(*) as n, {_prf("instrument")}, {_prf("full_")}
from instrument join full_ using (id) group by 1, 2""")
def cite_scores(spark, sf_dir):
    """Mean precision, recall and F1: instruments against the act, full keys against the reference answer."""
    rows = texts(spark, sf_dir)
    for name in ("candidate", "truth", "act"):
        rows = C.with_citations(rows, name, f"c_{name}")
    rows = rows.withColumn("instrument_", C.set_scores(C.instruments(F.col("c_act")), C.instruments(F.col("c_candidate")))).withColumn("full__", C.set_scores(C.keys(F.col("c_truth")), C.keys(F.col("c_candidate"))))
    means = [F.round(F.avg(f"{g}_.{m}"), 4).alias(f"{g}_{m}") for g in ("instrument", "full_") for m in ("precision", "recall", "f1")]
    return rows.groupBy(F.when(F.col("id") % 2 == 0, "EBA").otherwise("ESMA").alias("regulator"), F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("answerer")).agg(F.count("*").alias("n"), *means)


F1_SQL = f"""{LONG_SQL}, {_named_sql()}, raws as (select distinct id, what, lower(trim(text)) as k from spans), keyed as (select distinct id, what, key as k from cites where key <> ''),
raw as ({_scores_sql("k", "truth", "raws")}), norm as ({_scores_sql("k", "truth", "keyed")}), f1 as (select raw.id, {_f1_sql("raw")} as raw_f1, {_f1_sql("norm")} as key_f1 from raw join norm using (id))"""


@query(f"with {F1_SQL} select id, round(raw_f1, 9) as raw_f1, round(key_f1, 9) as key_f1 from f1")
def cite_f1_raw_vs_norm(spark, sf_dir):
    """F1 of raw span strings beside F1 of normalised keys."""
    return _f1(spark, sf_dir).select("id", F.round("raw_f1", 9).alias("raw_f1"), F.round("key_f1", 9).alias("key_f1"))


def _f1(spark, sf_dir):
    rows = texts(spark, sf_dir)
    for name in ("candidate", "truth"):
        rows = C.with_citations(C.with_spans(rows, name, f"s_{name}"), name, f"c_{name}")
    some = lambda c: F.filter(C.keys(F.col(c)), lambda k: k != "")
    both = F.struct(C.set_scores(C.span_strings(F.col("s_truth")), C.span_strings(F.col("s_candidate")))["f1"].alias("raw_f1"), C.set_scores(some("c_truth"), some("c_candidate"))["f1"].alias("key_f1"))
    return rows.select("id", F.explode(F.array(both)).alias("x")).select("id", "x.*")  # a filter on the scores stays above: pushed below, it would repeat all their expressions


@query(f"""with {F1_SQL}, {JUDGMENTS_SQL} select question_id, answerer, judge, round(raw_f1, 6) as raw_f1, citation_quality from judgments join f1 on id = question_id
where raw_f1 < 0.1 and citation_quality >= 3 order by citation_quality desc, question_id, answerer, judge limit 10""")
def low_f1_high_score(spark, sf_dir):
    """The report's ten judgments that praise citations which hardly overlap with the reference answer's."""
    rows = judgments(spark, sf_dir).join(_f1(spark, sf_dir).withColumnRenamed("id", "question_id"), "question_id").where("raw_f1 < 0.1 and citation_quality >= 3")
    return rows.orderBy(F.desc("citation_quality"), "question_id", "answerer", "judge").limit(10).select("question_id", "answerer", "judge", F.round("raw_f1", 6).alias("raw_f1"), "citation_quality")


@query(f"""with {LONG_SQL}, {_named_sql()} select id, key, arg_min(case when kind = 'article' then case when instrument = '' then '' else instrument || ' ' end || 'Art ' || g1 || coalesce('(' || g2 || ')', '') || coalesce('(' || g3 || ')', '') else instrument end, start * 10 + rank) as shown
from (select c.id, c.what, c.key, n.* exclude (id, what) from carried n join (select id, what, start, rank, key from cites) c on c.id = n.id and c.what = n.what and c.start = n.start and c.rank = n.rank) where what = 'candidate' group by id, key""")
def cite_shown(spark, sf_dir):
    """Each citation as it is shown to readers."""
    c = C.with_citations(texts(spark, sf_dir), "candidate", "c")
    return c.select("id", F.explode("c").alias("c")).select("id", "c.key", C.shown(F.col("c")).alias("shown"))


def _pick_of(key: str, n: str, salt: int) -> str:
    return f"((({key} * 48271 + {salt * 7919}) % 2147483647) % {n})"


def _law_swap_sql(source: str, name: str) -> str:
    """CTEs that end in `name`(id, t, corrupted) for source(id, what, t): laws, the most frequent one, another in its place, the text put together again."""
    acronyms, full = ", ".join(f"'{a}'" for a in C.INSTRUMENTS), ", ".join(f"('{a}', '{n}')" for a, n in C.INSTRUMENTS.items())
    return f"""{name}_laws as (select id, start, start + length(text) as stop, kind, own, start * 10 + rank as "at" from named where kind <> 'article' and what = 'candidate'),
{name}_ranked as (select id, own, row_number() over (partition by id order by n desc, "at") as k from (select id, own, count(*) as n, min("at") as "at" from {name}_laws group by id, own)),
{name}_new as (select id, own, list_filter([{acronyms}], lambda a: a <> own) as others from {name}_ranked where k = 1),
{name}_pick as (select id, own, others[1 + {_pick_of("id", "len(others)", 1)}] as acr from {name}_new),
{name}_full(acr, full_name) as (values {full}),
{name}_cut as (select l.id, start, stop, case when kind = 'acronym' then p.acr else full_name end as new, coalesce(lag(stop) over (partition by l.id order by start), 0) as prev from {name}_laws l join {name}_pick p on p.id = l.id and p.own = l.own join {name}_full f on f.acr = p.acr),
{name} as (select s.id, s.t, (select string_agg(substr(s.t, cast(prev + 1 as bigint), cast(start - prev as bigint)) || new, '' order by start) || substr(s.t, cast(max(stop) + 1 as bigint)) from {name}_cut c where c.id = s.id) as corrupted from {source} s where s.what = 'candidate')"""


def _article_swap_sql(source: str, name: str, spans: str) -> str:
    """The same for article numbers: shifted in a circle, or a single one replaced."""
    return f"""{name}_arts as (select id, start + strpos(text, g1) - 1 as start, g1, start * 10 + rank as "at" from {spans} where kind = 'article' and what = 'candidate'),
{name}_old as (select id, list(g1 order by "at") as olds from (select id, g1, min("at") as "at" from {name}_arts group by 1, 2) group by id),
{name}_map as (select id, olds, case when len(olds) >= 2 then list_concat(olds[2:], olds[1:1]) else [cast((coalesce(try_cast(regexp_replace(olds[1], '[a-zA-Z]', '', 'g') as int), 0) + {_pick_of("id", "599", 2)}) % 600 + 1 as varchar)] end as news from {name}_old),
{name}_cut as (select a.id, start, start + length(g1) as stop, news[list_position(olds, g1)] as new, coalesce(lag(start + length(g1)) over (partition by a.id order by start), 0) as prev from {name}_arts a join {name}_map m on m.id = a.id),
{name} as (select s.id, s.t, (select string_agg(substr(s.t, cast(prev + 1 as bigint), cast(start - prev as bigint)) || new, '' order by start) || substr(s.t, cast(max(stop) + 1 as bigint)) from {name}_cut c where c.id = s.id) as corrupted from {source} s where s.what = 'candidate')"""


@query(f"with {LONG_SQL}, {_named_sql()}, {_law_swap_sql('long', 'swapped')} select id, t as candidate, corrupted from swapped")
def law_swap(spark, sf_dir):
    return X.law_swap(texts(spark, sf_dir).select("id", "candidate"), "candidate", "id", "corrupted")


@query(f"with {LONG_SQL}, {_article_swap_sql('long', 'swapped', 'spans')} select id, t as candidate, corrupted from swapped")
def article_swap(spark, sf_dir):
    return X.article_swap(texts(spark, sf_dir).select("id", "candidate"), "candidate", "id", "corrupted")


def _pick_sql(n: int, salt: int) -> str:
    return f"((id * 48271 + {salt * 7919}) % 2147483647) % {n}"


_CITED = f"""' This conclusion is further reinforced by Regulation (EU) No ' || (9000 + {_pick_sql(1000, 3)}) || '/' || (2030 + {_pick_sql(70, 13)})
 || ', Article ' || (500 + {_pick_sql(500, 23)}) || ', which explicitly mandates additional disclosure requirements not otherwise referenced here.'"""
_CLAIM = f"""' ' || ([{", ".join("'" + c.replace("'", "''") + "'" for c in X.CLAIMS)}])[1 + {_pick_sql(5, 4)}]"""
_BARE = lambda t: f"regexp_replace({t}, '\\s+$', '')"


@query(f"with {TEXTS_SQL} select id, {_BARE('candidate')} || {_CITED} as with_citation, {_BARE('candidate')} || {_CLAIM} as with_claim from texts")
def hallucinate(spark, sf_dir):
    k, t = F.col("id"), F.col("candidate")
    return texts(spark, sf_dir).select("id", X.hallucinate_citation(t, k).alias("with_citation"), X.hallucinate_text(t, k).alias("with_claim"))


@query(f"""with {LONG_SQL}, {_named_sql()}, {_law_swap_sql("long", "one")}, half as (select id, 'candidate' as what, coalesce(corrupted, t) as t from one), half_spans as ({_spans_sql("half")}),
{_article_swap_sql("half", "two", "half_spans")}, both_ as (select one.id, one.t as candidate, two.t as b0, two.corrupted as b, one.corrupted as a from one join two using (id))
select id, candidate, {_BARE("coalesce(b, b0)")} || {_CITED} || {_CLAIM} as corrupted,
 case when a <> candidate then 'law_swap,' else '' end || case when b <> b0 then 'article_swap,' else '' end || 'hallucinate_citation,hallucinate_text' as applied from both_""")
def corrupt_all(spark, sf_dir):
    rows = X.combined(texts(spark, sf_dir).select("id", "candidate"), "candidate", "id", "corrupted", "applied")
    return rows.select("id", "candidate", "corrupted", F.array_join("applied", ",").alias("applied"))


def planted(spark, sf_dir):
    """(id, text): the whole documents with a template after each sentence, its number from the sentence's place."""
    i = F.col("doc_id")
    said = lambda k: F.replace(F.get(F.array(*map(F.lit, TEMPLATES)), F.pmod(i + k, F.lit(N)).cast("int")), F.lit("{n}"), (1 + k % 400).cast("string"))
    pieces = F.transform(F.split(F.coalesce("text", F.lit("")), r"\. ", -1), lambda p, k: F.concat(p, F.lit(". "), said(k), F.lit(" ")))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(i.alias("id"), F.array_join(pieces, "").alias("text"))


#: The same in SQL with patterns, ranks and numbers of its own, over text whose accented letters are x, as its matcher knows ASCII words only.
PLANTED_SQL = f"""p as (select doc_id as id, array_to_string(list_transform(string_split(coalesce(text, ''), '. '), lambda s, k: s || '. ' || replace((['{"', '".join(TEMPLATES)}'])[1 + (doc_id + k - 1) % {N}], '{{n}}', (1 + (k - 1) % 400)::varchar) || ' '), '') as t from documents),
plain as (select id, regexp_replace(t, '[À-ÖØ-öø-ɏ]', 'x', 'g') as t from p),
forms(rank, form) as (values (0, 'regulation\\s+[(]eu[)]\\s+(?:no[.]?\\s+)?[0-9]{{3,4}}/[0-9]{{4}}'), (1, '\\bregulation\\s+[0-9]{{4}}/[0-9]{{1,4}}\\b'), (2, 'directive\\s+[0-9]{{4}}/[0-9]+/e[uc]'),
  (3, 'art(?:icle)?[.]?\\s+[0-9]+[a-z]?(?:\\s*[(][0-9]+[)])?(?:\\s*[(][a-z0-9]+[)])?'), (4, '\\b(?:eba|esma|eiopa)/(?:gl|rec|its|rts|op|cp|bs)/[0-9]{{4}}/[0-9]+\\b'),
  (5, '\\b(?:crr2?|brrd2?|mifid\\s*ii|mifir|emir|ucits\\s*v|aifmd|crdiv|mifid|ucits|crd\\s*iv|crd|psd2?|mar|bmr|ssr|sfdr|ecspr|dora)\\b')),
cut as (select id, rank, regexp_extract_all(t, '(?i)' || form) as m, string_split_regex(t, '(?i)' || form) as g from plain cross join forms),
hit as (select id, rank, unnest(m) as m, unnest(g[1:len(m)]) as g, generate_subscripts(m, 1) as i from cut where len(m) > 0),
placed as (select id, rank, m, sum(length(g) + length(m)) over (partition by id, rank order by i) - length(m) as start from hit),
numbers(num, acr) as (values ('575/2013', 'CRR'), ('2019/876', 'CRR2'), ('2013/36/EU', 'CRD'), ('2009/65/EC', 'UCITS'), ('600/2014', 'MIFIR'), ('2020/1503', 'ECSPR')),
own as (select *, case when rank = 3 then null when rank in (4, 5) then upper(regexp_replace(m, '\\s+', '', 'g')) else coalesce(acr, upper(regexp_extract(m, '[^\\s]+$'))) end as own from placed left join numbers on rank < 3 and num = regexp_extract(m, '[^\\s]+$')),
carried as (select *, coalesce(last_value(own ignore nulls) over (partition by id order by start, rank rows between unbounded preceding and current row), '') as act from own),
keyed as (select id, start, act || case when rank = 3 then ':art' || lower(regexp_extract(m, '[0-9]+[A-Za-z]?')) || coalesce(array_to_string(list_transform(regexp_extract_all(m, '[(][0-9A-Za-z]+[)]'), lambda x: ':' || lower(x)), ''), '') else '' end as citation from carried)"""


@query(f"with {PLANTED_SQL} select id, citation, min(start)::int as first_at, count(*) as mentions from keyed group by id, citation")
def document_citations(spark, sf_dir):
    """Citations planted in whole documents, with the place of the first mention and their number."""
    read = table(spark, sf_dir, "documents")._jdf.rdd().getNumPartitions()  # pieces of the table, of bounded size each
    return C.citation_rows(planted(spark, sf_dir), "id", "text", 8 * max(read, spark.sparkContext.defaultParallelism))
