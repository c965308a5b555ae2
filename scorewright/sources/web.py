"""Question listings and detail pages of regulators' sites, through an injected fetch function."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.judging import retried

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Spec:
    """Where the fields of a detail page are: by CSS class (its last block for `newest`), or in the dd after a dt with a label.

    `labels` are heads that a site puts before a field's text; `id_prefix` is what an id must start with.
    """

    id: str
    classes: dict[str, str]
    terms: dict[str, str] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    newest: tuple[str, ...] = ()
    id_prefix: str = ""

    def names(self) -> list[str]:
        return ["id", *self.classes, *self.terms]


#: Class names and labels of the two sites.
EBA = Spec(
    "field--name-qa-question-id",
    {
        "status": "field--name-qa-status", "subject_matter": "field--name-qa-subject-matter", "question": "field--name-qa-question", "background": "field--name-qa-question-background",
        "final_answer": "field--name-qa-final-answer", "published_date": "field--name-qa-final-publishing-date", "answer_source": "field--name-qa-answer-source",
    },
    {"legal_act": "Legal act", "topic": "Topic"},
)
ESMA = Spec(
    "field--name-title",
    {
        "level1_regulation": "field--name-field-qa-level1", "topic": "field--name-field-lqa-ist-of-topics", "subject_matter": "field--name-field-qa-subject-matter", "question": "field--name-field-qa-question",
        "answer": "field--name-field-qa-esma-response", "response_date": "field--name-field-qa-esma-response-date", "published_date": "question__header--date",
    },
    labels={"subject_matter": "Subject Matter", "level1_regulation": "Level 1 Regulation", "topic": "Topic"},
    newest=("answer", "response_date"), id_prefix="ESMA_QA",
)


class Blocks(HTMLParser):
    """Text of every element, under its classes and, for dt and dd, under its tag, in the order of start tags."""

    def __init__(self, html: str):
        super().__init__()
        self.open: list[tuple[str, list[str]]] = []
        self.by_class: dict[str, list[list[str]]] = {}
        self.terms: list[tuple[str, list[str]]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        text: list[str] = []
        for name in (dict(attrs).get("class") or "").split():
            self.by_class.setdefault(name, []).append(text)
        if tag in ("dt", "dd"):
            self.terms.append((tag, text))
        if tag not in VOID:
            self.open.append((tag, text))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        if data.strip() and not any(tag in ("script", "style") for tag, _ in self.open):
            for _, text in self.open:
                text.append(data.strip())

    def of_class(self, name: str, newest: bool = False) -> str:
        found = self.by_class.get(name) or [[]]
        return "\n".join(found[-1 if newest else 0])

    def after(self, label: str) -> str:
        for (a, term), (b, text) in zip(self.terms, self.terms[1:], strict=False):
            if a == "dt" and b == "dd" and " ".join(term) == label:
                return "\n".join(text)
        return ""


def detail(html: str | None, spec: Spec) -> dict[str, str] | None:
    """Fields of a page, empty if absent; None without an id or with another kind of id."""
    page = Blocks(html or "")
    if not (found := page.of_class(spec.id)) or not found.startswith(spec.id_prefix):
        return None
    out = {"id": found}
    for name, css in spec.classes.items():
        out[name] = page.of_class(css, name in spec.newest).removeprefix(spec.labels.get(name, "")).strip()
    return out | {name: page.after(label) for name, label in spec.terms.items()}


def details(pages: DataFrame, spec: Spec) -> DataFrame:
    """pages(url, html) to one row per question page: id, the spec's fields and url. Other pages give no row."""
    names = spec.names()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [row | {"url": url} for url, html in zip(f["url"], f["html"], strict=True) if (row := detail(html, spec))]
            yield pd.DataFrame(rows, columns=[*names, "url"], dtype=object)

    return pages.select("url", "html").mapInPandas(run, ", ".join(f"`{n}` string" for n in [*names, "url"]))


def listed(html: Column, href: str = "", css: str = "") -> Column:
    """Distinct targets of a listing's anchors, in their order, whose target matches href and whose class list has css."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>)"), F.lit(1))
    if css:
        tags = F.filter(tags, lambda t: t.rlike(rf'(?is)\bclass="(?:[^"]*\s)?{css}(?:\s[^"]*)?"'))
    targets = F.transform(tags, lambda t: F.regexp_extract(t, r'(?is)\bhref="([^"]*)"', 1))
    return F.array_distinct(F.filter(targets, lambda x: (x != "") & x.rlike(href)))


def last_page(html: Column) -> Column:
    """Number in the link titled 'last page', else the highest number in the pager, else 0."""
    last = F.regexp_extract(F.regexp_extract(html, r'(?is)(<a\b[^>]*title="[^"]*last page[^"]*"[^>]*>)', 1), r"page=(\d+)", 1)
    pager = F.regexp_extract(html, r'(?is)class="[^"]*pager__items[^"]*"(.*?)</ul>', 1)
    numbers = F.transform(F.regexp_extract_all(pager, F.lit(r"page=(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.nullif(last, F.lit("")).cast("int"), F.array_max(numbers), F.lit(0))


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str]]) -> DataFrame:
    """urls with `html`, null where every try failed. Concurrency is the number of partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(html=pd.Series([retried(fetch, u) for u in f["url"]], index=f.index, dtype=object))

    return urls.mapInPandas(run, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in urls.schema) + ", html string")


def crawl(spark: SparkSession, base: str, fetch: Callable[[str], tuple[int, str]], concurrency: int = 5, **anchors: str) -> DataFrame:
    """(page, at, link): the distinct links of all pages of a listing with the place of the first; no row if page 0 fails.

    Page 0 is fetched once and tells how many there are; the others are fetched by `concurrency` tasks.
    """
    first = spark.createDataFrame([(0, retried(fetch, base))], "page long, html string")
    n = first.select(last_page(F.col("html"))).first()[0]
    rest = spark.range(1, n + 1, 1, concurrency).select(F.col("id").alias("page"), F.concat(F.lit(f"{base}?page="), "id").alias("url"))
    pages = first.unionByName(fetched(rest, fetch).select("page", "html")) if n else first
    links = pages.where("html is not null").select("page", F.posexplode(listed(F.col("html"), **anchors)).alias("at", "link"))
    return links.groupBy("link").agg(F.min(F.struct("page", "at")).alias("p")).select("p.page", "p.at", "link")
