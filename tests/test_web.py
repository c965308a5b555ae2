"""Listings and detail pages, with pages made here and a fetch function without network."""

from pyspark.sql import functions as F

from scorewright.sources import web

LISTING = '<a href="/qna/{a}" class="x number">1</a><a href="/about">no</a><a class="number" href="/qna/7">2</a><a href="/qna/{a}">again</a>'
PAGER = '<ul class="pager__items js"><a href="?page=1">2</a><a href="?page={n}">3</a></ul><a href="?page=99">other</a>'


def test_crawl(spark):
    site = {"l": LISTING.format(a=1) + PAGER.format(n=2), "l?page=1": LISTING.format(a=2), "l?page=2": LISTING.format(a=3)}
    fetch = lambda u, site=site: (200, site[u])
    got = web.crawl(spark, "l", fetch, href="^/qna/").orderBy("page", "at").collect()
    assert [(r.page, r.at, r.link) for r in got] == [(0, 0, "/qna/1"), (0, 1, "/qna/7"), (1, 0, "/qna/2"), (2, 0, "/qna/3")]
    assert web.crawl(spark, "l", lambda u: (404, ""), href="^/qna/").count() == 0


def test_listing(spark):
    pages = [LISTING.format(a=1), '<a title="Go to last page" href="?page=12">l</a>' + PAGER.format(n=3), PAGER.format(n=3), "", None]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = rows.select("i", web.listed(F.col("html"), css="number").alias("links"), web.last_page(F.col("html")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [0, 12, 3, 0, 0] and got[0].links == ["/qna/1", "/qna/7"] and not got[3].links and not got[4].links


def test_details(spark):
    eba = '<div class="field--name-qa-question-id a">2020_1</div><dl><dt> Legal act </dt><dd>Act <b>9</b></dd></dl><p class="field--name-qa-question">Why?<br>How?<script>x</script></p>'
    esma = (
        '<h1 class="field--name-title">ESMA_QA_5</h1><div class="field--name-field-lqa-ist-of-topics">Topic<i>Funds</i></div>'
        '<div class="field--name-field-qa-esma-response">old</div><div class="field--name-field-qa-esma-response">new<p>answer</div>'
    )
    pages = spark.createDataFrame([("a", eba), ("b", esma), ("c", "<p>none</p>"), ("d", None)], "url string, html string")
    (r,) = web.details(pages, web.EBA).collect()
    assert (r.id, r.legal_act, r.topic, r.question, r.final_answer, r.url) == ("2020_1", "Act\n9", "", "Why?\nHow?", "", "a")
    (r,) = web.details(pages, web.ESMA).collect()
    assert (r.id, r.topic, r.answer, r.url) == ("ESMA_QA_5", "Funds", "new\nanswer", "b")
