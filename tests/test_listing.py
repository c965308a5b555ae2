"""A crawl as a stream: all pages once, also over restarts and when the listing grows."""

import os
from collections import Counter

from pyspark.sql import functions as F

from scorewright.sources import web
from scorewright.sources.listing import Reader, listing_source, listing_stream, pages_of, planned


def site(folder, pages):
    """fetch(url) of a listing whose number of pages stands in a file; what was fetched is written to a log."""
    count, log = os.path.join(folder, "pages"), os.path.join(folder, "log")
    with open(count, "w") as f:
        f.write(str(pages))

    def fetch(url):
        with open(log, "a") as f:
            f.write(url + "\n")
        with open(count) as f:
            n = int(f.read())
        page = int(url.partition("?page=")[2] or 0)
        if page == 4:
            return 404, ""
        return 200, f'<a href="/q/{page}-1">x</a><a href="/q/{page}-2">y</a><ul class="pager__items"><a href="?page={n - 1}" title="last page">l</a></ul>'

    return fetch, count, log


def run(spark, out, checkpoint, **options):
    rows = listing_stream(spark, "http://example.org/list", checkpoint, **options)
    links = rows.select("page", F.explode_outer(web.listed(F.col("html"), "/q/")).alias("link"))
    q = links.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
    q.processAllAvailable()
    progress = [p for p in q.recentProgress if p["numInputRows"]]
    q.stop()
    return progress


def test_a_crawl_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("time.sleep", lambda s: None)
    fetch, count, log = site(str(tmp_path), 10)
    spark.dataSource.register(listing_source(fetch))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    progress = run(spark, out, checkpoint, batch=3, lanes=2)
    assert [p["numInputRows"] for p in progress] == [3, 3, 3, 1]  # bounded batches, offsets tell how far
    assert planned(spark, checkpoint) == 10
    with open(count, "w") as f:
        f.write("13")  # the listing grows while the stream is stopped
    again = run(spark, out, checkpoint, batch=2, lanes=2)
    assert [p["numInputRows"] for p in again] == [2, 1]
    rows = spark.read.parquet(out).collect()
    assert sorted((r.page, r.link) for r in rows if r.page != 4) == sorted((p, f"/q/{p}-{k}") for p in range(13) if p != 4 for k in (1, 2))
    assert [r.link for r in rows if r.page == 4] == [None]
    with open(log) as f:
        seen = Counter(f.read().split())
    assert all(seen[f"http://example.org/list?page={p}"] == (3 if p == 4 else 1) for p in range(1, 13))  # a failing page is tried three times, no page is read twice


def test_pages_are_dealt_to_lanes():
    r = Reader(lambda url: (200, "?page=6"), {"path": "http://x", "batch": "4", "lanes": "3"})
    assert r.initialOffset() == {"page": 0} and r.latestOffset() == {"page": 4}
    assert [p.numbers for p in r.partitions({"page": 0}, {"page": 4})] == [[0, 3], [1], [2]]
    assert r.latestOffset() == {"page": 7}
    assert [p.numbers for p in r.partitions({"page": 7}, {"page": 7})] == [[]]
    assert pages_of(None) == 0 and pages_of("<p>") == 1 and pages_of('<a href="/l?x=1&amp;page=12">') == 13
