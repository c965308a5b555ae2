"""A listing's pages as a stream: offsets are page numbers, so a crawl goes on where it stopped, and no page is read twice.

A batch is up to `batch` pages, dealt to up to `lanes` tasks, each of which pauses between two fetches: that many requests are under way at
once at most. The source reads pages only; links and fields come from them by the functions of `web`.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.judging import retried

SCHEMA = "page int, url string, html string"


class Pages(InputPartition):
    def __init__(self, numbers: list[int]):
        super().__init__(numbers)
        self.numbers = numbers


def pages_of(html: str | None) -> int:
    """Pages of a listing whose first page this is: one more than the greatest number of a link to a page; 0 if it could not be fetched."""
    return 0 if html is None else 1 + max(map(int, re.findall(r"[?&;]page=(\d+)", html)), default=0)


class Reader(DataSourceStreamReader):
    def __init__(self, fetch: Callable[[str], tuple[int, str]], options: dict):
        self.fetch, self.base = fetch, options["path"]
        self.batch, self.lanes, self.pause = int(options.get("batch", 200)), int(options.get("lanes", 5)), float(options.get("pause", 0))
        #: Pages planned so far; those known of.
        self.done = self.total = int(options.get("planned", 0))

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        """As far as one batch goes. The number of pages is asked for again when all are read."""
        if self.done >= self.total:
            self.total = max(self.total, pages_of(retried(self.fetch, self.base)))
        return {"page": min(self.total, self.done + self.batch)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.done = end["page"]
        numbers = list(range(start["page"], end["page"]))
        lanes = max(1, min(self.lanes, len(numbers)))
        return [Pages(numbers[k::lanes]) for k in range(lanes)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for k, n in enumerate(partition.numbers):
            if k and self.pause:
                time.sleep(self.pause)
            url = f"{self.base}?page={n}" if n else self.base
            yield n, url, retried(self.fetch, url)


def listing_source(fetch: Callable[[str], tuple[int, str]], name: str = "listing") -> type[DataSource]:
    """A data source for spark.dataSource.register; fetch(url) gives (status, body).

    Read by `listing_stream`, with options batch (pages of a batch), lanes (requests at once) and pause (seconds
    between two requests of a lane). Rows: page, url, html; html is null where every try failed. Pages that are added to the end of a listing later come in
    later batches.
    """

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> Reader:
            return Reader(fetch, dict(self.options))

    return Listing


def planned(spark: SparkSession, checkpoint: str) -> int:
    """The page up to which the stream of a checkpoint has planned its batches: the last offset that Spark wrote down there; 0 of a new one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return 0
    lines = [r[0] for r in spark.read.text(f"{checkpoint}/offsets/{max(numbers)}").collect()]  # a few lines
    return max(json.loads(line)["page"] for line in lines if line.startswith('{"page"'))


def listing_stream(spark: SparkSession, base: str, checkpoint: str, name: str = "listing", **options) -> DataFrame:
    """The pages of a listing as a stream that goes on after what the checkpoint's query has planned; write it with that checkpoint."""
    return spark.readStream.format(name).options(**options, planned=planned(spark, checkpoint)).load(base)
