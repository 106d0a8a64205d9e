"""Paged web sources as a Spark data source: a partition a page, for tables and streams, and loads that resume."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE, TRIES, PAUSE = 10_000, 5, 0.5


def fetch(url: str, tries: int = TRIES, pause: float = PAUSE) -> str:
    """Body of a page; a failure is tried again after a pause that doubles, a refusal (4xx but 429) is not."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code < 500 and e.code != 429 or k + 1 == tries:
                raise
        except OSError:
            if k + 1 == tries:
                raise
        time.sleep(pause * 2**k)
    raise ValueError("no tries")


@dataclass
class Page(InputPartition):
    offset: int


class _Pages:
    """What the reader of a table and that of a stream share. Options: url with {offset} and {limit}, count_url, page_size, skip, tries, pause."""

    def __init__(self, options: dict) -> None:
        self.url, self.count_url = options["url"], options.get("count_url")
        self.size = int(options.get("page_size", PAGE))
        self.skip = set(json.loads(options.get("skip", "[]")))
        self.tries, self.pause = int(options.get("tries", TRIES)), float(options.get("pause", PAUSE))

    def total(self) -> int:
        """Rows that the source has: the field ``total`` of its count."""
        return int(json.loads(fetch(self.count_url, self.tries, self.pause))["total"])

    def pages(self, begin: int, end: int) -> list[Page]:
        return [Page(o) for o in range(begin, end, self.size) if o not in self.skip]

    def read(self, page: Page | None) -> Iterator[tuple]:
        if page is not None:  # a source without pages is read as one partition of none
            yield page.offset, fetch(self.url.replace("{offset}", str(page.offset)).replace("{limit}", str(self.size)), self.tries, self.pause)


class _TableReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.pages(0, self.total())


class _StreamReader(_Pages, DataSourceStreamReader):
    """A stream takes up full pages only: the rows of a page that still fills come with it once it is full."""

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        return {"row": self.total() // self.size * self.size}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.pages(start["row"], end["row"])

    def commit(self, end: dict) -> None:
        """Nothing to free: the checkpoint of the query holds the offset."""


class PagedSource(DataSource):
    """``spark.read.format("paged").option("url", ...).option("count_url", ...).load()``: (offset, body) of every page."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "offset long, body string"

    def reader(self, schema) -> _TableReader:
        return _TableReader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def landed_offsets(spark: SparkSession, path: str) -> list[int]:
    """Offsets of the pages under ``path``, from its folders alone; none if there is no such path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("offset="))


def land_pages(spark: SparkSession, url: str, count_url: str, path: str, page_size: int = PAGE, at_once: int = 64, tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """Land every full page under ``path``, a folder each, and read all: (offset, body). Pages that have landed are not asked for again.

    Pages are written ``at_once`` at a time, so a load that is stopped has lost
    no more than those under way. The folders are the manifest. A last page that
    is not full is read from the source, since it still grows.
    """
    spark.dataSource.register(PagedSource)
    plain = {"url": url, "count_url": count_url, "page_size": str(page_size), "tries": str(tries), "pause": str(pause)}
    total = _Pages(plain).total()
    every = range(0, total, page_size)

    def asked(offsets: list[int]) -> DataFrame:
        skip = sorted(set(every) - set(offsets))
        return spark.read.format("paged").options(**plain, skip=json.dumps(skip)).load()

    have = set(landed_offsets(spark, path))
    full = [o for o in every if o + page_size <= total]
    wanted = [o for o in full if o not in have]
    for k in range(0, len(wanted), at_once):
        asked(wanted[k : k + at_once]).write.partitionBy("offset").mode("append").parquet(path)
    open_ = asked([o for o in every if o + page_size > total])
    if not full:
        return open_
    landed = spark.read.schema("body string, offset long").parquet(path).select("offset", "body")
    return landed.unionByName(open_) if total % page_size else landed
