"""The data source "webpages": spark.read.format("webpages").option("urls", ...)."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagemill import schema
from pagemill.functions import urls
from pagemill.options import Options


class WebPages(DataSource):
    """Options: urls (separated by line feeds or blanks), timeout_ms, concurrency, ignore_robots, no_delay, engine."""

    @classmethod
    def name(cls) -> str:
        return "webpages"

    def schema(self):
        return schema.RAW_PAGE

    def reader(self, schema):
        return WebReader(self.options)


class Part(InputPartition):
    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = rows


class WebReader(DataSourceReader):
    def __init__(self, options):
        on = lambda name: str(options.get(name, "false")).lower() == "true"
        self.urls = options.get("urls", "").split()
        self.options = Options(timeout_ms=int(options.get("timeout_ms", 30_000)), concurrency=int(options.get("concurrency", 16)), ignore_robots=on("ignore_robots"), no_delay=on("no_delay"), browser=options.get("engine") == "browser").normalised()

    def partitions(self):
        """One partition per origin, so that its delay is kept by one task."""
        homes = defaultdict(list)
        for k, url in enumerate(self.urls):
            found = urls.parse(url)
            homes[found.origin if found else ""].append((k, url))
        return [Part(rows) for rows in homes.values()]

    def read(self, partition):
        from pagemill.sources.http import FIELDS, fetch_rows

        for row in fetch_rows(({"page_id": k, "url": u} for k, u in partition.rows), self.options):
            error = row["error"]
            yield tuple(row[f] if f != "error" else (error and (error["kind"], error["detail"])) for f in FIELDS)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WebPages)
