"""Incremental corpora and run events on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill import schema
from pagemill.operators.pages import good_pages, raw_pages, transform_pages
from pagemill.options import Options


def stream_pages(spark: SparkSession, folder: str, options: Options = Options(), files_per_batch: int = 100) -> DataFrame:
    """New Parquet files (page_id, url, html) in folder as transformed pages, each URL once."""
    found = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return good_pages(transform_pages(raw_pages(found.dropDuplicates(["url"])), options))


def append_pages(pages: DataFrame, path: str, checkpoint: str):
    """A query that appends pages to a Parquet table; it ends when all present files are read."""
    return pages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counters(events: DataFrame) -> DataFrame:
    """Counts per kind of an event stream (schema.EVENT)."""
    assert set(schema.EVENT.fieldNames()) <= set(events.columns)
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def limited(requests: DataFrame, delay_us: int, mode: str = "append") -> DataFrame:
    """requests (origin, url, arrival_us) -> the same and start_us: starts of an origin are delay_us apart, across
    micro-batches. State is one number per origin."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["arrival_us", "url"], kind="stable")
        starts = []
        for at in rows["arrival_us"]:
            start = at if free is None else max(at, free)
            free = start + delay_us
            starts.append(start)
        state.update((int(free),))
        yield rows.assign(start_us=starts)[["origin", "url", "arrival_us", "start_us"]]

    return requests.groupBy("origin").applyInPandasWithState(run, "origin string, url string, arrival_us long, start_us long", "free long", mode, GroupStateTimeout.NoTimeout)
