"""Counters and rates of a run's events, and the page search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import expressions as E


def counters(events: DataFrame, kind: str = "kind") -> DataFrame:
    """One row: processed pages, errors, and totals that were announced."""
    of = lambda name: F.count_if(F.col(kind) == name)
    return events.agg(of("page_done").alias("processed"), of("error").alias("errors"), of("started").alias("started"), of("finished").alias("finished"))


def page_events(raw: DataFrame) -> DataFrame:
    """raw pages (schema.RAW_PAGE), a table or a stream -> one event (schema.EVENT) a page: page_done, or error with its text.

    A status other than 2xx is an error. The URL is the final one if there is any.
    """
    failed = F.when(F.col("error").isNotNull(), F.concat_ws(": ", "error.kind", "error.detail"))
    failed = failed.when(F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.lit(None)).otherwise(F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("unknown"))))
    found = raw.select(F.coalesce("final_url", "requested_url").alias("url"), failed.alias("error"))
    return found.select(F.when(F.col("error").isNull(), F.lit("page_done")).otherwise(F.lit("error")).alias("kind"), F.lit(None).cast("long").alias("total"), "url", "error", F.current_timestamp().alias("ts"))


def run_events(raw: DataFrame) -> DataFrame:
    """The events of a finished run: started with the number of pages, one a page, finished."""
    ends = raw.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), total.alias("total")) for kind, total in (("started", F.col("n")), ("finished", F.lit(None).cast("long")))])).alias("e"))
    ends = ends.select("e.kind", "e.total", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("ts"))
    return ends.unionByName(page_events(raw))


def throughput(done, elapsed_ms, total):
    """(pages a second, share done): at least a millisecond counts, the share stops at 1."""
    return done / (F.greatest(elapsed_ms, F.lit(1)) / 1000.0), F.least(F.when(total > 0, done / total).otherwise(F.lit(0.0)), F.lit(1.0))


def search(pages: DataFrame, query: str) -> DataFrame:
    return pages.where(E.page_matches(F.col("url"), F.col("title"), query))
