"""A whole run by options: find pages, fetch, transform, render."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pagemill import schema
from pagemill.functions import expressions as E
from pagemill.functions import urls
from pagemill.operators.pages import document, good_pages, single_page, transform_pages
from pagemill.options import Options
from pagemill.sinks import files
from pagemill.sources import site


def links_of(html: str | None) -> list[str]:
    """functions.expressions.hrefs of one text."""
    found = re.findall(E.HREF, html or "")
    return [h for h in found if h and not re.match(r"#|javascript:|mailto:", h)]


def pages(spark: SparkSession, options: Options) -> DataFrame:
    """PAGE rows of a single page, a site or a deep crawl."""
    options = options.normalised()
    if options.site:
        fast = options.match_pattern is None and options.output_dir is None and options.max_pages == 0
        text = site.llms_text(options.url, options) if fast else None
        if text is not None:
            row = spark.createDataFrame([(0, options.url, urls.parse(options.url).host, text)], "page_id long, url string, title string, markdown string")
            return row.selectExpr("*", "array() AS links").withColumn("tokens", E.tokens(row["markdown"])).select(*schema.PAGE.fieldNames())
        return good_pages(transform_pages(site.site(spark, options), options))
    if options.deep:
        def one(raw: dict):
            links = [u for x in links_of(raw["html"]) if (u := urls.join(raw["final_url"], x))]
            try:
                document(raw["html"], raw["final_url"], options)
            except (LookupError, ValueError):
                return None
            return {f: raw[f] for f in schema.RAW_PAGE.fieldNames()}, links

        rows = site.deep(options, one)
        return good_pages(transform_pages(spark.createDataFrame(rows, schema.RAW_PAGE), options))
    return single_page(transform_pages(site.single(spark, options), options))


def run(spark: SparkSession, options: Options, out=None) -> None:
    files.render(pages(spark, options), options.normalised(), out)
