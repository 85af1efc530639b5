"""Detectors, sitemap documents, sinks and options as queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import scratch
from pagemill.functions import sitemap
from pagemill.functions import expressions as E
from pagemill.functions.udfs import gunzip, sitemap_locations
from pagemill.operators import robots, sitemaps
from pagemill.plans.common import SQL_FILE, SQL_PAGES, plan, simple_pages, table
from pagemill.sinks import files


@F.arrow_udf(T.BinaryType())
def gzipped(column: pa.Array) -> pa.Array:
    return pa.array([sitemap.pack(x) for x in column.to_pylist()], pa.binary())


@plan("sitemap_parse", "SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'page' ELSE 'sitemap' END AS kind, url FROM pages")
def sitemap_parse(spark, d):
    """A document per page, in two shapes, gzipped under a name that doesn't say so, with prefixes and blanks."""
    loc = F.concat(F.lit("<s:loc>\n "), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit(" </s:loc>"))
    even = F.concat(F.lit('<s:urlset xmlns:s="x"><s:url>'), loc, F.lit("</s:url></s:urlset>"))
    odd = F.concat(F.lit('<s:sitemapindex xmlns:s="x"><s:sitemap>'), loc, F.lit("</s:sitemap></s:sitemapindex>"))
    body = gzipped(F.when(F.col("page_id") % 2 == 0, even).otherwise(odd).cast("binary"))
    found = table(spark, d, "pages").select("page_id", sitemap_locations(gunzip(F.lit("https://e.com/s.xml"), body)).alias("l"))
    pages = found.select("page_id", F.lit("page").alias("kind"), F.explode("l.urls").alias("url"))
    return pages.unionByName(found.select("page_id", F.lit("sitemap").alias("kind"), F.explode("l.subs").alias("url")))


@plan("llms_fast_path", """SELECT source AS origin, arg_min(body, priority) AS body FROM (SELECT source, doc_id AS priority, text AS body FROM documents) WHERE strlen(trim(body)) >= 10 GROUP BY source""")
def llms_fast_path(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("origin"), F.col("doc_id").alias("priority"), F.lit(200).alias("status"), F.lit("text/plain").alias("content_type"), F.col("text").alias("body"))
    return sitemaps.llms_full_text(rows)


@plan("page_files", f"WITH {SQL_PAGES} SELECT ix, {SQL_FILE.format(x='url')} AS file, md5(markdown) AS digest FROM p")
def page_files(spark, d):
    """A file per page, written and read again."""
    folder = scratch.folder(spark, "files")
    names = scratch.cut(files.write_pages(simple_pages(spark, d), folder), "file-names")
    back = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.md5("content").alias("digest"))
    return names.join(back, "file").select("ix", "file", "digest")


@plan("json_lines_file", f"WITH {SQL_PAGES} SELECT ix, url, title, tokens, md5(markdown) AS digest FROM p")
def json_lines_file(spark, d):
    folder = scratch.folder(spark, "lines")
    files.write_json_lines(simple_pages(spark, d), folder)
    back = spark.read.schema("index long, url string, title string, tokens long, markdown string").json(folder)
    return back.select(F.col("index").alias("ix"), "url", "title", "tokens", F.md5("markdown").alias("digest"))


@plan("robots_fallback", "SELECT page_id, true AS allowed FROM pages")
def robots_fallback(spark, d):
    """Missing and unreadable robots.txt restrict nothing."""
    urls = table(spark, d, "pages").select("page_id", "url")
    origins = urls.select(E.url_origin(F.col("url")).alias("origin")).distinct()
    bodies = origins.select("origin", F.when(F.length("origin") % 2 == 0, F.lit("<html>404</html>")).alias("body"))
    return robots.allowed(urls, robots.parsed(bodies)).select("page_id", "allowed")
