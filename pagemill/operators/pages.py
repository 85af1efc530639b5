"""Raw pages to markdown pages: one projection, no shuffle. JVM expressions for what SQL can say, one Arrow UDF for the
document itself."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import schema
from pagemill.functions import expressions as E
from pagemill.functions import html, markdown, readability, relevance, selectors
from pagemill.functions.udfs import url_join_all
from pagemill.options import Options

BODY = pa.struct([("title", pa.string()), ("markdown", pa.string()), ("kind", pa.string()), ("detail", pa.string())])


class PageError(Exception):
    """A run over a single page failed."""


def document(text: str, url: str, options: Options) -> tuple[str | None, str]:
    """(title found on the way, markdown without metadata). Raises LookupError without content, ValueError for a bad
    selector."""
    title = None
    if options.raw:
        cleaned = text
    elif options.prune:
        title, cleaned = readability.prune(text)
        if cleaned is None:
            raise LookupError(url)
    else:
        cleaned = html.strip_chrome(text)
    if options.css and not options.raw:
        cleaned = selectors.scope(cleaned, options.css)
        if cleaned is None:
            raise LookupError(f"nothing matches {options.css} at {url}")
    md = markdown.convert(cleaned, options.no_links, options.no_images)
    md = relevance.filter_blocks(md, options.query)
    if options.citations:
        md = markdown.cite(md, url, options.refs)
    if not md.strip():
        raise LookupError(url)
    return title, md


def _body(options: Options):
    @F.arrow_udf("struct<title: string, markdown: string, kind: string, detail: string>")
    def run(texts: pa.Array, targets: pa.Array) -> pa.Array:
        out = []
        for text, url in zip(texts.to_pylist(), targets.to_pylist()):
            row = {"title": None, "markdown": None, "kind": None, "detail": None}
            try:
                row["title"], row["markdown"] = document(text or "", url or "", options)
            except LookupError as e:
                row |= {"kind": schema.NO_CONTENT, "detail": str(e.args[0])}
            except selectors.SelectorError as e:
                row |= {"kind": schema.PARSE, "detail": str(e)}
            out.append(row)
        return pa.array(out, BODY)

    # Filters on what it returns would else be pushed below the projection, and each document be parsed twice.
    return run.asNondeterministic()


def raw_pages(pages: DataFrame) -> DataFrame:
    """A table (page_id, url, html) as fetched pages."""
    return pages.select("page_id", F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.lit(200).alias("status"), "html", F.lit("text/html").alias("content_type"))


def transform_pages(raw: DataFrame, options: Options = Options()) -> DataFrame:
    """raw pages -> PAGE and error (kind, detail): a row each; a page without content has an error and no markdown."""
    options = options.normalised()
    found = raw.select("page_id", F.col("final_url").alias("url"), E.title(F.col("html")).alias("_title"), url_join_all(F.col("final_url"), E.hrefs(F.col("html"))).alias("links"), _body(options)(F.col("html"), F.col("final_url")).alias("_body"))
    title = F.coalesce(F.col("_body.title"), F.col("_title"))
    body = F.col("_body.markdown")
    md = body if options.no_metadata else E.metadata_header(body, F.col("url"), title)
    error = F.when(F.col("_body.kind").isNotNull(), F.struct(F.col("_body.kind").alias("kind"), F.col("_body.detail").alias("detail")))
    out = found.select("page_id", "url", title.alias("title"), md.alias("markdown"), "links", error.alias("error"))
    return out.select("page_id", "url", "title", "markdown", E.tokens(F.col("markdown")).alias("tokens"), "links", "error")


def good_pages(pages: DataFrame) -> DataFrame:
    """Pages without an error."""
    return pages.where("error IS NULL").drop("error")


def single_page(pages: DataFrame) -> DataFrame:
    """The one page of a run; its error is raised."""
    row = pages.select("error").first()
    if row is None or row["error"] is not None:
        raise PageError("no page" if row is None else f"{row['error']['kind']}: {row['error']['detail']}")
    return good_pages(pages)
