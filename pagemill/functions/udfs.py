"""Arrow UDFs for what needs a parser, and their names in SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import charset, codelang, html, markdown, readability, relevance, selectors, sitemap, urls


def _strings(fn: Callable):
    """A string function of one value and constants as an Arrow UDF of a column and constant columns."""

    @F.arrow_udf(T.StringType())
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else fn(*row) for row in zip(*(c.to_pylist() for c in columns))], pa.string())

    return run


url_normalise = _strings(urls.normalise)
url_join = _strings(urls.join)
html_strip_chrome = _strings(html.strip_chrome)
html_scope = _strings(selectors.scope)
html_prune = _strings(lambda text: readability.prune(text)[1])
html_to_md = _strings(lambda text, no_links=False, no_images=False: markdown.convert(text, bool(no_links), bool(no_images)))
md_fences = _strings(markdown.tag_fences)
md_citations = _strings(lambda md, base, refs=False: markdown.cite(md, base, bool(refs)))
guess_code_language = _strings(codelang.guess_language)
md_filter = _strings(lambda md, query: relevance.filter_blocks(md, query))
_block = T.StructType().add("block", T.StringType()).add("score", T.DoubleType())


@F.arrow_udf(T.ArrayType(_block))
def md_blocks(md: pa.Array, query: pa.Array) -> pa.Array:
    """Blocks of a document in order, and their BM25 against the query."""
    out = []
    for text, q in zip(md.to_pylist(), query.to_pylist()):
        blocks = None if text is None else relevance.split_blocks(text)
        out.append(None if blocks is None else [{"block": b, "score": s} for b, s in zip(blocks, relevance.scores(blocks, q or ""))])
    return pa.array(out, pa.list_(pa.struct([("block", pa.string()), ("score", pa.float64())])))


@F.arrow_udf(T.ArrayType(T.StringType()))
def url_join_all(base: pa.Array, targets: pa.Array) -> pa.Array:
    """Targets that can't be resolved are left out; order and repeats stay."""
    out = []
    for b, ts in zip(base.to_pylist(), targets.to_pylist()):
        out.append(None if ts is None else [u for t in ts if (u := urls.join(b, t)) is not None])
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def decode_body(content_type: pa.Array, body: pa.Array) -> pa.Array:
    return pa.array([None if b is None else charset.decode(c, b) for c, b in zip(content_type.to_pylist(), body.to_pylist())], pa.string())


@F.arrow_udf(T.BinaryType())
def gunzip(url: pa.Array, body: pa.Array) -> pa.Array:
    return pa.array([None if b is None else sitemap.unpack(u or "", b) for u, b in zip(url.to_pylist(), body.to_pylist())], pa.binary())


@F.arrow_udf(T.StructType().add("urls", T.ArrayType(T.StringType())).add("subs", T.ArrayType(T.StringType())))
def sitemap_locations(body: pa.Array) -> pa.Array:
    found = [sitemap.locations(b) if b is not None else ([], []) for b in body.to_pylist()]
    return pa.array([{"urls": a, "subs": b} for a, b in found], pa.struct([("urls", pa.list_(pa.string())), ("subs", pa.list_(pa.string()))]))


@F.udtf(returnType=T.StructType([T.StructField("url", T.StringType()), T.StructField("kind", T.StringType())]))
class SitemapLocs:
    """Rows (url, kind) of a sitemap document; kind is page or sitemap."""

    def eval(self, body: bytes):
        pages, subs = sitemap.locations(bytes(body)) if body is not None else ([], [])
        for url in pages:
            yield url, "page"
        for url in subs:
            yield url, "sitemap"


def register(spark: SparkSession) -> None:
    """Makes the functions usable from SQL."""
    for name in ("url_normalise", "url_join", "html_strip_chrome", "html_scope", "html_prune", "html_to_md", "md_fences", "md_citations", "md_filter", "md_blocks", "guess_code_language", "url_join_all", "decode_body", "gunzip", "sitemap_locations"):
        spark.udf.register(name, globals()[name])
    spark.udtf.register("sitemap_locs", SitemapLocs)
