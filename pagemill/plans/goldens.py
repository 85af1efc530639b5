"""Whole operators on documents built from the tables, whose results SQL can write down."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import scratch
from pagemill.functions import codelang, udfs
from pagemill.functions import expressions as E
from pagemill.operators import crawl, pages, sitemaps
from pagemill.options import Options
from pagemill.plans import relations
from pagemill.plans.common import ORACLES, SQL_HREFS, SQL_TOKENS, parsed_table, plan, simple_pages, table
from pagemill.sinks import files
from pagemill.sources import http
from pagemill.streaming import pages as streams

#: An order as a page: {0} is its number, {1} its customer, {2} its line count, {3} its price in cents.
ORDER_PAGE = (
    "<!doctype html><html><head><title>Order {0}</title><style>.x{{}}</style></head><body><nav><a href='/orders'>All orders</a></nav><main><h1>Order no. {0}</h1>"
    "<p>Placed by <strong>customer {1}</strong> for <em>{3} cents</em>, see <a href='../customers/{1}' title='who'>the file</a>.</p>"
    "<ul><li>first of {2}<li>second<ul><li>nested {0}</li></ul></ul><ol start={2}><li>packed</li><li>sent</li></ol><table><tr><th>key</th><th>n</th></tr><tr><td>{0}</td><td>{2}</td></tr></table>"
    "<blockquote><p>kept {1}</p></blockquote><pre><code class='language-sh'>ship {0} \\\n  now</code></pre><hr><img src='/i/{1}.png' alt='box {1}'></main><footer>page foot</footer><script>track({0})</script></body></html>"
)
#: What it is in markdown, after its title; {link} is the link.
ORDER_MD = (
    "# Order no. {0}\n\nPlaced by **customer {1}** for *{3} cents*, see {link}.\n\n- first of {2}\n- second\n  - nested {0}\n\n{2}. packed\n{4}. sent\n\n"
    "| key{5} | n   |\n| ---{6} | --- |\n| {0}{7} | {2}   |\n\n> kept {1}\n\n```sh\nship {0} \\\n  now\n```\n\n* * *\n\n![box {1}](/i/{1}.png)\n"
)


def _filled(template: str, *values: Column) -> Column:
    """template.format() as an expression."""
    names = [f"\x01{k}\x01" for k in range(len(values))]
    out = F.lit(template.format(*names))
    for name, value in zip(names, values):
        out = F.replace(out, F.lit(name), value)
    return out


def _sql_filled(template: str, *values: str, **named: str) -> str:
    marks = {f"\x01{k}\x01": v for k, v in enumerate(values)}
    text = template.format(*marks, **named).replace("'", "''")
    for mark, value in marks.items():
        text = text.replace(mark, f"' || {value} || '")
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


SQL_ORDERS = "(SELECT o_orderkey AS page_id, o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c, (2 + o_orderkey % 5)::VARCHAR AS n, (o_orderkey * 7)::VARCHAR AS p FROM orders)"
# Columns of a table are as wide as their widest cell, of three signs at least; {2} is one digit.
_cells = ("k", "c", "n", "p", "(n::INT + 1)::VARCHAR", "repeat(' ', greatest(length(k), 3) - 3)", "repeat('-', greatest(length(k), 3) - 3)", "repeat(' ', greatest(3 - length(k), 0))")
SQL_ORDER_MD = _sql_filled(ORDER_MD, *_cells, link='[the file](../customers/\x011\x01 "who")')
SQL_ORDER_CITED = _sql_filled(ORDER_MD, *_cells, link="the file[1]")


def _orders(spark, d):
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    html = _filled(ORDER_PAGE, key, customer, (2 + F.col("o_orderkey") % 5).cast("string"), (F.col("o_orderkey") * 7).cast("string"))
    orders = scratch.fan_out(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return orders.select(F.col("o_orderkey").alias("page_id"), F.concat(F.lit("https://shop.example/orders/"), key).alias("url"), html.alias("html"))


@plan("markdown_documents", f"SELECT page_id, 'Order ' || k || chr(10) || chr(10) || {SQL_ORDER_MD} AS markdown FROM {SQL_ORDERS}")
def markdown_documents(spark, d):
    """Headings, emphasis, links, nested and numbered lists, tables, quotations, code, rules and images."""
    return _orders(spark, d).select("page_id", udfs.html_to_md(udfs.html_strip_chrome("html"), F.lit(False), F.lit(False)).alias("markdown"))


@plan("markdown_pages", f"""SELECT page_id, 'https://shop.example/orders/' || k AS url, 'Order ' || k AS title, '---' || chr(10) || 'title: "Order ' || k || '"' || chr(10) || 'source: https://shop.example/orders/' || k || chr(10) || 'tokens: ' || {SQL_TOKENS.format(x='md')} || chr(10) || '---' || chr(10) || chr(10) || md AS markdown,
'https://shop.example/orders,https://shop.example/customers/' || c AS links FROM (SELECT *, 'Order ' || k || chr(10) || chr(10) || {SQL_ORDER_MD} AS md FROM {SQL_ORDERS})""")
def markdown_pages(spark, d):
    """The whole pipeline of a page."""
    out = pages.good_pages(pages.transform_pages(pages.raw_pages(_orders(spark, d))))
    return out.select("page_id", "url", "title", "markdown", F.array_join("links", ",").alias("links"))


@plan("markdown_cited", f"""SELECT page_id, 'Order ' || k || chr(10) || chr(10) || {SQL_ORDER_CITED} || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '[1]: https://shop.example/customers/' || c || chr(10) AS markdown FROM {SQL_ORDERS}""")
def markdown_cited(spark, d):
    """The same with links as citations; a link with a title is none."""
    orders = _orders(spark, d).withColumn("html", F.replace("html", F.lit(" title='who'"), F.lit("")))
    out = pages.good_pages(pages.transform_pages(pages.raw_pages(orders), Options(refs=True, no_metadata=True)))
    return out.select("page_id", "markdown")


#: Paragraphs that the main content has, and how often a link list repeats.
PROSE = "This is sentence {1} of account {0}, and with its commas, it goes on for long enough to count as prose."
PARAGRAPHS = 6


@plan("prune_main_content", "SELECT c_custkey AS page_id, " + " || chr(10) || chr(10) || ".join(_sql_filled(PROSE, "c_custkey", f"'{k}'") for k in range(PARAGRAPHS)) + " || chr(10) AS markdown FROM customer")
def prune_main_content(spark, d):
    """Prose stays, a list of links beside it, a menu and a footer go."""
    key = F.col("c_custkey").cast("string")
    prose = F.concat(*[F.concat(F.lit("<p>"), _filled(PROSE, key, F.lit(str(k))), F.lit("</p>")) for k in range(PARAGRAPHS)])
    links = "".join(f"<p><a href='/{k}'>A link with a rather long text in it, {k}</a></p>" for k in range(PARAGRAPHS))
    html = F.concat(F.lit(f"<html><body><nav><a href='/'>menu</a></nav><div class='sidebar'>{links}</div><div class='content'>"), prose, F.lit("</div><footer>foot</footer></body></html>"))
    found = scratch.spread(table(spark, d, "customer")).select(F.col("c_custkey").alias("page_id"), udfs.html_prune(html).alias("content"))
    return found.select("page_id", udfs.html_to_md("content", F.lit(False), F.lit(False)).alias("markdown"))


@plan("empty_content", "SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def empty_content(spark, d):
    """Pages of nothing but chrome have no content and go."""
    html = F.when(F.col("page_id") % 3 == 0, F.lit("<nav>menu</nav><script>x</script>")).otherwise(F.col("html"))
    return pages.good_pages(pages.transform_pages(pages.raw_pages(parsed_table(spark, d, "pages").withColumn("html", html)))).select("page_id")


# ---------------------------------------------------------------- crawls and sitemaps

DEPTH = 5


def _tree(spark, d):
    """Every page links to three others, as nodes of a tree do."""
    p = F.col("page_id")
    links = table(spark, d, "pages").select(p.alias("src"), F.posexplode(F.array(3 * p + 1, 3 * p + 2, 3 * p + 3)).alias("pos", "dst"))
    return links.join(table(spark, d, "pages").select(p.alias("dst")), "dst", "left_semi").select("src", "pos", "dst")


SQL_TREE = f"WITH RECURSIVE t(node, depth, path) AS (SELECT page_id, 0, '' FROM pages WHERE page_id = 0 UNION ALL SELECT page_id, depth + 1, path || {{step}} FROM t JOIN pages ON (page_id - 1) // 3 = node AND page_id > 0 WHERE depth < {DEPTH})"


@plan("bfs_order", SQL_TREE.format(step="'x'") + " SELECT 0::BIGINT AS root, node, depth, row_number() OVER (ORDER BY depth, node) AS rank FROM t")
def bfs_order(spark, d):
    start = spark.createDataFrame([(0, 0)], "root long, node long")
    return crawl.bfs(_tree(spark, d), start, DEPTH, None)


@plan("bfs_capped", SQL_TREE.format(step="'x'").replace("AND page_id > 0 WHERE", "AND page_id > 0 WHERE node % 5 <> 4 AND") + " SELECT node FROM t WHERE node % 5 <> 4 ORDER BY depth, node LIMIT 10")
def bfs_capped(spark, d):
    """Ten good pages; those that can't be fetched are seen but neither counted nor followed."""
    start = spark.createDataFrame([(0, 0)], "root long, node long")
    good = table(spark, d, "pages").where("page_id % 5 <> 4").select(F.col("page_id").alias("node"))
    return crawl.bfs(_tree(spark, d), start, DEPTH, 10, good=good).select("node")


@plan("dfs_order", SQL_TREE.format(step="(9 - (page_id - 1) % 3)::VARCHAR") + " SELECT 0::BIGINT AS root, node, depth, row_number() OVER (ORDER BY path) AS rank FROM t")
def dfs_order(spark, d):
    """The link that was found last is followed first."""
    return crawl.dfs(_tree(spark, d).withColumn("root", F.lit(0).cast("long")), DEPTH, None).withColumn("rank", F.col("rank").cast("long"))


@plan("same_host_links", f"SELECT page_id, link FROM (SELECT page_id, unnest({SQL_HREFS}) AS link FROM pages) WHERE regexp_extract(link, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) = 'example.com'")
def same_host_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(E.hrefs(F.col("html"))).alias("link"))
    return crawl.same_host(links, "example.com", "link")


def _maps(spark, n: int):
    """An index of n sitemaps, with a page each."""
    listed = "".join(f"<sitemap><loc>https://example.com/m{k}.xml</loc></sitemap>" for k in range(n))
    rows = [("https://example.com/sitemap.xml", f"<sitemapindex>{listed}</sitemapindex>")] + [(f"https://example.com/m{k}.xml", f"<urlset><url><loc>https://example.com/page/{k}</loc></url></urlset>") for k in range(n)]
    return spark.createDataFrame(rows, "url string, body string").withColumn("body", F.col("body").cast("binary"))


@plan("sitemap_cap", "SELECT 'https://example.com/page/' || k AS url FROM range(51, 250) t(k)")
def sitemap_cap(spark, d):
    """Of 250 sitemaps the index and the last 199 are read."""
    return sitemaps.collect_urls(_maps(spark, 250), ["https://example.com/sitemap.xml"], "example.com").select("url")


@plan("sitemap_limit", "SELECT 'https://example.com/page/' || k AS url FROM range(93, 100) t(k)")
def sitemap_limit(spark, d):
    return sitemaps.collect_urls(_maps(spark, 100), ["https://example.com/sitemap.xml"], "example.com", limit=7).select("url")


# ---------------------------------------------------------------- sinks, streams, bodies, detectors


@plan("render_folder", " UNION ALL ".join(f"SELECT '{name}' AS file, md5(text) AS digest FROM ({ORACLES[oracle]})" for name, oracle in ((files.INDEX, "site_index"), (files.LLMS, "llms_txt"), (files.FULL, "full_context"))) + f" UNION ALL SELECT '{files.LINES}', md5(string_agg(line || chr(10), '' ORDER BY ix)) FROM ({ORACLES['json_lines']})")
def render_folder(spark, d):
    """The corpus files of a folder, written in parts, and read again."""
    folder = scratch.folder(spark, "render")
    files.render(simple_pages(spark, d), Options(url=f"https://{relations.HOST}/", output_dir=folder))
    back = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{files.INDEX},{files.LLMS},{files.FULL},{files.LINES}}}").load(folder)
    return back.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.md5("content").alias("digest"))


@plan("stream_pages_once", "SELECT DISTINCT url FROM pages")
def stream_pages_once(spark, d):
    """Pages as a stream, each URL once, appended to a table."""
    folder = scratch.folder(spark, "stream-pages")
    table(spark, d, "pages").unionByName(table(spark, d, "pages")).write.parquet(f"{folder}/in")
    streams.append_pages(streams.stream_pages(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("url")


@F.arrow_udf(T.StringType())
def _capped(body: pa.Array) -> pa.Array:
    out = []
    for data in body.to_pylist():
        try:
            http.read_capped(io.BytesIO(data), "", 4096)
            out.append(None)
        except http.FetchError as e:
            out.append(e.kind)
    return pa.array(out, pa.string())


@plan("body_size_guard", "SELECT page_id, strlen(html)::BIGINT AS bytes, CASE WHEN strlen(html) > 4096 THEN 'TooLarge' END AS error FROM pages")
def body_size_guard(spark, d):
    html = F.col("html").cast("binary")
    return parsed_table(spark, d, "pages").select("page_id", F.octet_length(html).cast("long").alias("bytes"), _capped(html).alias("error"))


def _detector(fn):
    @F.arrow_udf(T.BooleanType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([fn(x.strip()) for x in column.to_pylist()], pa.bool_())

    return run


@plan("json_detect", r"""SELECT doc_id, NOT contains(text, '//') AND NOT contains(text, '/*') AND NOT contains(text, ';') AND length(regexp_replace(text, '[^\[\]{}]', '', 'g')) % 2 = 0 AS hit FROM documents""")
def json_detect(spark, d):
    """Whole texts as values: comment marks, semicolons and odd brackets in them speak against it."""
    value = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("'"))
    body = F.concat(F.lit('{\n"id": '), F.col("doc_id").cast("string"), F.lit(',\n"text": "'), value, F.lit('"\n}'))
    return parsed_table(spark, d, "documents").select("doc_id", _detector(codelang.is_json)(body).alias("hit"))


@plan("dockerfile_detect", "SELECT doc_id, doc_id % 2 = 0 OR regexp_matches(text, '(^|\\n)[ \\t]*(RUN|WORKDIR|COPY|CMD|ENTRYPOINT|ENV|ARG|EXPOSE|LABEL|USER|VOLUME|ADD|ONBUILD)([ \\t]|\\n|$)') AS hit FROM documents")
def dockerfile_detect(spark, d):
    """Whole texts between FROM and an instruction, or a word that only starts like one."""
    end = F.when(F.col("doc_id") % 2 == 0, F.lit("\n  WORKDIR /x")).otherwise(F.lit("\nRUNNING x"))
    return parsed_table(spark, d, "documents").select("doc_id", _detector(codelang.is_dockerfile)(F.concat(F.lit("# build\nFROM base\n"), "text", end)).alias("hit"))


@plan("shell_line_detect", r"""SELECT doc_id, doc_id % 4 < 3 AND NOT regexp_matches(regexp_extract(text, '^[^\n]*'), '[{};]|=>') AS hit FROM documents""")
def shell_line_detect(spark, d):
    """The first line of whole texts after a command, an assignment, export, or a word that is none."""
    k = F.col("doc_id") % 4
    start = F.when(k == 0, F.lit("/usr/bin/grep -r ")).when(k == 1, F.lit("PORT=80 run ")).when(k == 2, F.lit("export ")).otherwise(F.lit("port=80 run "))
    return parsed_table(spark, d, "documents").select("doc_id", _detector(codelang.is_shell_line)(F.concat(start, "text")).alias("hit"))
