"""Page and text projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import expressions as E
from pagemill.functions import udfs
from pagemill.operators import pages as P
from pagemill.operators.corpus import numbered
from pagemill.options import Options
from pagemill.plans.common import SQL_FILE, SQL_HOST, SQL_HREFS, SQL_PATH, SQL_SLUG, SQL_TAGS, SQL_TITLE, SQL_TOKENS, parsed_table, plan, table


@plan("page_summary", f"SELECT page_id, url, {SQL_TITLE.format(x='html')} AS title, {SQL_TOKENS.format(x=SQL_TAGS.format(x='html'))} AS tokens, len({SQL_HREFS})::BIGINT AS n_links FROM pages")
def page_summary(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", "url", E.title(html).alias("title"), E.tokens(E.strip_tags(html)).alias("tokens"), F.size(E.hrefs(html)).cast("long").alias("n_links"))


@plan("page_title", f"SELECT page_id, {SQL_TITLE.format(x='html')} AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", E.title(F.col("html")).alias("title"))


@plan("token_estimate", f"SELECT doc_id, {SQL_TOKENS.format(x='text')} AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", E.tokens(F.col("text")).alias("tokens"))


@plan("strip_tags", f"SELECT page_id, md5({SQL_TAGS.format(x='html')}) AS digest FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(E.strip_tags(F.col("html"))).alias("digest"))


@plan("whitespace_collapse", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def whitespace_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(E.collapse(F.col("text"))).alias("digest"))


@plan("page_links_raw", f"SELECT page_id, generate_subscripts(l, 1)::INT - 1 AS pos, unnest(l) AS href FROM (SELECT page_id, {SQL_HREFS} AS l FROM pages)")
def page_links_raw(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(E.hrefs(F.col("html"))).alias("pos", "href"))


@plan("page_links_resolved", f"""SELECT page_id, generate_subscripts(l, 1)::INT - 1 AS pos, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || array_to_string(list_transform(string_split(unnest(l), ''), lambda c: CASE WHEN unicode(c) > 126 OR c IN (' ', '"', '<', '>', '^', '`', '{{', '}}') THEN url_encode(c) ELSE c END), '') AS link
FROM (SELECT page_id, url, {SQL_HREFS} AS l FROM pages)""")
def page_links_resolved(spark, d):
    joined = udfs.url_join_all(F.col("url"), E.hrefs(F.col("html")))
    return parsed_table(spark, d, "pages").select("page_id", F.posexplode(joined).alias("pos", "link"))


#: Chrome elements that hold no others.
SQL_CHROME = "SELECT page_id, md5(regexp_replace(html, '(?is)<(nav|footer|aside|form|style|script|noscript|button)\\b[^>]*>.*?</(nav|footer|aside|form|style|script|noscript|button)>', '', 'g')) AS digest FROM pages"


@plan("strip_chrome", SQL_CHROME)
def strip_chrome(spark, d):
    """The whole operator; on pages without nested chrome it equals the regular expression."""
    return parsed_table(spark, d, "pages").select("page_id", F.md5(udfs.html_strip_chrome("html")).alias("digest"))


@plan("strip_chrome_simple", SQL_CHROME)
def strip_chrome_simple(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(E.strip_chrome_simple(F.col("html"))).alias("digest"))


@plan("css_scope", """SELECT page_id, replace(replace(replace(replace(replace(string_agg(h, chr(10) ORDER BY k), '&quot;', '"'), '&copy;', '©'), '&amp;', '&'), '&amp', '&'), '&', '&amp;') AS scoped FROM (SELECT page_id, generate_subscripts(l, 1) AS k, unnest(l) AS h FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h1>.*?</h1>') AS l FROM pages)) GROUP BY page_id""")
def css_scope(spark, d):
    return parsed_table(spark, d, "pages").select("page_id", udfs.html_scope("html", F.lit("article > h1")).alias("scoped")).where("scoped IS NOT NULL")


@plan("slug_filename", f"SELECT page_id, {SQL_SLUG.format(x='url')} AS slug, {SQL_FILE.format(x='url')} AS file FROM (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS ix, count(*) OVER () AS total FROM pages)")
def slug_filename(spark, d):
    p = numbered(table(spark, d, "pages").select("page_id", "url"))
    return p.select("page_id", E.slug(F.col("url")).alias("slug"), E.page_filename(F.col("ix"), F.col("total"), F.col("url")).alias("file"))


@plan("url_parts", f"SELECT page_id, {SQL_PATH.format(x='url')} AS path, {SQL_HOST.format(x='url')} AS host, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages")
def url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", E.url_path(url).alias("path"), E.url_host(url).alias("host"), E.url_origin(url).alias("origin"))


@plan("url_normalise", "SELECT page_id, url AS normal FROM pages")
def url_normalise(spark, d):
    """Upper-case schemes and default ports come off again."""
    odd = F.concat(F.upper(F.regexp_extract("url", r"^([a-z]+)://", 1)), F.lit("://"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.when(F.col("url").startswith("https"), ":443").otherwise(":80"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*(.*)$", 1))
    return table(spark, d, "pages").select("page_id", udfs.url_normalise(odd).alias("normal"))


@plan("metadata_header", f"""SELECT doc_id, md5('---' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'title: "' || replace(lang || ' "' || source, '"', '\\"') || '"' || chr(10) END || 'source: https://example.com/' || doc_id || chr(10) || 'tokens: ' || {SQL_TOKENS.format(x='text')} || chr(10) || '---' || chr(10) || chr(10) || text) AS digest FROM documents""")
def metadata_header(spark, d):
    title = F.when(F.col("doc_id") % 3 != 0, F.concat("lang", F.lit(' "'), "source"))
    return table(spark, d, "documents").select("doc_id", F.md5(E.metadata_header(F.col("text"), F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")), title)).alias("digest"))


@plan("blank_line_norm", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10)), '(?m)[ \t]+$', '', 'g'), '\A\n+', chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '\s+\z', '') || chr(10)) AS digest FROM documents""")
def blank_line_norm(spark, d):
    spread = F.replace(F.col("text"), F.lit(". "), F.lit(".  \n\n\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(E.blank_lines(spread)).alias("digest"))


@plan("structural_counts", "SELECT page_id, (length(html) - length(replace(replace(html, '{', ''), '}', '')))::BIGINT AS braces, (length(html) - length(replace(html, ';', '')))::BIGINT AS semicolons, ((length(html) - length(replace(html, '\">', ''))) / 2)::BIGINT AS pairs FROM pages")
def structural_counts(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", E.char_count(html, "{}").alias("braces"), E.char_count(html, ";").alias("semicolons"), E.pair_count(html, '">').alias("pairs"))


@plan("charset_decode", "SELECT doc_id, md5(text) AS digest FROM documents")
def charset_decode(spark, d):
    """Texts in Latin-1 with a header that says so."""
    body = F.encode("text", "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", F.md5(udfs.decode_body(F.lit("text/html; charset=iso-8859-1"), body)).alias("digest"))


@plan("html_to_markdown")
def html_to_markdown(spark, d):
    return parsed_table(spark, d, "pages").select("page_id", udfs.html_to_md("html", F.lit(False), F.lit(False)).alias("markdown"))


@plan("prune")
def prune(spark, d):
    return parsed_table(spark, d, "pages").select("page_id", udfs.html_prune("html").alias("content"))


@plan("pages_to_markdown")
def pages_to_markdown(spark, d):
    return P.good_pages(P.transform_pages(P.raw_pages(parsed_table(spark, d, "pages"))))


@plan("pages_pruned_with_citations")
def pages_pruned_with_citations(spark, d):
    return P.good_pages(P.transform_pages(P.raw_pages(parsed_table(spark, d, "pages")), Options(prune=True, refs=True)))


CODE = {0: "def f(x):\\n    return x\\n", 1: "const f = (x) => x;\\nconsole.log(f(1));\\n", 2: "SELECT a FROM t WHERE b = 1;\\n", 3: "npm i thing", 4: "just words here"}


@plan("guess_language", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'sql' WHEN 3 THEN 'bash' END AS language FROM documents")
def guess_language(spark, d):
    code = F.lit(None).cast("string")
    for k, text in CODE.items():
        code = F.when(F.col("doc_id") % 5 == k, F.lit(text.replace("\\n", "\n"))).otherwise(code)
    return table(spark, d, "documents").select("doc_id", udfs.guess_code_language(code).alias("language"))


@plan("fence_norm", "SELECT doc_id, md5('```sql' || chr(10) || 'SELECT a FROM t;' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || lang || chr(10) || source || chr(10) || '```') AS digest FROM documents")
def fence_norm(spark, d):
    """An untagged block gets its language, a prefixed tag loses its prefix, text between blocks stays."""
    md = F.concat(F.lit("```\nSELECT a FROM t;\n```\n"), "text", F.lit("\n```language-"), "lang", F.lit("\n"), "source", F.lit("\n```"))
    return table(spark, d, "documents").select("doc_id", F.md5(udfs.md_fences(md)).alias("digest"))


@plan("citations_full", "SELECT doc_id, md5(text || chr(10) || 'see one[1], two[2] and one again[1], `[three](/z)`' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '[1]: https://example.com/x?a=' || doc_id || chr(10) || '[2]: https://example.com/d/' || lang || chr(10)) AS digest FROM documents")
def citations_full(spark, d):
    """Whole texts before links: absolute, relative and repeated ones, and one in code."""
    first = F.concat(F.lit("](/x?a="), F.col("doc_id").cast("string"), F.lit(")"))
    md = F.concat("text", F.lit("\nsee [one"), first, F.lit(", [two]("), "lang", F.lit(") and [one again"), first, F.lit(", `[three](/z)`"))
    return parsed_table(spark, d, "documents").select("doc_id", F.md5(udfs.md_citations(md, F.lit("https://example.com/d/i"), F.lit(True))).alias("digest"))


@plan("citation_numbers", f"""WITH l AS (SELECT page_id, generate_subscripts(x, 1) AS pos, unnest(x) AS target FROM (SELECT page_id, {SQL_HREFS} AS x FROM pages)), f AS (SELECT page_id, target, min(pos) AS first FROM l GROUP BY ALL)
SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY first)::INT AS n FROM f""")
def citation_numbers(spark, d):
    from pyspark.sql import Window

    links = table(spark, d, "pages").select("page_id", F.posexplode(E.hrefs(F.col("html"))).alias("pos", "target"))
    first = links.groupBy("page_id", "target").agg(F.min("pos").alias("first"))
    return first.select("page_id", "target", F.row_number().over(Window.partitionBy("page_id").orderBy("first")).alias("n"))
