"""Column expressions: what SQL can say about pages, links, markdown and files, so that Catalyst keeps it in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.html import CHROME_TAGS

#: First href of an anchor tag.
HREF = r"""(?i)<a\b[^>]*?\shref\s*=\s*["']?([^"'>\s]*)["']?"""
BLANK = r"\s+"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def strip_tags(text: Column) -> Column:
    """Drops <...>, a lone >, and what follows an unclosed <."""
    return F.regexp_replace(text, r"(?s)<[^>]*(>|\z)|>", "")


def tag_content(html: Column, tag: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)


def title(html: Column) -> Column:
    """The title element's text, else the first h1's, else null."""
    one = lambda tag: F.nullif(collapse(strip_tags(tag_content(html, tag))), F.lit(""))
    return F.coalesce(one("title"), one("h1"))


def tokens(text: Column) -> Column:
    """Estimated tokens: per line at least one, else 3.8 code points each, rounded up; nothing for an empty text."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    count = F.aggregate(lines, F.lit(0).cast("long"), lambda a, line: a + F.greatest(F.lit(1).cast("long"), F.ceil(F.length(line) / F.lit(3.8)).cast("long")))
    return (count - F.when((text == "") | text.endswith("\n"), 1).otherwise(0)).cast("long")


def hrefs(html: Column) -> Column:
    """Targets of anchor tags in document order, but for empty ones, fragments, scripts and mail."""
    return F.filter(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda h: (h != "") & ~h.rlike(r"^(#|javascript:|mailto:)"))


def strip_chrome_simple(html: Column) -> Column:
    """Removes chrome elements that aren't nested in one another; strip_chrome is the whole operator."""
    tags = "|".join(sorted(CHROME_TAGS))
    return F.regexp_replace(html, rf"(?is)<({tags})\b[^>]*>.*?</({tags})>", "")


def blank_lines(md: Column) -> Column:
    md = F.regexp_replace(md, r"(?m)[ \t]+$", "")
    md = F.regexp_replace(md, r"\A\n+", "\n")
    md = F.regexp_replace(md, r"\n{3,}", "\n\n")
    return F.concat(F.regexp_replace(md, r"\s+\z", ""), F.lit("\n"))


def url_path(url: Column) -> Column:
    """The path of an absolute URL, '/' if it has none, the whole text if it isn't one."""
    return F.when(url.rlike(r"^[a-z]+://"), F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))).otherwise(url)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def url_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)


def slug(url: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(url_path(url), r"^/+|/+$", ""), "[^A-Za-z0-9_-]", "-")
    return F.coalesce(F.nullif(F.regexp_replace(plain, "^-+|-+$", ""), F.lit("")), F.lit("index"))


def page_filename(ordinal: Column, total: Column, url: Column) -> Column:
    """ordinal from 1; two digits, three from 100 pages on, four from 1000."""
    number = F.when(total >= 1000, F.format_string("%04d", ordinal)).when(total >= 100, F.format_string("%03d", ordinal)).otherwise(F.format_string("%02d", ordinal))
    return F.concat(number, F.lit("_"), slug(url), F.lit(".md"))


def metadata_header(body: Column, url: Column, title: Column) -> Column:
    """Front matter with the body's own token count, then the body."""
    quoted = F.concat(F.lit('title: "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"\n'))
    return F.concat(F.lit("---\n"), F.coalesce(quoted, F.lit("")), F.lit("source: "), url, F.lit("\ntokens: "), tokens(body).cast("string"), F.lit("\n---\n\n"), body)


def same_site(host: Column, base: str | Column) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return (host == base) | host.endswith(F.concat(F.lit("."), base))


def looks_like_sitemap(url: Column) -> Column:
    return F.lower(url).endswith(".xml") | F.lower(url).contains("sitemap")


def retryable(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def usable_llms_body(status: Column, content_type: Column, body: Column) -> Column:
    start = F.lower(F.regexp_replace(body, r"\A\s+", ""))
    html = F.coalesce(F.lower(content_type).contains("text/html"), F.lit(False))
    return status.between(200, 299) & ~html & ~start.startswith("<!doctype") & ~start.startswith("<html") & (F.octet_length(F.trim(body)) >= 10)


def page_matches(url: Column, title: Column, query: str) -> Column:
    """A search over the page list: a blank query keeps every page."""
    if not query.strip():
        return F.lit(True)
    q = query.lower()
    return F.lower(url).contains(q) | F.coalesce(F.lower(title).contains(q), F.lit(False))


def jsonl(ordinal: Column, url: Column, title: Column, tokens: Column, markdown: Column) -> Column:
    return F.to_json(F.struct(ordinal.alias("index"), markdown.alias("markdown"), title.alias("title"), tokens.alias("tokens"), url.alias("url")), {"ignoreNullFields": "false"})


def pair_count(text: Column, pair: str) -> Column:
    """Places of a pair of two different characters."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(pair), F.lit("")))) / 2).cast("long")


def char_count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
