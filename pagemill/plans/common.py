"""What the catalogue's plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import scratch
from pagemill.functions import expressions as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, oracle: str | None = None):
    """Registers a query, and its SQL if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows go through parsers."""
    return scratch.spread(table(spark, sf_dir, name))


# Pieces of SQL that several oracles use; {x} is the text.
SQL_TAGS = r"regexp_replace({x}, '(?s)<[^>]*(>|\z)|>', '', 'g')"
SQL_TITLE = "coalesce(" + ", ".join(
    rf"nullif(trim(regexp_replace(regexp_replace(regexp_extract({{x}}, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1), '(?s)<[^>]*(>|\z)|>', '', 'g'), '\s+', ' ', 'g')), '')" for tag in ("title", "h1")
) + ")"
SQL_TOKENS = r"(coalesce(list_sum(list_transform(string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10)), lambda l: greatest(1, ceil(length(l) / 3.8::DOUBLE)::BIGINT))), 0)::BIGINT - CASE WHEN {x} = '' OR {x} LIKE '%' || chr(10) THEN 1 ELSE 0 END)"
SQL_PATH = r"(CASE WHEN regexp_matches({x}, '^[a-z]+://') THEN coalesce(nullif(regexp_extract({x}, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') ELSE {x} END)"
SQL_HOST = r"regexp_extract({x}, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
SQL_SLUG = rf"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({SQL_PATH}, '^/+|/+$', '', 'g'), '[^A-Za-z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'index')"
SQL_FILE = rf"(lpad(ix::VARCHAR, greatest(length(ix::VARCHAR), CASE WHEN total >= 1000 THEN 4 WHEN total >= 100 THEN 3 ELSE 2 END)::INT, '0') || '_' || {SQL_SLUG} || '.md')"
SQL_HREFS = r"""list_filter(regexp_extract_all(html, '(?i)<a\b[^>]*?\shref\s*=\s*["'']?([^"''>\s]*)["'']?', 1), lambda h: h <> '' AND NOT regexp_matches(h, '^(#|javascript:|mailto:)'))"""
#: Pages whose markdown is the html without tags: what SQL can say of a page.
SQL_PAGES = f"""p AS (SELECT *, row_number() OVER (ORDER BY page_id) AS ix, count(*) OVER () AS total, {SQL_TOKENS.format(x='markdown')} AS tokens
FROM (SELECT page_id, url, {SQL_TITLE.format(x='html')} AS title, {SQL_TAGS.format(x='html')} AS markdown FROM pages))"""


def simple_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in DataFrame terms."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", E.title(F.col("html")).alias("title"), E.strip_tags(F.col("html")).alias("markdown"))
    return p.withColumn("tokens", E.tokens(F.col("markdown")))
