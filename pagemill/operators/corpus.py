"""Whole-corpus texts: index, llms.txt, full context, JSON lines, one concatenation. Each is an ordered set of lines.

``*_lines`` give (ix, line), a row per page and without the end of line, which sinks write in ordered parts or copy to a file piece by piece; the
single-row texts gather the same lines, and are the size of their output by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import scratch
from pagemill.functions import expressions as E

def numbered(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """Adds ix, the 1-based ordinal by the order column (nulls first, ties in any order), and total.

    Pages are range-partitioned and sorted by the column and by a hash of their URL; a page's ordinal is its place in its
    partition plus the sizes of the partitions before. Only those sizes, one row per partition, meet in a window. The
    sorted rows are written once, so that ordinals and sizes are of the same partitions whatever happens to a task.
    """
    ordered = pages.withColumn("_tie", F.xxhash64("url") if "url" in pages.columns else F.lit(0))
    ordered = ordered.repartitionByRange(order, "_tie").sortWithinPartitions(order, "_tie").drop("_tie")
    kept = scratch.cut(ordered.select("*", F.monotonically_increasing_id().alias("_row")), "numbered")
    part = F.shiftright("_row", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    place = F.col("_row") - F.shiftleft(part, 33) + 1
    return kept.withColumn("_part", part).join(base, "_part").withColumn("ix", (place + F.col("_base")).cast("long")).drop("_part", "_base", "_row")


def _gathered(lines: DataFrame, head: Column) -> DataFrame:
    """One row: head, then each line and its end in the order of ix."""
    rows = F.array_sort(F.collect_list(F.struct("ix", "line")))
    body = F.array_join(F.transform(rows, lambda r: F.concat(r["line"], F.lit("\n"))), "")
    totals = lines.agg(*_totals(), body.alias("body"))
    return totals.select(F.concat(head, F.col("body")).alias("text"))


def _totals() -> list[Column]:
    return [F.count("*").cast("string").alias("pages"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").cast("string").alias("tokens")]


def head_text(pages: DataFrame, head: Column) -> str:
    """The text before the lines: one row of two totals."""
    return pages.agg(*_totals()).select(head.alias("h")).first()["h"]


def _name(url: str = "url", title: str = "title") -> Column:
    return F.coalesce(title, url)


def index_head() -> Column:
    return F.concat(F.lit("# Documentation Index\n\n- **Total Pages:** "), F.col("pages"), F.lit("\n- **Total Estimated Tokens:** ~"), F.col("tokens"), F.lit("\n\n"))


def index_lines(numbered_pages: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- ["), _name(), F.lit("]("), E.page_filename(F.col("ix"), F.col("total"), F.col("url")), F.lit(") — `"), E.url_path(F.col("url")), F.lit("` *(~"), F.col("tokens").cast("string"), F.lit(" tokens)*"))
    return numbered_pages.select("ix", "tokens", line.alias("line"))


def index(pages: DataFrame, order: str = "page_id") -> DataFrame:
    return _gathered(index_lines(numbered(pages, order)), index_head())


def llms_head(host: str | None) -> Column:
    return F.concat(F.lit(f"# {host or 'Documentation'}\n\n> Total documents: "), F.col("pages"), F.lit(" (~"), F.col("tokens"), F.lit(" tokens)\n\n## Documentation\n\n"))


def llms_lines(numbered_pages: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- ["), _name(), F.lit("]("), E.page_filename(F.col("ix"), F.col("total"), F.col("url")), F.lit("): "), E.url_path(F.col("url")), F.lit(" (~"), F.col("tokens").cast("string"), F.lit(" tokens)"))
    return numbered_pages.select("ix", "tokens", line.alias("line"))


def llms_txt(pages: DataFrame, host: str | None = None, order: str = "page_id") -> DataFrame:
    return _gathered(llms_lines(numbered(pages, order)), llms_head(host))


def context_line() -> Column:
    """A page's part of the full context, from ix, url, title, tokens and markdown."""
    quoted = F.replace(F.coalesce("title", F.lit("Untitled")), F.lit('"'), F.lit('\\"'))
    body = F.regexp_replace("markdown", r"\A\s+|\s+\z", "")
    return F.concat(F.lit('<document index="'), F.col("ix").cast("string"), F.lit('" url="'), F.col("url"), F.lit('" title="'), quoted, F.lit('" tokens="'), F.col("tokens").cast("string"), F.lit('">\n'), body, F.lit("\n</document>\n"))


def context_head() -> Column:
    return F.concat(F.lit("# Full Documentation Context\n\n- Total Documents: "), F.col("pages"), F.lit("\n- Total Estimated Tokens: ~"), F.col("tokens"), F.lit("\n\n"))


def context_lines(numbered_pages: DataFrame) -> DataFrame:
    return numbered_pages.select("ix", "tokens", context_line().alias("line"))


def full_context(pages: DataFrame, order: str = "page_id") -> DataFrame:
    return _gathered(context_lines(numbered(pages, order)), context_head())


def concatenation_lines(numbered_pages: DataFrame) -> DataFrame:
    line = F.concat(F.when(F.col("ix") > 1, F.lit("\n---\n\n")).otherwise(F.lit("")), F.regexp_replace("markdown", r"\s+\z", ""))
    return numbered_pages.select("ix", "tokens", line.alias("line"))


def concatenation(pages: DataFrame, order: str = "page_id") -> DataFrame:
    return _gathered(concatenation_lines(numbered(pages, order)), F.lit(""))


def json_lines(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """(ix, line): one JSON object per page."""
    return json_lines_of(numbered(pages, order))


def json_lines_of(numbered_pages: DataFrame) -> DataFrame:
    return numbered_pages.select("ix", E.jsonl(F.col("ix"), F.col("url"), F.col("title"), F.col("tokens"), F.col("markdown")).alias("line"))
