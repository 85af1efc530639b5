"""Sitemaps as relations: seeds, recursion over a table of fetched documents, same-site pages in discovery order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import scratch
from pagemill.functions import expressions as E
from pagemill.functions.udfs import gunzip, sitemap_locations, url_normalise

#: Where sitemaps usually lie (fixed values), and documents of a run at most.
USUAL = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml")
MOST_MAPS = 200


def seeds(listed: Column, origin: Column) -> Column:
    """Listed sitemaps, then the usual places that aren't among them."""
    return F.array_union(F.coalesce(listed, F.array().cast("array<string>")), F.array(*[F.concat(origin, F.lit(p)) for p in USUAL]))


def filter_same_site(urls: DataFrame, base_host: str, match: str | None = None, url: str = "url") -> DataFrame:
    """Rows whose host is base_host or below it and whose URL holds match."""
    kept = urls.where(E.same_site(E.url_host(F.col(url)), base_host))
    return kept.where(F.col(url).contains(match)) if match else kept


def keep_first(urls: DataFrame, url: str = "url", order: str = "ord") -> DataFrame:
    """Each URL's first row by order; minima are pre-aggregated, so a common URL is no hot key."""
    rest = [c for c in urls.columns if c not in (url, order)]
    picked = urls.groupBy(url).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return picked.select(url, *[F.col("_r")[c].alias(c) for c in (order, *rest)])


def located(documents: DataFrame) -> DataFrame:
    """(url, body) -> (url, urls, subs), unpacked and parsed."""
    return documents.select("url", sitemap_locations(gunzip("url", "body")).alias("_l")).select("url", "_l.urls", "_l.subs")


def collect_urls(documents: DataFrame, seed_urls: list[str], base_host: str, match: str | None = None, limit: int | None = None, most: int = MOST_MAPS) -> DataFrame:
    """(ord, url): pages of all sitemaps reachable from the seeds, in the order of a last-in-first-out walk.

    documents holds fetched sitemaps (url, body); a missing one counts as a failure. They are parsed once. The walk's order
    is a property of at most ``most`` maps, so the driver follows names of maps alone: each round brings the children of
    all maps that are known but not yet read, as many as can still be walked. Pages never leave the executors.
    """
    spark = documents.sparkSession
    parsed = scratch.cut(located(documents), "sitemaps")
    subs: dict[str, list[str] | None] = {}

    def read(names: list[str]) -> None:
        wanted = [n for n in dict.fromkeys(names) if n not in subs][-most:]
        subs.update(dict.fromkeys(wanted))
        subs.update((r["url"], r["subs"]) for r in parsed.where(F.col("url").isin(wanted)).select("url", "subs").collect())

    stack, visited, order = list(seed_urls), set(), []
    while stack and len(visited) < most:
        now = stack.pop()
        if now in visited:
            continue
        visited.add(now)
        if now not in subs:
            read([*stack, now])
        if subs[now] is not None:
            order.append(now)
            stack.extend(s for s in subs[now] if s not in visited)
    names = spark.createDataFrame([(u, k) for k, u in enumerate(order)], "url string, map_ix int")
    pages = parsed.join(F.broadcast(names), "url").select("map_ix", F.posexplode("urls").alias("pos", "page"))
    pages = pages.withColumn("url", url_normalise("page")).where("url IS NOT NULL")
    place = F.col("map_ix").cast("long") * (1 << 40) + F.col("pos")
    first = keep_first(filter_same_site(pages, base_host, match).select("url", place.alias("ord"))).select("ord", "url")
    return first if limit is None else first.orderBy("ord").limit(limit)


def llms_full_text(candidates: DataFrame) -> DataFrame:
    """(origin, priority, status, content_type, body) -> (origin, body): the first usable llms text of each origin.

    A transport error (null status) of the first candidate rules out the second.
    """
    first_failed = candidates.where("priority = 0 AND status IS NULL").select("origin").distinct()
    good = candidates.where(E.usable_llms_body(F.col("status"), F.col("content_type"), F.col("body"))).join(first_failed, "origin", "left_anti")
    return good.groupBy("origin").agg(F.min_by("body", "priority").alias("body"))
