"""Deep crawls over a table of links: breadth first by levels, depth first by a walk per start."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill import scratch
from pagemill.functions import expressions as E

#: Pages of a crawl that names no number, and its depth.
PAGES, DEPTH = 10, 2


def bfs(edges: DataFrame, start: DataFrame, max_depth: int = DEPTH, cap: int | None = PAGES, cut: Callable[[DataFrame], DataFrame] | None = None, good: DataFrame | None = None) -> DataFrame:
    """(root, node, depth, rank): nodes in the order in which a first-in-first-out crawl visits them.

    edges (src, pos, dst): links in page order. start (root, node): a row per crawl; crawls of many roots go on at once.
    good (node): pages that can be fetched; others count as seen but are neither returned nor followed. cap: visited
    good pages of a root at most; a level is cut off there, and roots that have as many go no further. Each level is one
    join with the links and one anti-join with the levels before it. cut writes a level, so lineage ends there and no
    level is computed or written twice. Levels are ranked by their place in range partitions, so that one root's large
    front is no single task.
    """
    cut = cut or scratch.cut
    levels = [cut(start.select("root", "node", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("rank")))]
    kept = [_good(levels[0], good)]
    for depth in range(1, max_depth + 1):
        front, seen = kept[-1], reduce(DataFrame.unionByName, levels)
        if cap is not None:
            counts = reduce(DataFrame.unionByName, kept).groupBy("root").agg(F.count("*").alias("_have"))
            front = front.join(counts.where(F.col("_have") < cap).select("root"), "root", "left_semi")
        found = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node"), F.struct("rank", "pos").alias("via"))
        found = found.groupBy("root", "node").agg(F.min("via").alias("via")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        placed = _ranked(cut(found.repartitionByRange("root", "via").sortWithinPartitions("root", "via").withColumn("_row", F.monotonically_increasing_id())))
        before = seen.groupBy("root").agg(F.max("rank").alias("_before"))
        level = placed.join(before, "root").select("root", "node", F.lit(depth).alias("depth"), (F.col("_place") + F.col("_before")).cast("long").alias("rank"))
        level = cut(level)
        if level.isEmpty():
            break
        own = _good(level, good)
        if cap is not None:
            own = _first(own, counts, cap, cut)
        levels.append(level)
        kept.append(own)
    return reduce(DataFrame.unionByName, kept).select("root", "node", "depth", "rank")


def _good(level: DataFrame, good: DataFrame | None) -> DataFrame:
    return level if good is None else level.join(good, "node", "left_semi").select(level.columns)


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (root, ..., _row), range-partitioned and sorted by root: adds _place, from 1 within each root."""
    part = F.shiftright("_row", 33)
    first = rows.groupBy("root", part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    first = first.withColumn("_base", F.sum("_n").over(Window.partitionBy("root").orderBy("_part")) - F.col("_n"))  # a row per partition
    joined = rows.withColumn("_part", part).join(first.drop("_n"), ["root", "_part"])
    return joined.withColumn("_place", F.col("_row") - F.col("_first") + 1 + F.col("_base")).drop("_part", "_first", "_base", "_row")


def _first(level: DataFrame, counts: DataFrame, cap: int, cut) -> DataFrame:
    """The pages of a level that a root still has room for, by rank."""
    rows = cut(level.repartitionByRange("root", "rank").sortWithinPartitions("root", "rank").withColumn("_row", F.monotonically_increasing_id()))
    return _ranked(rows).join(counts, "root").where(F.col("_place") + F.col("_have") <= cap).select(level.columns)


def dfs(edges: DataFrame, max_depth: int = DEPTH, cap: int | None = PAGES) -> DataFrame:
    """edges (root, src, pos, dst) of one crawl per root, the start's src equal to root -> (root, node, depth, rank).

    Last-in-first-out order is sequential by nature, so each root is walked in one task; roots are independent.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        root = frame["root"].iloc[0]
        links = {k: g["dst"].tolist() for k, g in frame.sort_values("pos").groupby("src")}
        stack, seen, out = [(root, 0)], set(), []
        while stack and (cap is None or len(out) < cap):
            node, depth = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((root, node, depth, len(out) + 1))
            if depth < max_depth:
                stack.extend((x, depth + 1) for x in links.get(node, ()) if x not in seen)
        return pd.DataFrame(out, columns=["root", "node", "depth", "rank"])

    return edges.groupBy("root").applyInPandas(walk, "root long, node long, depth int, rank long")


def page_links(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, links) -> (src, pos, dst) among the pages, by URL."""
    out = pages.select(F.col("page_id").alias("src"), F.posexplode("links").alias("pos", "_to"))
    return out.join(pages.select(F.col("url").alias("_to"), F.col("page_id").alias("dst")), "_to").select("src", "pos", "dst")


def same_host(links: DataFrame, host: str, url: str = "url") -> DataFrame:
    """The host filter of a deep crawl: equal hosts, no subdomains, any port."""
    return links.where(E.url_host(F.col(url)) == host)
