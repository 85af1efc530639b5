"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import drop_table, write_table


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node long, component long): the smallest node reachable, for every node of an edge between two different nodes.

    Each step moves every edge towards the smallest node of its neighbourhood, O(log n) steps in practice. Minima are
    pre-aggregated before their shuffle, so a node with very many edges costs no more than others; the joins that
    follow are plain sort-merge joins, whose hot keys adaptive execution splits. Each step is written to the shared
    folder, which cuts lineage. Null ends and loops are ignored; an empty table gives an empty one.
    """
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    now = write_table(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = write_table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_table(now)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
