"""Resharding by minimum-cost flow.

Bytes that stay in a shard cost nothing, bytes that move cost one each. The flow from the old shards' sizes to the new
shards' capacities that moves the fewest bytes is solved on the driver (its size is the number of shards); blocks of
rows then carry it out, and only files of shards that gain or lose rows are rewritten.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import documents, drop_table, new_path, unused, write_table

#: Rows of a block that a flow cuts, about, and blocks of an old shard at most; a block with HOT times as many rows as the
#: mean, as of a row that is repeated very often, is dealt out over as many more.
BLOCK_ROWS, MOST_BLOCKS, HOT = 256, 4096, 8
#: Rows that one window numbers, about, and groups of a shard at most.
SLOT_ROWS, MOST_GROUPS = 20_000, 4096
#: Of tables and shards, which hold whole rows.
CODEC = "zstd"


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """{(i, j): bytes} of least cost(i, j) per byte; successive shortest paths with potentials on the residual graph."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # [to, room, cost, place of the reverse edge]

    def edge(a: int, b: int, room: int, c: float) -> None:
        graph[a].append([b, room, c, len(graph[b])])
        graph[b].append([a, 0, -c, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(source, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, cost(i, j))
    for j, x in enumerate(capacity):
        edge(n + j, sink, x, 0)
    height = [0.0] * len(graph)
    while True:
        far, back, heap = {source: 0.0}, {}, [(0.0, source)]
        done = set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for k, (b, room, c, _) in enumerate(graph[a]):
                if room and b not in done and (x := d + c + height[a] - height[b]) < far.get(b, float("inf")):
                    far[b], back[b] = x, (a, k)
                    heapq.heappush(heap, (x, b))
        if sink not in far:
            break
        for b in range(len(graph)):
            height[b] += far.get(b, far[sink])
        room, b = float("inf"), sink
        while b != source:
            a, k = back[b]
            room, b = min(room, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = back[b]
            graph[a][k][1] -= room
            graph[b][graph[a][k][3]][1] += room
            b = a
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def reshard(rows: DataFrame, capacity, cost=None) -> DataFrame:
    """rows (doc_id, size, key, old_shard, ...) -> the same and shard, slot; one row per row.

    capacity(total) gives the new shards' bytes, which must sum to at least total; cost(i, j) of moving a byte from old
    shard i to new shard j is 0 for i = j and else 1 by default. key is a hash of the row, by which rows fall into
    blocks. Whole blocks follow the flow; of a block that a flow cuts, rows go by descending size to the destination
    with the most room left. slot numbers a shard's rows from 0 without gaps. A null size counts as 0; null doc_ids and
    keys are values like others; old_shard must not be null. Equal rows tie and are interchangeable, and many of them
    spread over blocks. Other columns pass through; where one is called shard or slot already, the new one gets a name
    with an underscore before it. An empty table gives an empty one.
    """
    spark, columns = rows.sparkSession, rows.columns
    rest = [c for c in columns if c not in ("doc_id", "size", "key", "old_shard")]
    shard, slot = unused("shard", columns), unused("slot", columns)
    rows = rows.select("doc_id", "size", "key", "old_shard", F.struct(*rest, F.lit(0).alias(unused("row", rest))).alias("_rest"), F.monotonically_increasing_id().alias("_row"))
    rows = write_table(rows.withColumn("_bytes", F.coalesce(F.col("size"), F.lit(0)).cast("long")), "reshard-rows", CODEC)
    out = _reshard(rows, capacity, cost)
    drop_table(rows)  # all rows lie in the table that _reshard wrote
    return out.select(*[F.col("_rest")[c].alias(c) if c in rest else F.col(c) for c in columns], F.col("shard").alias(shard), F.col("slot").alias(slot))


def _reshard(rows: DataFrame, capacity, cost) -> DataFrame:
    """rows (doc_id, size, key, old_shard, _bytes, _row, ...), a written table -> the same and shard, slot."""
    spark = rows.sparkSession
    sizes = {r["old_shard"]: (r["bytes"], r["rows"]) for r in rows.groupBy("old_shard").agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("rows")).collect()}
    olds = sorted(sizes)
    goal = capacity(sum(b for b, _ in sizes.values()))
    flow = min_cost_flow([sizes[o][0] for o in olds], goal, lambda i, j: (cost or (lambda a, b: int(a != b)))(olds[i], j))
    blocks = {o: int(np.clip(sizes[o][1] // BLOCK_ROWS, 1, MOST_BLOCKS)) for o in olds}
    number = _table(spark, {"old_shard": (pa.int32(), olds), "_blocks": (pa.int32(), [blocks[o] for o in olds])})
    dealt = rows.join(F.broadcast(number), "old_shard").withColumn("_block", F.pmod(F.xxhash64(F.lit(6), "key"), F.col("_blocks")).cast("int"))
    found = dealt.groupBy("old_shard", "_block").agg(F.sum("_bytes").alias("n"), F.count("*").alias("rows")).collect()  # blocks' number is bounded
    hot = [(r["old_shard"], r["_block"], -(-r["rows"] // BLOCK_ROWS)) for r in found if r["rows"] > HOT * max(BLOCK_ROWS, sizes[r["old_shard"]][1] // blocks[r["old_shard"]])]
    hot = [(o, b, min(n, MOST_BLOCKS)) for o, b, n in hot]
    if hot:
        firsts = np.cumsum([0] + [n for _, _, n in hot])[:-1] + MOST_BLOCKS
        over = _table(spark, {"old_shard": (pa.int32(), [h[0] for h in hot]), "_block": (pa.int32(), [h[1] for h in hot]), "_more": (pa.int32(), [h[2] for h in hot]), "_first": (pa.int32(), firsts)})
        dealt = dealt.join(F.broadcast(over), ["old_shard", "_block"], "left")
        spread = F.col("_first") + F.pmod(F.xxhash64("_row"), F.col("_more"))
        dealt = dealt.withColumn("_block", F.coalesce(spread, F.col("_block")).cast("int")).drop("_first", "_more")
        found = dealt.groupBy("old_shard", "_block").agg(F.sum("_bytes").alias("n")).collect()
    weights = {(r["old_shard"], r["_block"]): r["n"] for r in found}

    whole, cut = [], []
    for i, o in enumerate(olds):
        # What stays comes first, then the other destinations.
        ways = sorted(((j, x) for (a, j), x in flow.items() if a == i), key=lambda way: (way[0] != o, way[0]))
        ends = np.cumsum([x for _, x in ways])
        at = 0
        for b in sorted(b for a, b in weights if a == o):
            n = weights[o, b]
            parts = [(j, int(min(at + n, end) - max(at, end - x))) for (j, x), end in zip(ways, ends) if min(at + n, end) > max(at, end - x)]
            if len(parts) <= 1:  # a block without bytes goes where the flow stands
                whole.append((o, b, parts[0][0] if parts else next((j for (j, _), end in zip(ways, ends) if end >= at), o if o < len(goal) else 0)))
            else:
                cut.append((o, b, [j for j, _ in parts], [q for _, q in parts]))
            at += n
    kinds = {"old_shard": (pa.int32(), [w[0] for w in whole] + [c[0] for c in cut]), "_block": (pa.int32(), [w[1] for w in whole] + [c[1] for c in cut]), "shard": (pa.int32(), [w[2] for w in whole] + [None] * len(cut)), "_to": (pa.list_(pa.int32()), [None] * len(whole) + [c[2] for c in cut]), "_room": (pa.list_(pa.int64()), [None] * len(whole) + [c[3] for c in cut])}
    placed = dealt.join(F.broadcast(_table(spark, kinds)), ["old_shard", "_block"])
    columns = rows.columns

    def deal(table: pa.Table) -> pa.Table:  # sees sizes and keys only, never the rows' other columns
        table = table.sort_by([("_bytes", "descending"), ("key", "ascending")])
        to, room = table["_to"][0].as_py(), table["_room"][0].as_py()
        shards = []
        for size in table["_bytes"].to_pylist():
            k = max(range(len(to)), key=lambda k: room[k])
            room[k] -= size
            shards.append(to[k])
        return table.select(["_row"]).append_column("shard", pa.array(shards, pa.int32()))

    some = placed.where("shard IS NULL")
    places = some.select("_row", "_bytes", "key", "old_shard", "_block", "_to", "_room").groupBy("old_shard", "_block").applyInArrow(deal, "_row long, shard int")
    some = some.drop("shard").join(places, "_row").select(*columns, "shard")
    moved = write_table(placed.where("shard IS NOT NULL").select(*columns, "shard").unionByName(some), "reshard-moved", CODEC)
    return _slots(moved, len(goal))


def _slots(rows: DataFrame, shards: int) -> DataFrame:
    """Adds slot: hash groups of each shard follow one another, and rows are numbered within their group."""
    spark = rows.sparkSession
    groups = int(np.clip(rows.count() // shards // SLOT_ROWS, 16, MOST_GROUPS))
    grouped = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(7), "key", "doc_id"), F.lit(groups)).cast("int"))
    count = lambda: grouped.groupBy("shard", "_group").agg(F.count("*").alias("n")).toPandas().sort_values(["shard", "_group"])
    found = count()
    hot = found[found["n"] > HOT * max(SLOT_ROWS, found["n"].mean())] if len(found) else found
    if len(hot):  # of rows that are repeated very often
        more = np.minimum(-(-hot["n"] // SLOT_ROWS), MOST_GROUPS)
        over = _table(spark, {"shard": (pa.int32(), hot["shard"]), "_group": (pa.int32(), hot["_group"]), "_more": (pa.int32(), more), "_first": (pa.int32(), groups + np.cumsum(more) - more)})
        grouped = grouped.join(F.broadcast(over), ["shard", "_group"], "left").withColumn("_group", F.coalesce(F.col("_first") + F.pmod(F.xxhash64("_row"), F.col("_more")), F.col("_group")).cast("int")).drop("_more", "_first")
        found = count()
    found["base"] = found.groupby("shard")["n"].cumsum() - found["n"]
    base = _table(spark, {"shard": (pa.int32(), found["shard"]), "_group": (pa.int32(), found["_group"]), "_base": (pa.int64(), found["base"])})
    order = F.row_number().over(Window.partitionBy("shard", "_group").orderBy("doc_id", "key", "size", "_row"))
    return grouped.withColumn("_order", order).join(F.broadcast(base), ["shard", "_group"]).withColumn("slot", (F.col("_base") + F.col("_order") - 1).cast("long")).drop("_group", "_order", "_base")


def _table(spark, columns: dict) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array(list(v), kind) for k, (kind, v) in columns.items()}))


def rewrite_affected(docs: DataFrame, path: str) -> list[int]:
    """docs (..., old_shard, shard, slot) as reshard() returns them, dealt by shard and groups of slots: write the shards
    that gain or lose rows, a folder each; which ones they are."""
    changed = docs.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    numbers = sorted(r["shard"] for r in changed.collect())  # at most one per shard
    docs.where(F.col("shard").isin(numbers)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression=CODEC)
    return numbers


def carry_out(docs: DataFrame, path: str) -> DataFrame:
    """docs as for rewrite_affected -> the same rows: those of rewritten shards from their files, the others as they were.

    Columns and values are those of docs; a shard that has lost all rows has no files; an empty table gives an empty one.
    """
    numbers = rewrite_affected(docs, path)
    back = docs.sparkSession.read.schema(docs.schema).parquet(path).select(*docs.columns)
    rest = docs.where(~F.col("shard").isin(numbers))
    return back if rest.select("shard").isEmpty() else back.unionByName(rest)


#: The layout that the query starts from, and the shards that it fills.
OLD_SHARDS, NEW_SHARDS = 16, 24


def query(spark, sf_dir: str) -> DataFrame:
    """From 16 shards by a hash of doc_id to 24 of equal bytes; sizes and digests are of the texts in the shards' files."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size, digest = (F.octet_length(text) + 8).cast("long"), F.crc32(text)
    rows = documents(spark, sf_dir).select("doc_id", size.alias("size"), F.xxhash64("doc_id", digest).alias("key"), "text")
    rows = rows.withColumn("old_shard", F.pmod(F.xxhash64(F.lit(16), "doc_id"), F.lit(OLD_SHARDS)).cast("int"))
    out = carry_out(reshard(rows, lambda total: capacities(total, NEW_SHARDS)), new_path(spark, "reshard-shards"))
    return out.select("doc_id", size.alias("size"), digest.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
