"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's rows fall into permuted blocks by a keyed hash. A source's target fixes exactly how often each block is
drawn. The draws of all sources are then split recursively among the output shards: at each tree node the left half's
share of every source is one multivariate-hypergeometric draw, so quotas are exact and the result has the law of a
global shuffle, with no global shuffle. Each shard takes disjoint runs of every source's permuted draws and orders
them locally.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import SPACE, documents, unused, word_count, write_table

#: Permuted blocks of a source: 2 to the power of MOST_BITS at most, BLOCK_WORDS words each or more. All sources together
#: have about CELLS blocks and one each, however large the corpus, so the driver's plan has a bound but for the sources.
BLOCK_WORDS, MOST_BITS, CELLS = 1 << 20, 16, 1 << 18
#: Output shards, and about how many words one holds between these bounds.
SHARDS, SHARD_WORDS = (64, 1 << 18), 1 << 24
#: Sub-blocks by which the one block that a target cuts is refined, as a power of two.
SUB_BITS = 12
#: Equal rows above which each copy gets a hash of its own, so that they spread over blocks.
COPIES = 1024
#: Rows of a plan's table up to which it is broadcast by hand (some 50 bytes each); beyond, Spark picks the join.
BROADCAST_ROWS = 100_000


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; what is cut off is shared anew until none is above."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        sum_w = sum(weights[k] for k in free)
        over = [k for k in free if left * weights[k] / sum_w > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * weights[k] / sum_w
            break
        for k in over:
            out[k] = float(most * sizes[k])
            free.discard(k)
        left = max(0.0, total - sum(out[k] for k in range(len(sizes)) if k not in free))
    return out


def deal(counts: np.ndarray, shards: int, rng: np.random.Generator, first: int = 0, at: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """[(shard, sources, draws)]: the tree's leaves, with those sources only that have draws there."""
    at = np.flatnonzero(counts) if at is None else at
    counts = counts[counts > 0]
    if shards == 1 or not len(at):
        return [(first, at, counts)] if len(at) else []
    half, total = shards // 2, int(counts.sum())
    left = rng.multivariate_hypergeometric(counts, total * half // shards, method="marginals")
    right = counts - left
    return deal(left, half, rng, first, at[left > 0]) + deal(right, shards - half, rng, first + half, at[right > 0])


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: how many of each source's draws every shard gets."""
    out = np.zeros((shards, len(counts)), np.int64)
    for shard, at, own in deal(counts, shards, rng):
        out[shard, at] = own
    return out


@dataclass(frozen=True)
class Plan:
    """sources and blocks: one row each; shards: how many."""

    sources: DataFrame
    blocks: DataFrame
    shards: int


def row_hash(docs: DataFrame, seed: int) -> Column:
    """A keyed 64-bit hash of a row; repeated rows share it."""
    text = F.xxhash64("text") if "text" in docs.columns else F.lit(0)
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("source"), text)


def with_size(docs: DataFrame, seed: int) -> DataFrame:
    """Adds the working columns _size and _h."""
    return docs.withColumns({"_size": word_count(F.col("text")), "_h": row_hash(docs, seed)})


def copies_of(sized: DataFrame) -> DataFrame | None:
    """Of hashes that more than COPIES rows of sized (_h, _row) share, how many come before each partition's."""
    hot = sized.groupBy("_h").agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select("_h")
    hot = write_table(hot, "mix-copies")
    if hot.isEmpty():
        return None
    per = sized.join(hot, "_h", "left_semi").groupBy("_h", F.shiftright("_row", 33).alias("_pid")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_h").orderBy("_pid")) - F.col("n")  # a row per partition of the table
    return write_table(per.select("_h", "_pid", before.alias("_before")), "mix-copies")


def spread_copies(sized: DataFrame, copies: DataFrame | None) -> DataFrame:
    """_h anew for rows that copies names: with the copy's number, so the same hashes come about on every run. The number
    counts within a partition, after those of the partitions before it; no window holds more than one partition's rows."""
    if copies is None:
        return sized
    marked = sized.withColumn("_pid", F.shiftright("_row", 33)).join(_near(copies, copies.count()), ["_h", "_pid"], "left")
    number = F.row_number().over(Window.partitionBy("_h", "_pid").orderBy("_row")) + F.col("_before")
    hot = marked.where("_before IS NOT NULL").withColumn("_h", F.xxhash64("_h", number.cast("long")))
    return marked.where("_before IS NULL").unionByName(hot).drop("_pid", "_before")


def with_block(rows: DataFrame) -> DataFrame:
    """Adds _block and _sub, the leading bits of the row hash; _bits says how many a block has."""
    block = F.expr("cast(shiftright(cast(shiftrightunsigned(_h, 48) as int), 16 - _bits) as int)")
    return rows.withColumns({"_block": block, "_sub": F.expr(f"cast(shiftrightunsigned(shiftleft(_h, _bits), {64 - SUB_BITS}) as int)")})


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.withColumnRenamed("source", "_source")
    return rows.join(s, rows["source"].eqNullSafe(s["_source"])).drop("_source")


def make_plan(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: int = 3, shards: int | None = None, seed: int = 20) -> Plan:
    """From sized (source, _size, _h). Reads it three times; the driver holds a row per source, and CELLS blocks or so."""
    spark = sized.sparkSession
    whole_of = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("_size").alias("n")).collect()}
    names = sorted(whole_of, key=lambda s: (s is None, s or ""))
    sizes = [int(whole_of[s]) for s in names]
    words = sum(sizes)
    least = int(np.clip((CELLS // max(len(names), 1)).bit_length() - 1, 0, 8))
    bits = [int(np.clip((n // max(BLOCK_WORDS, words // CELLS)).bit_length(), least, MOST_BITS)) for n in sizes]
    shards = shards or int(np.clip(words // SHARD_WORDS, *SHARDS))
    numbers = {"source": (pa.string(), names), "_sid": (pa.int32(), range(len(names))), "_bits": (pa.int32(), bits)}
    rows = with_block(_with_source(sized, _near(_small(spark, numbers), len(names))))
    cells = rows.groupBy("_sid", "_block").agg(F.sum("_size").alias("n")).toArrow()
    sid, block, size = (cells.column(c).to_numpy() for c in ("_sid", "_block", "n"))
    order = np.lexsort((block, sid))
    sid, block, size = sid[order], block[order], size[order]
    start = np.searchsorted(sid, np.arange(len(names) + 1))
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], share * words, most)

    epochs = [min(most, int(g // n)) if n else 0 for g, n in zip(goal, sizes)]
    rest = [int(round(g - e * n)) for g, e, n in zip(goal, epochs, sizes)]
    rng = [np.random.default_rng([seed, zlib.crc32(repr(s).encode("utf-8", "surrogatepass"))]) for s in names]
    state = np.zeros(len(sid), np.int8)  # of the last, partial epoch: 0 not drawn, 1 whole, 2 cut
    cut: dict[int, tuple[int, int]] = {}
    for k in range(len(names)):
        own = start[k] + rng[k].permutation(start[k + 1] - start[k])
        sums = np.cumsum(size[own])
        whole = int(np.searchsorted(sums, rest[k], side="right"))
        state[own[:whole]] = 1
        left = rest[k] - (int(sums[whole - 1]) if whole else 0)
        if left > 0:
            state[own[whole]] = 2
            cut[k] = (int(block[own[whole]]), left)
    subs = {k: (-1, 0) for k in range(len(names))}
    if cut:
        marks = _near(_small(spark, {"_sid": (pa.int32(), list(cut)), "_block": (pa.int32(), [b for b, _ in cut.values()]), "_rest": (pa.int64(), [x for _, x in cut.values()])}), len(cut))
        there = rows.join(marks, ["_sid", "_block"]).groupBy("_sid", "_rest", "_sub").agg(F.sum("_size").alias("n"))
        there = there.withColumn("_sum", F.sum("n").over(Window.partitionBy("_sid").orderBy("_sub")))  # sub-blocks of one block
        found = there.where(F.col("_sum") > F.col("_rest")).groupBy("_sid").agg(F.min(F.struct("_sub", (F.col("_rest") - F.col("_sum") + F.col("n")).alias("left"))).alias("r"))
        subs |= {r["_sid"]: (r["r"]["_sub"], r["r"]["left"]) for r in found.collect()}

    draws = np.array([(start[k + 1] - start[k]) * epochs[k] + np.count_nonzero(state[start[k] : start[k + 1]]) for k in range(len(names))], np.int64)
    quotas: dict[int, list[tuple[int, int]]] = {k: [] for k in range(len(names))}
    for shard, at, own in deal(draws, shards, np.random.default_rng(seed)):
        for k, n in zip(at.tolist(), own.tolist()):
            quotas[k].append((shard, n))
    placed: list[list[int]] = [[] for _ in sid]
    last = np.full(len(sid), -1, np.int64)
    for k in range(len(names)):
        own = np.arange(start[k], start[k + 1])
        drawn = np.concatenate([np.tile(own, epochs[k]), own[state[own] > 0]])
        to = np.empty(len(drawn), np.int64)
        to[rng[k].permutation(len(drawn))] = np.repeat([x for x, _ in quotas[k]], [n for _, n in quotas[k]]) if quotas[k] else 0
        whole = len(own) * epochs[k]
        for cell, shards_of in zip(own.tolist(), to[:whole].reshape(epochs[k], len(own)).T.tolist()):
            placed[cell] = shards_of
        last[drawn[whole:]] = to[whole:]
    sources = _small(spark, numbers | {"source_size": (pa.int64(), sizes), "target": (pa.float64(), goal), "_epochs": (pa.int32(), epochs), "_cut_sub": (pa.int32(), [subs[k][0] for k in range(len(names))]), "_left": (pa.int64(), [subs[k][1] for k in range(len(names))])})
    blocks = _small(spark, {"_sid": (pa.int32(), sid), "_block": (pa.int32(), block), "_state": (pa.int32(), state), "_shards": (pa.list_(pa.int32()), placed), "_last_shard": (pa.int32(), last)})
    return Plan(_near(sources, len(names)), _near(blocks, len(sid)), shards)


def _small(spark, columns: dict) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array(list(v), kind) for k, (kind, v) in columns.items()}))


def _near(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def apply_plan(sized: DataFrame, plan: Plan) -> DataFrame:
    """Adds source_size, target, taken and shards (the output shard of each copy, a partial copy last) to sized.

    Only the rows of one sub-block per source, about one in a million of its rows, meet in a window.
    """
    rows = with_block(_with_source(sized, plan.sources)).join(plan.blocks, ["_sid", "_block"])
    edge = (F.col("_state") == 2) & (F.col("_sub") == F.col("_cut_sub"))
    whole = (F.col("_state") == 1) | ((F.col("_state") == 2) & (F.col("_sub") < F.col("_cut_sub")))
    plain = rows.where(~edge).withColumn("_part", F.when(whole, F.col("_size")).otherwise(F.lit(0)).cast("long"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_sid").orderBy("_h", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = rows.where(edge).withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_left") - before)).cast("long"))
    both = plain.unionByName(cut)
    last = F.when(F.col("_part") > 0, F.array("_last_shard")).otherwise(F.array().cast("array<int>"))
    out = both.withColumn("shards", F.concat("_shards", last))
    whole = F.size("shards") - (F.col("_part") > 0).cast("int")  # copies that the tree dealt out
    return out.withColumn("taken", (whole * F.col("_size") + F.col("_part")).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text, source, ...) -> (doc_id, size, source_size, target, taken, shards), one row per row.

    Sizes are ASCII-white-space words; a null text has none, a null source is a source of its own, after the others.
    Each source's taken words equal its target rounded to a word: whole epochs, whole blocks of the last one, and at
    most one document cut short. A document of size 0 takes nothing. Repeated rows are separate documents that tie;
    which of two equal rows is cut changes no result, and many copies spread over blocks and shards. Other columns are ignored; an empty table gives an empty one.
    """
    seed = options.get("seed", 20)
    sized = write_table(with_size(docs.select("doc_id", "text", "source"), seed).drop("text").withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    if (copies := copies_of(sized)) is not None:
        sized = write_table(spread_copies(sized, copies), "mix-spread")
    out = apply_plan(sized, make_plan(sized, **options))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "shards")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs' columns, then _shard and _order: one row for each copy that the mix takes, texts cut where a copy is partial.

    Each output shard is one partition, shuffled locally by the keyed _order; shards grow in number with the corpus. docs
    is read twice and must give the same partitions both times, as a table does. Nulls, ties and repeated rows are as in
    mix(); other columns may have any names; an empty table gives an empty one.
    """
    seed, columns, kinds = options.get("seed", 20), docs.columns, dict(docs.dtypes)
    rest = [c for c in columns if c not in ("doc_id", "text", "source")]
    docs = docs.select("doc_id", "text", "source", F.struct(*rest, F.lit(0).alias(unused("row", rest))).alias("_rest"))  # names can't clash
    whole = with_size(docs, seed).withColumn("_row", F.monotonically_increasing_id())
    sized = write_table(whole.select("doc_id", "source", "_size", "_h", "_row"), "mix-sizes")
    if (copies := copies_of(sized)) is not None:
        sized = write_table(spread_copies(sized, copies), "mix-spread")
    plan = make_plan(sized, **options)
    rows = apply_plan(spread_copies(whole, copies), plan).where("taken > 0")
    copies = rows.select("doc_id", "text", "source", "_rest", "_size", "_part", "_epochs", "_h", F.posexplode("shards").alias("_copy", "_shard"))
    short = (F.col("_copy") == F.col("_epochs")) & (F.col("_part") < F.col("_size"))
    words = F.regexp_extract_all("text", F.lit(rf"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    text = F.when(short, F.array_join(F.slice(words, F.lit(1), F.col("_part").cast("int")), "")).otherwise(F.col("text"))
    copies = copies.select("doc_id", text.alias("text"), "source", "_rest", short.alias("_short"), F.col("_shard").alias("_to"), F.xxhash64(F.lit(seed), "_h", "_copy").alias("_order"))
    whole = {c: F.col("_rest")[c] for c in rest} | {c: F.col(c) for c in ("doc_id", "text", "source")}
    if "n_chars" in rest:
        whole["n_chars"] = F.when(F.col("_short"), F.length("text").cast(kinds["n_chars"])).otherwise(whole["n_chars"])
    out = copies.select(*[whole[c].alias(c) for c in columns], F.col("_to").alias(unused("_shard", columns)), F.col("_order").alias(unused("_order", columns)))
    return out.repartitionById(plan.shards, out.columns[-2]).sortWithinPartitions(out.columns[-1])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a document that is taken twice is there twice, one that isn't taken goes; at most one of a source
    is cut short, with n_chars to match. Null and empty texts take nothing and go; a null source is one of its own; long
    texts, repeated rows and extra columns of any name are as in mixed_rows(); an empty table gives an empty one."""
    return mixed_rows(docs).select(*docs.columns)
