"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a generalised pigeonhole index.

The fingerprint's bits fall into partitions that keep correlated bits together. Two fingerprints within ``radius`` bits
of each other are within t_i bits in at least one partition i whenever sum(t_i + 1) = radius + 1; the thresholds t_i
(-1 leaves a partition out) come from dynamic programming over estimated candidate counts. Index and probes meet in
buckets of (partition, value); every meeting is verified on all 64 bits. Nothing is sampled: the bit statistics and the
index cover every distinct fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import documents, unused, write_table
from pagemill.llm.components import connected_components

#: Rows of a bucket above which it is split over all bits, and above which a part of it is split again and then cut.
HOT_BUCKET, HOT_PART = 4096, 65536
#: Rough costs, in microseconds, of one index or probe row and of verifying one candidate pair.
ROW_COST, PAIR_COST = 2.0, 0.02


# ---------------------------------------------------------------- fingerprints


def fingerprint_of(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit b is 1 if more than half of the shingles' XXH64 have it; no word: 0. A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    digest, n, votes = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # whole texts of any length in bounded memory
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])), "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """keep's columns of every row of docs (text, ...) and fp long, which holds the unsigned fingerprint's bits."""
    sent = [*keep] if "text" in keep else [*keep, F.col("text").alias("_text")]  # a text goes to Python once
    place = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(t.as_py(), shingle, seed) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.array(found, np.uint64).view(np.int64))], names=[*keep, name])

    schema = T.StructType([docs.schema[c] for c in keep]).add(name, "long")
    return docs.select(*sent).mapInArrow(run, schema)


# ---------------------------------------------------------------- plan of the index


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Over all rows of fps (fp long): their number, each bit's frequency, and the bits' correlations (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for batch in batches:
            for at in range(0, batch.num_rows, 65536):
                bits = _bits(batch.column(0).slice(at, 65536).to_numpy(zero_copy_only=False)).astype(np.float32)
                n, both = n + len(bits), both + bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(both.ravel(), n))], names=["at", "sum"])

    total = np.zeros(4097)
    for row in fps.select("fp").mapInArrow(run, "at bigint, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).collect():
        total[row["at"]] = row["sum"]
    n, both = int(total[4096]), total[:4096].reshape(64, 64)
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    return n, share, (both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each grows around its first bit by the largest mean |correlation|."""
    left, groups = set(range(64)), []
    strength = np.abs(correlation) - np.eye(64)
    for k in range(m):
        width = len(left) // (m - k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (strength[b, rest].max(initial=0), -b))]
        left.discard(group[0])
        while len(group) < width:
            rest = sorted(left)
            group.append(max(rest, key=lambda b: (strength[b, group].mean(), -b)))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def plan_index(n: int, share: np.ndarray, correlation: np.ndarray, radius: int = 4, most: int = 2) -> list[tuple[list[int], int]]:
    """[(bits, threshold)]: for each number of partitions, thresholds with the least estimated work; the best of them.

    Estimates: a pair differs in bit b with probability 2 q (1 - q), and a partition's distance follows the Poisson
    binomial law of its bits; a threshold t asks for the rows of all values within t bits.
    """
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, radius + 2):
        groups = grouped_bits(correlation, m)
        costs = []
        for group in groups:
            law = np.array([1.0])
            for b in group:
                p = 2 * share[b] * (1 - share[b])
                law = np.convolve(law, [1 - p, p])
            rows = lambda t, w=len(group): n * (sum(comb(w, d) for d in range(t + 1)) + (t > 0))
            costs.append([0.0] + [rows(t) * ROW_COST + n * n / 2 * law[: t + 1].sum() * PAIR_COST for t in range(most + 1)])
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (c, chosen) in table.items():
                for t in range(-1, most + 1):
                    if (k := min(total + t + 1, radius + 1)) not in step or c + cost[t + 1] < step[k][0]:
                        step[k] = (c + cost[t + 1], [*chosen, t])
            table = step
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            best = (table[radius + 1][0], [(g, t) for g, t in zip(groups, table[radius + 1][1]) if t >= 0])
    return best[1]


# ---------------------------------------------------------------- probe and verify


def _mask(bits: list[int]) -> int:
    word = sum(1 << b for b in bits)
    return word - (1 << 64) if word >> 63 else word


def _keys(fp: Column, plan: list[tuple[list[int], int]]) -> Column:
    """array<struct<side, bucket>>: the bucket that holds a fingerprint (side 0), and those that it probes (side 1)."""
    out = []
    for part, (bits, t) in enumerate(plan):
        own = fp.bitwiseAND(F.lit(_mask(bits)))
        flips = [_mask(list(c)) for d in range(t + 1) for c in combinations(bits, d)]
        out += [F.struct(F.lit(int(x != 0)).alias("side"), F.xxhash64(F.lit(part), own.bitwiseXOR(F.lit(x)).cast("long")).alias("bucket")) for x in flips]
    return F.array(*out)


def _split(rows: DataFrame, hot: DataFrame, level: int, radius: int) -> DataFrame:
    """rows (fp, side, bucket) with each hot bucket dealt out: two rows within radius bits agree on one of radius + 1
    blocks of the 64 bits, so each block's value is a bucket of its own. Levels deal bits to blocks differently."""
    step = (11, 27, 45)[level % 3]
    blocks = [_mask([b for b in range(64) if (b * step) % 64 % (radius + 1) == k]) for k in range(radius + 1)]
    parts = F.array(*[F.xxhash64(F.lit(level), F.lit(k), "bucket", F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(blocks)])
    marked = rows.join(hot.select("bucket", F.lit(True).alias("hot")), "bucket", "left")
    return marked.select("fp", "side", F.explode(F.when(F.col("hot"), parts).otherwise(F.array("bucket"))).alias("bucket"))


def links(fps: DataFrame, radius: int = 4, hot_bucket: int = HOT_BUCKET, hot_part: int = HOT_PART) -> DataFrame:
    """(u long, v long): links between distinct fingerprints of fps (fp long) within radius bits, enough of them that
    their connected components are those of all such links: each bucket gives a spanning forest, not all its pairs.

    A fingerprint lies in one bucket of each partition and probes those within the partition's threshold; held rows meet
    one another and the probes, probes don't meet. A bucket of more than hot_bucket rows is split over all bits; what
    still has more than hot_part rows is split once more, and then cut into pairs of blocks, so no task gathers more
    than two blocks. No bucket is capped. An empty table gives an empty one.
    """
    n, share, correlation = bit_statistics(fps)
    plan = plan_index(n, share, correlation, radius)
    rows = fps.select("fp", F.explode(_keys(F.col("fp"), plan)).alias("k")).select("fp", "k.side", "k.bucket")
    keys = ["bucket"]
    for level, most in enumerate((hot_bucket, hot_part, hot_part)):
        hot = write_table(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most), "hot-buckets")
        if hot.isEmpty():
            break
        if level < 2:
            rows = write_table(_split(rows, hot, level, radius), "hot-split")
            continue
        blocks = F.coalesce(F.ceil(F.col("n") / most).cast("int"), F.lit(1))
        cut = rows.join(hot, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        rows, keys = cut.select("fp", "side", "bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")), ["bucket", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            values = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            new = np.zeros(batch.num_rows, bool)
            for x in values[2:]:
                new[1:] |= x[1:] != x[:-1]
            cuts = np.flatnonzero(new).tolist()
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                key = tuple(int(x[a]) for x in values[2:]) if b > a else last
                if key != last:
                    _flush(held, out, radius)
                    last, held = key, []
                held.append((values[0][a:b], values[1][a:b]))
            yield from _edges(out)
        out = []
        _flush(held, out, radius)
        yield from _edges(out)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select("fp", "side", *keys).mapInArrow(run, "u bigint, v bigint")


def _flush(held: list[tuple[np.ndarray, np.ndarray]], out: list, radius: int) -> None:
    if sum(len(x) for x, _ in held) > 1:
        fps, side = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        found = forest(fps[side == 0].view(np.uint64), radius, fps[side == 1].view(np.uint64))
        if len(found[0]):
            out.append(found)


def _edges(out: list) -> Iterator[pa.RecordBatch]:
    if out:
        u, v = (np.concatenate([x[k] for x in out]).view(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def forest(fps: np.ndarray, radius: int, probes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket: among fps, and between fps and probes; memory stays linear."""
    none = np.zeros(0, np.uint64)
    left = [np.unique(fps), np.unique(none if probes is None else probes)]
    left[1] = np.setdiff1d(left[1], left[0], assume_unique=True)
    if not len(left[0]):
        return none, none
    if len(left[0]) + len(left[1]) <= 256:
        every = np.concatenate(left)
        if np.count_nonzero(np.bitwise_count(left[0][:, None] ^ every) <= radius) == len(left[0]):
            return none, none
    us, vs = [], []
    while len(left[0]):
        wave, left[0] = [(left[0][0], 0)], left[0][1:]
        while wave and (len(left[0]) or len(left[1])):
            at, side = wave.pop()
            for other in (0, 1) if side == 0 else (0,):  # probes don't meet
                near = np.bitwise_count(left[other] ^ at) <= radius
                if near.any():
                    got = left[other][near]
                    us.append(got)
                    vs.append(np.full(len(got), at))
                    wave.extend((x, other) for x in got)
                    left[other] = left[other][~near]
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


# ---------------------------------------------------------------- the operator


def classes_of(table: DataFrame, radius: int = 4) -> DataFrame:
    """table (doc_id, fp) -> (fp, component, component_id), one row per fingerprint: the smallest fingerprint that is
    reachable, and the smallest doc_id of all rows whose fingerprint is."""
    classes = write_table(table.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprint-classes")
    found = write_table(connected_components(links(classes, radius)), "fingerprint-components")
    grouped = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = grouped.groupBy("component").agg(F.min("low").alias("component_id"))
    return write_table(grouped.join(lows, "component").select("fp", "component", "component_id"), "fingerprint-labels")


def near_duplicates(docs: DataFrame, shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fp long, component_id): one row per row of docs.

    component_id is the smallest doc_id whose fingerprint is reachable over links of at most radius differing bits.
    Equal fingerprints are one class from the start, so copies cost one count, not their pairs. Null and empty texts
    have fingerprint 0 and link like any other; a null doc_id gets a row and never names a component unless alone;
    repeated rows each get a row; other columns are ignored; an empty table gives an empty one.
    """
    table = write_table(fingerprints(docs, shingle, seed), "fingerprints")
    return table.join(classes_of(table, radius), "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id, one without a doc_id only if
    none has any; of rows that tie, as repeated rows do, one. Null and empty texts are one group; long texts are read
    whole; extra columns of any name pass through; an empty table gives an empty one. Texts cross the network once, by
    row number, so no hot group gathers them."""
    columns, fp, row = docs.columns, unused("fp", docs.columns), unused("row", docs.columns)
    marked = write_table(fingerprints(docs, keep=tuple(columns), name=fp).withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    light = marked.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"]
    kept = light.join(classes_of(light), "fp").groupBy("component").agg(first.alias(row)).select(row)
    return marked.join(kept, row, "left_semi").select(*columns)
