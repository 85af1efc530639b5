"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Inverted lists hold the vectors of each pivot,
and a long list is split by the second pivot that two of its vectors share. Within a list the shared pivots of all pairs
are counted by one product of indicator matrices; pairs that share at least min_shared are candidates, and candidates
are verified by their cosine in double precision. A pair meets in the list of its first shared pivot (in a split one, of
its first two) only, so every link counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import hash_sample, write_table
from pagemill.llm.components import connected_components
from pagemill.llm.vectors import matrix, unit, usable

#: Pivots grow as 4 times the square root of the number of vectors, to a power of two within these bounds: they are
#: broadcast. Beyond, lists grow long and are split by a second pivot, so the keys go on growing as the pivots' square.
PIVOTS = (64, 16384)
#: Pivots come from so many times as many vectors (of the smallest hashes), none nearer to another than this cosine: else
#: a dense group would hold many pivots and its vectors would share few of their nearest.
POOL, APART = 4, 0.8
#: Pivots that describe a vector, and shared ones that make a candidate: recall 0.9997 at cosine 0.95 in 64 dimensions.
NEAREST, MIN_SHARED = 8, 2
#: Rows of a list above which it is split by a second pivot, and then cut into pairs of blocks.
BLOCK = 8192
#: What sharing a pivot of an earlier list adds to a pair's count.
EARLIER = 1024.0


def link(vectors: DataFrame, threshold: float = 0.95, nearest: int = NEAREST, min_shared: int = MIN_SHARED, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id long, embedding array, ...) -> (vec_id, n_links, component_id, kept), one row per row.

    n_links counts other vectors with cosine >= threshold; component_id is the smallest vec_id reachable over links;
    kept says that it is the vector's own. Vectors that are null, zero, or hold null or non-finite components, and
    rows without vec_id, link with nothing. Vectors of different lengths never link. Equal vectors are one class: they
    count as links of each other but never meet as pairs. Rows that repeat a vec_id are vectors of their own in
    n_links and one node in components, whatever their vectors. Other columns are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding", usable(F.col("vec_id"), F.col("embedding")).alias("ok"))
    keys = [F.xxhash64(F.lit(k), "embedding").alias(f"h{k}") for k in (1, 2)]
    good = rows.where("ok").select("vec_id", "embedding", *keys)
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = write_table(classes.withColumn("dim", F.size("embedding")), "vector-classes")
    pairs = write_table(_pairs(spark, classes, threshold, nearest, min_shared, block), "vector-links")

    counts = pairs.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.sum("n").alias("far"))
    edges = pairs.where("h1 IS NULL").select("u", "v")
    twice = good.select("vec_id", "h1", "h2").distinct().groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id")
    named = good.select("vec_id", "h1", "h2").distinct().join(twice, "vec_id").join(classes.select("h1", "h2", "node"), ["h1", "h2"])
    found = connected_components(edges.unionByName(named.select(F.col("vec_id").alias("u"), F.col("node").alias("v"))))
    labels = classes.select("h1", "h2", "node", "n").join(counts, ["h1", "h2"], "left").join(found, "node", "left")
    labels = labels.select("h1", "h2", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    labels = write_table(labels, "vector-labels")
    done = good.select("vec_id", "h1", "h2").join(labels, ["h1", "h2"]).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def spread(pool: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of pool that are no nearer than APART to one chosen before."""
    free, chosen = np.ones(len(pool), bool), []
    while len(chosen) < k and free.any():
        at = int(free.argmax())
        chosen.append(at)
        free &= pool @ pool[at] < APART
        free[at] = False
    return pool[chosen]


def _pairs(spark, classes: DataFrame, threshold: float, nearest: int, min_shared: int, block: int) -> DataFrame:
    """(h1, h2, n, u, v): rows with h1 add n links to a class; the others are edges that span the links' components."""
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        k = int(np.clip(2 ** round(np.log2(4 * np.sqrt(n))), *PIVOTS))
        drawn = hash_sample(classes.where(F.col("dim") == dim), n, POOL * k, ["h1", "h2"], ["embedding"]).toArrow()
        pivots[dim] = spread(unit(matrix(drawn.column(0).combine_chunks())).astype(np.float32), k)
    shared = spark.sparkContext.broadcast(pivots)  # at most PIVOTS[1] vectors of each length

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(4).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = whole.filter(pa.array(dims == dim))
                points = shared.value[int(dim)]
                k = min(nearest, len(points))
                for at in range(0, part.num_rows, 2048):
                    batch = part.slice(at, 2048)
                    near = unit(matrix(batch.column(5))).astype(np.float32) @ points.T
                    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                    order = np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable")
                    named = np.take_along_axis(best, order, 1).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, named.size + 1, k, dtype=np.int32)), pa.array(named.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["h1", "h2", "node", "n", "dim", "embedding", "pivots"])

    kind = classes.schema["embedding"].dataType.simpleString()
    described = write_table(classes.select("h1", "h2", "node", "n", "dim", "embedding").mapInArrow(describe, f"h1 long, h2 long, node long, n long, dim int, embedding {kind}, pivots array<int>"), "pivot-index")
    posting = described.withColumn("pivot", F.explode("pivots"))
    sizes = [(r["dim"], r["pivot"]) for r in posting.groupBy("dim", "pivot").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()]  # one row per pivot at most
    long = spark.createDataFrame(pa.table({"dim": pa.array([x for x, _ in sizes], pa.int32()), "pivot": pa.array([x for _, x in sizes], pa.int32()), "long": pa.array([True] * len(sizes), pa.bool_())}))
    posting = posting.join(F.broadcast(long), ["dim", "pivot"], "left")
    later = F.filter("pivots", lambda p: p > F.col("pivot"))
    split = F.coalesce("long", F.lit(False)) & (F.size("pivots") >= 2) & F.lit(min_shared >= 2)
    posting = posting.withColumn("second", F.explode(F.when(split, later).otherwise(F.array(F.lit(-1)))))
    hot = posting.where("long").groupBy("dim", "pivot", "second").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = hot.select("dim", "pivot", "second", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    posting = posting.join(hot, ["dim", "pivot", "second"], "left").fillna(1, ["blocks"]) if sizes else posting.withColumn("blocks", F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(3), "h1"), F.col("blocks")).cast("int")
    posting = posting.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["dim", "pivot", "second", "a", "b"]
    posting = posting.select("dim", "pivot", "second", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "h1", "h2", "node", "n", "embedding", "pivots")
    dealt = posting.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)], axis=1)
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist() if len(keys) else []
            for x, y in zip([0, *cuts], [*cuts, len(keys)]):
                if x == y:
                    continue
                key = tuple(keys[x].tolist())
                if key != last:
                    yield from compare(last, held, threshold, min_shared)
                    last, held = key, []
                held.append(batch.slice(x, y - x))
        yield from compare(last, held, threshold, min_shared)

    return dealt.mapInArrow(run, "h1 long, h2 long, n long, u long, v long")


def compare(key: tuple | None, held: list[pa.RecordBatch], threshold: float, min_shared: int) -> Iterator[pa.RecordBatch]:
    """Links of one list, or of two of its blocks: added links per class, and edges that span their components."""
    if key is None:
        return
    _, pivot, second, a, b = key
    rows = pa.Table.from_batches(held)
    if rows.num_rows < 2:
        return
    own, h1, h2, node, n = (rows.column(k).to_numpy() for k in (5, 6, 7, 8, 9))
    vectors, named = unit(matrix(rows.column(10).combine_chunks())), matrix(rows.column(11).combine_chunks(), np.int32)
    rough, marks = vectors.astype(np.float32), _marks(named, pivot, second)
    added, label, need = np.zeros(len(n), np.int64), np.arange(len(n)), min(min_shared, named.shape[1])
    left, right = (np.arange(len(n)),) * 2 if a == b else (np.flatnonzero(own == a), np.flatnonzero(own == b))
    for at in range(0, len(left), 256):
        i = left[at : at + 256]
        shared = marks[i] @ marks[right].T
        near = (shared >= need) & (shared < EARLIER)
        if a == b:
            near &= i[:, None] < right
        if np.count_nonzero(near) > near.size // 32:  # many candidates: single precision rules most of them out at once
            near &= rough[i] @ rough[right].T >= threshold - 1e-4
        x, y = np.nonzero(near)
        x, y = i[x], right[y]
        for k in range(0, len(x), 1 << 16):
            p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
            keep = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= threshold
            p, q = p[keep], q[keep]
            np.add.at(added, p, n[q])
            np.add.at(added, q, n[p])
            _join(label, p, q)
    some, moved = np.flatnonzero(added), np.flatnonzero(label != np.arange(len(label)))
    if len(some):
        none = lambda m: pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(h1[some]), pa.array(h2[some]), pa.array(added[some]), none(len(some)), none(len(some))], names=["h1", "h2", "n", "u", "v"])
        yield pa.RecordBatch.from_arrays([none(len(moved))] * 3 + [pa.array(node[moved]), pa.array(node[label[moved]])], names=["h1", "h2", "n", "u", "v"])


def _marks(named: np.ndarray, pivot: int, second: int) -> np.ndarray:
    """An indicator matrix whose rows' products count shared pivots, and add EARLIER or more for a pair that meets in an
    earlier list: one that shares a pivot before this list's, or another before its second."""
    there, at = np.unique(named, return_inverse=True)
    earlier = (there < max(pivot, second)) & (there != pivot) if second >= 0 else there < pivot
    out = np.zeros((len(named), len(there)), np.float32)
    out[np.arange(len(named))[:, None], at.reshape(named.shape)] = 1
    out[:, earlier] *= np.sqrt(np.float32(EARLIER))
    return out


def _join(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Merge the classes of p and q: label points to the smallest row of a class."""
    while True:
        x, y = label[p], label[q]
        apart = x != y
        if not apart.any():
            return
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (jump := label[label]).tobytes() != label.tobytes():
            label[:] = jump


def query(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a), m AS (SELECT vec_id, min(other) AS low FROM r GROUP BY vec_id)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id <= coalesce(low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""
