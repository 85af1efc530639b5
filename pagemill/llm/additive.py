"""Approximate nearest neighbours by additive quantisation.

A vector's direction is a sum of full-dimensional codewords, one of each codebook, found by beam search over the
residuals; its norm, that of the sum, and how far the sum is off are stored. A query's inner products with all codewords
form a lookup table, by which all codes are scored, and nothing but codes. What may still belong to the nearest, given
how far each sum is off, is the shortlist; it alone meets the original vectors, for exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import hash_sample, write_table
from pagemill.llm.vectors import matrix, unit, usable

#: Codebooks, codewords in each, beam width, and vectors (of the smallest hashes) that codebooks are fitted on.
BOOKS, WORDS, BEAM, SAMPLE = 32, 64, 4, 8192
#: Queries of a block, at least (where cores would be idle) and at most; rows whose codes stream past one block, at most;
#: bytes of vectors that one block reranks, about.
QUERIES, ROWS, RERANK_BYTES = (256, 2048), 1 << 20, 64 << 20
#: The shortlist: what is within so many standard errors of the k-th best code, and as many times k rows at least.
MARGIN, LEAST = 2.5, 4


def encode(rows: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """rows x codebooks, uint8: the best sums of codewords that a beam of partial sums finds."""
    out, norms = np.empty((len(rows), len(books)), np.uint8), [np.einsum("ij,ij->i", b, b) for b in books]
    for at in range(0, len(rows), 512):
        x = rows[at : at + 512]
        n, left, codes, worst = len(x), x[:, None, :], np.zeros((len(x), 1, 0), np.uint8), np.einsum("ij,ij->i", x, x)[:, None]
        each = np.arange(n)[:, None]
        for book, norm in zip(books, norms):
            far = (left.reshape(-1, x.shape[1]) @ (-2 * book.T)).reshape(n, left.shape[1], len(book))
            far += worst[:, :, None]
            far += norm
            flat = far.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            parent, word = np.divmod(best, len(book))
            worst = np.take_along_axis(flat, best, 1)
            left = left[each, parent] - book[word]
            codes = np.concatenate([codes[each, parent], word[:, :, None].astype(np.uint8)], axis=2)
        out[at : at + 512] = codes[np.arange(n), worst.argmin(axis=1)]
    return out


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def _nearest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (rows @ (-2 * book.T) + np.einsum("ij,ij->i", book, book)).argmin(axis=1)


def fit(rows: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 10) -> np.ndarray:
    """Codebooks (books x words x dimensions): k-means on residuals, then rounds of beam search and least squares."""
    rng, words, left, out = np.random.default_rng(seed), min(words, len(rows)), rows.copy(), []
    for _ in range(books):
        book = left[rng.choice(len(left), words, replace=False)].copy()
        for _ in range(8):
            near = _nearest(left, book)
            order = np.argsort(near, kind="stable")
            there, first = np.unique(near[order], return_index=True)
            book[there] = np.add.reduceat(left[order], first, axis=0) / np.bincount(near, minlength=words)[there, None]
        left = left - book[_nearest(left, book)]
        out.append(book)
    out = np.stack(out).astype(np.float32)
    for _ in range(rounds):
        used = np.zeros((len(rows), books * words), np.float32)
        used[np.arange(len(rows))[:, None], encode(rows, out) + np.arange(books) * words] = 1
        gram = (used.T @ used).astype(np.float64) + 1e-2 * np.eye(books * words)
        out = np.linalg.solve(gram, (used.T @ rows).astype(np.float64) + 1e-2 * out.reshape(-1, rows.shape[1])).reshape(out.shape).astype(np.float32)
    return out


def build(vectors: DataFrame) -> tuple[DataFrame, object]:
    """vectors (vec_id, embedding, ...) -> the index, written to the shared folder, and broadcast codebooks by length.

    Index rows, one for each row with a usable vector: row (a number of its own), vec_id, dim, embedding, codes (a byte
    per codebook), norm (the vector's), sum_norm (that of its codewords' sum) and off (the distance of their directions). Codebooks are fitted on SAMPLE rows of each length. Norms are taken relative to the table's
    largest component, so vectors of any finite size are fine. Other columns are ignored whatever their names; an empty
    table gives an empty index; equal rows tie and get equal codes.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("vec_id"), F.col("embedding"))).select("vec_id", F.size("embedding").alias("dim"), "embedding")
    books: dict[int, np.ndarray] = {}
    sizes = good.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("most")).collect()  # a row per length
    most = max((r["most"] for r in sizes), default=1.0)
    for r in sizes:
        rows = hash_sample(good.where(F.col("dim") == r["dim"]), r["n"], SAMPLE, ["vec_id", "embedding"], ["embedding"]).toArrow()
        books[r["dim"]] = fit(unit(matrix(rows.column(0).combine_chunks())).astype(np.float32))
    shared = spark.sparkContext.broadcast(books)  # BOOKS x WORDS vectors of each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                batch = whole.filter(pa.array(dims == dim))
                rows, own = matrix(batch.column(3)), shared.value[int(dim)]
                straight = unit(rows)
                codes = encode(straight.astype(np.float32), own)
                sums = decode(codes, own).astype(np.float64)
                sum_norm = np.maximum(np.linalg.norm(sums, axis=1), 1e-9)
                off = np.linalg.norm(straight - sums / sum_norm[:, None], axis=1)
                packed = pa.Array.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(np.linalg.norm(rows / most, axis=1)), pa.array(sum_norm), pa.array(off)], names=["row", "vec_id", "dim", "embedding", "codes", "norm", "sum_norm", "off"])

    kind = good.schema["embedding"].dataType.simpleString()
    numbered = good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "dim", "embedding")
    return write_table(numbered.mapInArrow(run, f"row long, vec_id long, dim int, embedding {kind}, codes binary, norm double, sum_norm double, off double"), "additive-index"), shared


def shortlist(index: DataFrame, books, good: DataFrame, k: int) -> DataFrame:
    """index and books of build(), good (q, qb, query_id, dim, embedding) -> (q, qb, row): what is to be reranked.

    Codes and queries meet in blocks by hash; codes alone are read and moved. A block sends on what may be among the k
    best of its rows: all whose score by codes is within MARGIN standard errors of the k-th best, and the LEAST x k best.
    The same rule over all blocks then decides, so the outcome depends on no block's size. Nothing is capped: where very
    many are near one another, all within the margin go on.
    """
    least = LEAST * k
    rows, blocks = index.count(), max(1, good.agg(F.max("qb")).first()[0] + 1)
    row_blocks = max(-(-rows // ROWS), 1)
    none = lambda kind: F.lit(None).cast(kind)
    left = good.select("dim", "qb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("q").alias("no"), F.col("embedding").cast("array<double>").alias("vector"), none("binary").alias("codes"), none("double").alias("scale"), none("double").alias("error"))
    scale, error = F.col("norm") / F.col("sum_norm"), F.col("norm") * F.col("off") / F.sqrt(F.col("dim").cast("double"))
    right = index.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int").alias("rb"), F.lit(1).alias("side"), F.col("vec_id").alias("id"), F.col("row").alias("no"), none("array<double>").alias("vector"), "codes", scale.alias("scale"), error.alias("error"))
    met = left.unionByName(right).repartition(max(1, min(blocks * row_blocks, 1 << 17)), "dim", "qb", "rb").sortWithinPartitions("dim", "qb", "rb", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)], axis=1)
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist() if len(keys) else []
            for x, y in zip([0, *cuts], [*cuts, len(keys)]):
                if x == y:
                    continue
                key = tuple(keys[x, :3].tolist())
                if key != last:
                    if block:
                        yield from block.rest()
                    last, block = key, _Scan(key[1], books.value.get(key[0]), k, least)
                if keys[x, 3] == 0:
                    block.queries.append(batch.slice(x, y - x))
                else:
                    yield from block.rows(batch.slice(x, y - x))
        if block:
            yield from block.rest()

    found = write_table(met.mapInArrow(run, "q long, qb int, row long, score double, most double"), "additive-shortlist")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "row")
    ranked = found.withColumn("_n", F.row_number().over(best))
    edge = F.max(F.when(F.col("_n") == k, F.col("score"))).over(Window.partitionBy("q"))
    return ranked.withColumn("_edge", edge).where((F.col("_n") <= least) | F.col("_edge").isNull() | (F.col("most") >= F.col("_edge"))).select("q", "qb", "row")


class _Scan:
    """One block's scan: lookup tables of its queries, the best scores so far, and what they leave over."""

    def __init__(self, qb: int, books: np.ndarray | None, k: int, least: int):
        self.qb, self.books, self.k, self.least = qb, books, k, least
        self.queries: list[pa.RecordBatch] = []
        self.tables: list | None = None
        self.held: list[tuple[np.ndarray, ...]] = []

    def _start(self) -> None:
        asked = pa.Table.from_batches(self.queries)
        ids, q, vectors = asked.column("id").to_numpy(), asked.column("no").to_numpy(), unit(matrix(asked.column("vector").combine_chunks()))
        self.q, self.tables = q, []
        for at in range(0, len(q), 256):
            x = vectors[at : at + 256].astype(np.float32)
            table = np.ascontiguousarray(np.einsum("mwd,qd->mwq", self.books, x, optimize=True))  # inner products with all codewords
            self.tables.append((at, ids[at : at + 256], table, np.full((len(x), self.least), -np.inf)))

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.books is None or not self.queries:
            return
        if self.tables is None:
            self._start()
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            ids, numbers, scale, error = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "no", "scale", "error"))
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            for i, (first, names, table, best) in enumerate(self.tables):
                sums = table[0][codes[:, 0]]
                for m in range(1, len(table)):
                    sums += table[m][codes[:, m]]
                score = sums.T * scale
                for own in np.flatnonzero(np.isin(ids, names)):
                    score[names == ids[own], own] = -np.inf
                both = np.concatenate([best, score], axis=1)
                best = np.partition(both, both.shape[1] - self.least, axis=1)[:, -self.least :]
                self.tables[i] = (first, names, table, best)
                x, y = np.nonzero(self._stays(score, score + MARGIN * error, best))
                self.held.append((x + first, numbers[y], score[x, y], score[x, y] + MARGIN * error[y]))
            if sum(len(h[0]) for h in self.held) > 1 << 21:
                yield from self.rest()

    def _stays(self, score: np.ndarray, most: np.ndarray, best: np.ndarray) -> np.ndarray:
        low, edge = best.min(axis=1), np.partition(best, self.least - self.k, axis=1)[:, self.least - self.k]
        return (score > -np.inf) & ((score >= low[:, None]) | (most >= edge[:, None]))

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is held and still stays by the best scores so far."""
        if not self.held:
            return
        x, rows, score, most = (np.concatenate([h[c] for h in self.held]) for c in range(4))
        self.held, best = [], np.concatenate([t[3] for t in self.tables])
        low, edge = best.min(axis=1), np.partition(best, self.least - self.k, axis=1)[:, self.least - self.k]
        stays = (score >= low[x]) | (most >= edge[x])
        columns = [self.q[x[stays]], np.full(int(stays.sum()), self.qb, np.int32), rows[stays], score[stays], most[stays]]
        for at in range(0, len(columns[0]), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 18)]) for c in columns], names=["q", "qb", "row", "score", "most"])


def search(index: DataFrame, books, queries: DataFrame, k: int = 20) -> DataFrame:
    """index and books of build(), queries (query_id, embedding, ...) -> (query_id, rank, vec_id, score).

    The k nearest by inner product, nearest first, ties to the smaller vec_id, without the query's own vec_id; all
    candidates if there are fewer. shortlist() picks by codes what is scored exactly, in double precision.
    Queries that aren't usable vectors, and those whose length no index row has, have no rows; a repeated query has its
    rows once for each time, a repeated candidate counts each time. An inner product beyond the range of doubles is
    infinite, and one that is no number comes last. Other columns are ignored; empty tables give an empty one.
    """
    kind = index.schema["embedding"].dataType.simpleString()
    good = queries.where(usable(F.col("query_id"), F.col("embedding"))).select(F.monotonically_increasing_id().alias("q"), "query_id", F.size("embedding").alias("dim"), F.col("embedding").cast(kind).alias("embedding"))
    good = write_table(good, "additive-queries")
    asked, cores = good.count(), index.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asked // QUERIES[1]), min(-(-asked // QUERIES[0]), 2 * cores))
    good = good.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    if good.isEmpty():
        return good.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    chosen = write_table(shortlist(index, books, good, k), "additive-chosen")
    most = chosen.groupBy("qb").count().agg(F.max("count")).first()[0] or 0
    subs = max(1, -(-most * 8 * max(books.value, default=1) // RERANK_BYTES), -(-2 * cores // blocks))
    sub = F.pmod(F.xxhash64("row"), F.lit(subs)).cast("int")
    rows = chosen.groupBy("qb", "row").agg(F.collect_list("q").alias("qs")).join(index.select("row", "vec_id", "embedding"), "row")
    rows = rows.select("qb", sub.alias("sub"), F.size("embedding").alias("dim"), F.lit(1).alias("side"), F.col("vec_id").alias("id"), "embedding", "qs")
    asked = good.select("qb", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))).alias("sub"), "dim", F.lit(0).alias("side"), F.col("query_id").alias("id"), "embedding", F.array("q").alias("qs"))
    met = asked.unionByName(rows).repartition(blocks * subs, "qb", "sub").sortWithinPartitions("qb", "sub", "dim", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist() if len(keys) else []
            for x, y in zip([0, *cuts], [*cuts, len(keys)]):
                if x == y:
                    continue
                key = tuple(keys[x].tolist())
                if key != last and held:
                    yield from _rerank(pa.Table.from_batches(held), k)
                if key != last:
                    last, held = key, []
                held.append(batch.slice(x, y - x))
        if held:
            yield from _rerank(pa.Table.from_batches(held), k)

    found = met.mapInArrow(run, "q long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.isnan("score"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _rerank(table: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of a block's chosen rows to each of its queries, by exact inner products."""
    side = table.column("side").to_numpy()
    asked, rows = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
    if not asked.num_rows or not rows.num_rows:
        return
    q, names, wanted = asked.column("qs").combine_chunks().flatten().to_numpy(), asked.column("id").to_numpy(), matrix(asked.column("embedding").combine_chunks())
    order = np.argsort(q)
    q, names, wanted = q[order], names[order], wanted[order]
    ids, vectors, lists = rows.column("id").to_numpy(), matrix(rows.column("embedding").combine_chunks()), rows.column("qs").combine_chunks()
    a = np.searchsorted(q, lists.flatten().to_numpy())
    b = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
    score = np.zeros(len(a))
    left, right = np.ascontiguousarray(wanted.T), np.ascontiguousarray(vectors.T)
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(a), 1 << 16):
            i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            for x, y in zip(left, right):  # in the order of components, so that sums agree to the last bit
                score[at : at + (1 << 16)] += x[i] * y[j]
    real = names[a] != ids[b]
    a, b, score = a[real], b[real], score[real]
    order = np.lexsort((ids[b], -score, np.isnan(score), a))
    a, b, score = a[order], b[order], score[order]
    start = np.searchsorted(a, a)
    best = np.arange(len(a)) - start < k
    yield pa.RecordBatch.from_arrays([pa.array(q[a[best]]), pa.array(names[a[best]]), pa.array(ids[b[best]]), pa.array(score[best])], names=["q", "query_id", "vec_id", "score"])


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index, books = build(vectors)
    return search(index, books, vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
