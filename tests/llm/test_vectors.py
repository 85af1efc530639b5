"""Pivot-permutation near-duplicates and additive quantisation, against brute force."""

import math

import numpy as np
import pyarrow.dataset as ds
import pytest

from pagemill.llm import additive as A
from pagemill.llm import pivots as P

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string"
NAN, INF = float("nan"), float("inf")
ODD = [(9001, None), (9002, [0.0] * 8), (9003, [NAN] + [1.0] * 7), (9004, [INF] + [1.0] * 7), (9005, [None] + [1.0] * 7), (9006, []), (None, [1.0] * 8)]


def vectors(seed=1, n=120, dim=8, noise=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    rows = [(k, (centres[rng.integers(30)] + noise * rng.normal(size=dim)).astype(np.float32).tolist()) for k in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(40)]  # copies
    rows += [(n + 50, [float(np.float32(x * 1e20)) for x in rows[3][1]]), (n + 51, [float(np.float32(x * 1e-20)) for x in rows[4][1]])]  # the same directions
    return rows + [(8001, [1.0, 2.0]), (8002, [2.0, 4.0])] + [(5, rows[5][1])] + ODD


def frame(spark, rows):
    return spark.createDataFrame([(v, e, 0, "x") for v, e in rows], SCHEMA)


def good(v, e):
    return v is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)


def brute_links(rows, threshold=0.95):
    unit = [np.array(e) / np.abs(e).max() if good(v, e) else None for v, e in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n_links, label = [0] * len(rows), {v: v for v, e in rows if v is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and float(a @ b) >= threshold:
                n_links[i] += 1
                n_links[j] += 1
                p, q = root(rows[i][0]), root(rows[j][0])
                label[max(p, q)] = min(p, q)
    return sorted(((v, n, root(v) if v is not None else None) for (v, _), n in zip(rows, n_links)), key=str)


@pytest.mark.parametrize("block", [16, 512])
def test_links_against_brute_force(spark, block):
    rows = vectors()
    out = P.link(frame(spark, rows), block=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_dense_group_keeps_recall(spark):
    """A third of all vectors near one another: pivots must not crowd there."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=32)
    near = base + 0.12 * np.linalg.norm(base) / math.sqrt(32) * rng.normal(size=(300, 32))
    rows = [(k, x.astype(np.float32).tolist()) for k, x in enumerate(np.vstack([near, rng.normal(size=(600, 32))]))]
    got = {r["vec_id"]: r["n_links"] for r in P.link(frame(spark, rows)).collect()}
    want = {v: n for v, n, _ in brute_links(rows)}
    assert sum(got.values()) >= 0.995 * sum(want.values()) and all(got[v] <= want[v] for v in got)


def test_hot_group_of_distinct_vectors(spark):
    """20,000 vectors about one point, of which some link: long lists are split by a second pivot, then cut."""
    rng = np.random.default_rng(7)
    x = (np.eye(1, 16) * 3 + 0.45 * rng.normal(size=(20_000, 16))).astype(np.float32)
    x = np.vstack([x, rng.normal(size=(4000, 16)).astype(np.float32)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = np.concatenate([(unit[k : k + 1000] @ unit.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(unit), 1000)])
    out = P.link(frame(spark, rows), block=1024).toPandas().sort_values("vec_id")
    got = out["n_links"].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() > 100_000
    assert (P.link(frame(spark, rows), block=8192).toPandas().sort_values("vec_id")["n_links"].to_numpy() == got).all()


def test_counts_come_before_products():
    rng = np.random.default_rng(1)
    named = np.sort(rng.permuted(np.tile(np.arange(12), (60, 1)), axis=1)[:, :5], axis=1).astype(np.int32)
    meets = {}
    for p in range(12):
        for second in [-1, *range(p + 1, 12)]:
            rows = np.flatnonzero((named == p).any(axis=1) & ((named == second).any(axis=1) | (second < 0)))
            marks = P._marks(named[rows], p, second)
            shared = marks @ marks.T
            for i, j in zip(*np.nonzero((shared >= 2) & (shared < P.EARLIER))):
                if i < j:
                    key = (second >= 0, rows[i], rows[j])
                    assert key not in meets
                    meets[key] = shared[i, j]
    for i in range(60):
        for j in range(i + 1, 60):
            both = len(set(named[i]) & set(named[j]))
            assert meets.get((False, i, j), 0) == meets.get((True, i, j), 0) == (both if both >= 2 else 0)


def test_one_vec_id_with_two_vectors(spark):
    a, b = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    out = P.link(frame(spark, [(3, a), (9, a), (4, b), (9, b), (11, [0.0, 1.0] + [0.0] * 6)])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out) == [(3, 1, 3, True), (4, 1, 3, False), (9, 1, 3, False), (9, 1, 3, False), (11, 0, 11, True)]


def test_spread_of_pivots():
    rng = np.random.default_rng(2)
    pool = P.unit(rng.normal(size=(200, 4)))
    chosen = P.spread(pool, 20)
    close = chosen @ chosen.T - 2 * np.eye(len(chosen))
    assert close.max() < P.APART


def test_no_vectors(spark):
    assert P.link(frame(spark, [])).count() == 0
    out = P.link(frame(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in out)


# ---------------------------------------------------------------- search


def test_codes_approximate():
    rng = np.random.default_rng(1)
    x = A.unit(rng.normal(size=(2000, 16))).astype(np.float32)
    books = A.fit(x, 6, 32)
    codes = A.encode(x, books)
    assert codes.shape == (2000, 6) and np.mean((x - A.decode(codes, books)) ** 2) < 0.15 * np.mean(x**2)
    one = A.encode(x[:100], books, beam=1)
    wide = A.encode(x[:100], books, beam=16)
    error = lambda c: np.sum((x[:100] - A.decode(c, books)) ** 2)
    assert error(wide) < error(one)


def brute_search(rows, queries, k):
    out = []
    for q, e in queries:
        if not good(q, e):
            continue
        scored = []
        for v, x in rows:
            if good(v, x) and v != q and len(x) == len(e):
                s = 0.0
                for a, b in zip(e, x):
                    s += float(a) * float(b)
                scored.append((-s, v))
        out += [(q, r, v, -s) for r, (s, v) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_search_with_ties_and_odd_rows(spark):
    rows = vectors()  # some are 1e20 times as long as others
    df = frame(spark, rows)
    index, books = A.build(df)
    queries = df.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")
    got = sorted(tuple(r) for r in A.search(index, books, queries).collect())
    assert got == brute_search(rows, [(v, e) for v, e in rows if v is not None and v % 20 == 0], 20)
    assert A.search(index, books, queries.limit(0)).count() == 0
    empty, none = A.build(df.limit(0))
    assert empty.count() == 0 and A.search(empty, none, queries).count() == 0


def test_long_and_short_vectors(spark):
    """A whole table of long vectors, and one with all sizes: few are reranked, recall holds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    for factor in (np.full(3000, 1e20), 10.0 ** rng.integers(-3, 4, 3000)):
        rows = [(k, (v * f).astype(np.float32).tolist()) for k, (v, f) in enumerate(zip(x, factor))]
        df = frame(spark, rows)
        index, books = A.build(df)
        queries = df.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding")
        got = {(r["query_id"], r["vec_id"]) for r in A.search(index, books, queries).collect()}
        own = np.array([r[1] for r in rows])
        want = set()
        for q in range(0, 3000, 100):
            s = own @ own[q]
            s[q] = -np.inf
            want |= {(q, int(v)) for v in np.argsort(-s, kind="stable")[:20]}
        assert len(got) == len(want) == 600 and len(got & want) >= 0.97 * 600


def test_blocks_and_recall(spark, monkeypatch):
    d = "/root/testdata/sf0.1"
    t = ds.dataset(f"{d}/embeddings.parquet").to_table().sort_by("vec_id")
    x, ids = np.array(t["embedding"].to_pylist(), float), np.array(t["vec_id"])
    own = ids[ids % 20 == 0]
    scores = x[ids % 20 == 0] @ x.T
    scores[np.arange(len(own)), np.searchsorted(ids, own)] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    sizes, kept = [], A.write_table

    def watched(df, label):
        out = kept(df, label)
        if label == "additive-chosen":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(A, "write_table", watched)
    results = []
    for queries, rows in ((A.QUERIES, A.ROWS), ((8, 32), 512)):
        monkeypatch.setattr(A, "QUERIES", queries)
        monkeypatch.setattr(A, "ROWS", rows)
        out = A.query(spark, d).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
        found = out.groupby("query_id")["vec_id"].apply(set)
        assert len(out) == 20 * len(own) and np.mean([len(found[q] & set(ids[b])) / 20 for q, b in zip(own, best)]) >= 0.98
        assert (out.groupby("query_id")["rank"].apply(list).map(lambda r: r == list(range(1, 21)))).all()
        results.append(out)
    assert results[0].equals(results[1]) and len(set(sizes)) == 1  # blocks change nothing
    assert sizes[0] < 0.1 * len(ids) * len(own)  # a small table's least; 0.9 % of 51,282 rows
