import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, taken string"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def docs(n=300):
    out = [(k, "w " * (1 + k * 7 % 90), f"s{k % 5}" if k % 5 else None, "x") for k in range(n)]
    out += [(n + k, "w " * 50, "hot", "x") for k in range(2 * n)]  # two thirds of the rows
    return out + [(5000, None, "empty", "x"), (5001, "", "empty", "x"), (5002, " a\x0bb\t\n", "s1", "x"), (5003, "a a", "s1", "x"), (5003, "a a", "s1", "x"), (None, "b b b", "s2", "x")]


def test_targets():
    assert M.targets([100, 100, 100], [1, 2, 3], 300, 3) == [50.0, 100.0, 150.0]
    got = M.targets([1000, 10, 10], [1, 2, 3], 1020, 3)
    assert got[1:] == [30.0, 30.0] and got[0] == 960.0
    assert M.targets([0, 5], [1, 2], 5, 3) == [0.0, 5.0]
    assert M.targets([5, 5], [1, 1], 100, 3) == [15.0, 15.0]
    assert M.targets([], [], 0, 3) == []


def test_tree_keeps_quotas():
    counts = np.array([10, 0, 37, 5])
    shares = M.split_tree(counts, 7, np.random.default_rng(1))
    assert shares.shape == (7, 4) and (shares.sum(axis=0) == counts).all() and (shares >= 0).all()
    assert shares.sum(axis=1).max() - shares.sum(axis=1).min() <= 2


def test_tree_has_the_law_of_a_shuffle():
    rng = np.random.default_rng(2)
    draws = np.array([M.split_tree(np.array([6, 6]), 2, rng)[0, 0] for _ in range(4000)])
    assert abs(draws.mean() - 3) < 0.1 and abs(draws.var() - 6 * 6 * 6 * 6 / (144 * 11)) < 0.1


def test_mix(spark):
    rows = docs()
    out = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["size"]) for r in out if r["doc_id"] is not None) == sorted((d, size(t)) for d, t, *_ in rows if d is not None)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, t, s, _ in rows if s == n) for n in names]
    goal = dict(zip(names, M.targets(sizes, [1 + k % 3 for k in range(len(names))], sum(sizes), 3)))
    source = {d: s for d, _, s, _ in rows}
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["shards"]) == -(-r["taken"] // r["size"]) if r["size"] and r["taken"] % r["size"] == 0 else True
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["target"] == pytest.approx(goal[source[r["doc_id"]]]) and r["source_size"] == dict(zip(names, sizes))[source[r["doc_id"]]]
    for n in names:
        assert abs(taken[n] - goal[n]) <= 1


def test_reruns_and_partitions_agree(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    one, two = (sorted((r["doc_id"] or -1, r["taken"], tuple(r["shards"])) for r in M.mix(d).collect()) for d in (df, df.repartition(13)))
    assert one == two


def test_rows_of_the_mix(spark):
    rows = docs()
    df = spark.createDataFrame(rows, SCHEMA)
    taken = defaultdict(int)
    for r in M.mix(df).collect():
        taken[r["doc_id"]] += r["taken"]
    got = defaultdict(int)
    mixed = M.mixed_rows(df, shards=5)
    for r in mixed.collect():
        got[r["doc_id"]] += size(r["text"])
        assert 0 <= r["_shard"] < 5
    assert {k: v for k, v in taken.items() if v} == dict(got)
    assert M.stage(spark, df, "").columns == df.columns


def test_many_copies_spread(spark, monkeypatch):
    """A third of all rows are one row: it fills no block alone, and runs agree over partitions."""
    monkeypatch.setattr(M, "COPIES", 40)
    rows = [(7, "w " * 20, "a", "x")] * 900 + [(100 + k, "v " * (1 + k % 30), "a" if k % 2 else "b", "x") for k in range(1800)]
    df = spark.createDataFrame(rows, SCHEMA)
    results = []
    for d in (df, df.repartition(11)):
        out = M.mix(d, shards=8).collect()
        results.append(sorted((r["doc_id"], r["taken"], tuple(r["shards"])) for r in out))
        per = Counter(x for r in out if r["doc_id"] == 7 for x in r["shards"])
        assert len(per) == 8 and max(per.values()) < 2.5 * sum(per.values()) / 8
        taken = Counter()
        for r in out:
            taken[r["target"]] += r["taken"]
        assert all(abs(t - n) <= 1 for t, n in taken.items())
    assert results[0] == results[1]
    words = sum(r["taken"] for r in M.mix(df).collect())
    assert sum(size(r["text"]) for r in M.mixed_rows(df).collect()) == words


def test_many_sources_have_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "CELLS", 64)
    monkeypatch.setattr(M, "BROADCAST_ROWS", 50)
    rows = [(k, "w " * (1 + k % 9), f"s{k % 300}", "x") for k in range(3000)]
    sized = M.with_size(spark.createDataFrame(rows, SCHEMA), 20)
    plan = M.make_plan(sized)
    assert plan.blocks.count() == 300
    out = M.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, goal = Counter(), {}
    for r in out:
        taken[r["doc_id"] % 300] += r["taken"]
        goal[r["doc_id"] % 300] = r["target"]
    assert len(out) == 3000 and all(abs(taken[k] - goal[k]) <= 1 for k in range(300))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix(empty).count() == 0 and M.mixed_rows(empty).count() == 0
