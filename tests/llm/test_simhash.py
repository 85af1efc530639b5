import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import simhash as S
from pagemill.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """{doc_id: smallest doc_id reachable}, from [(doc_id, fingerprint)]."""
    label = {d: d for d, _ in pairs}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, x), (b, y) in combinations(pairs, 2):
        if (x ^ y).bit_count() <= 4:
            p, q = root(a), root(b)
            label[max(p, q)] = min(p, q)
    return {d: root(d) for d, _ in pairs}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "a b c d", "A b C d e", "a\x0bb\x85c é\xa0x y z w", "x " * 50, "ÀB c" * 9])
def test_fingerprint(text):
    assert S.fingerprint_of(text) == brute_fingerprint(text)


def test_spark_hash_agrees(spark):
    row = spark.sql("SELECT xxhash64('a b c d') AS h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c d", 42)


def texts():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(200)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out + [None, "", " ", out[0], out[0].upper(), "x"]


def test_whole_operator(spark):
    rows = list(enumerate(texts(), 10))
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_components([(d, brute_fingerprint(t)) for d, t in rows])
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("hot", [3, 4096])
def test_links_of_random_fingerprints(spark, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 120, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 6), replace=False)) for b in base[:60] for _ in range(3)]
    fps = sorted({*map(int, base), *near})
    edges = S.links(spark.createDataFrame([(x,) for x in fps], "fp long"), hot_bucket=hot)
    assert edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 4).count() == 0
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {x: got.get(x, x) for x in fps} == brute_components([(x, x % (1 << 64)) for x in fps])


def components_of(fps):
    """Smallest reachable fingerprint of each, by all pairs and labels that spread until nothing changes."""
    pairs = [np.nonzero(np.bitwise_count(fps[k : k + 500, None] ^ fps) <= 4) for k in range(0, len(fps), 500)]
    x, y = np.concatenate([p[0] + 500 * k for k, p in enumerate(pairs)]), np.concatenate([p[1] for p in pairs])
    label = np.arange(len(fps))
    while True:
        after = label.copy()
        np.minimum.at(after, x, label[y])
        if (after == label).all():
            return label
        label = after


@pytest.mark.parametrize(("hot", "part"), [(4096, 65536), (64, 256)])
def test_hot_buckets(spark, hot, part):
    """20,000 distinct fingerprints that differ in few places: buckets of thousands, which are split twice and then cut."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    flips = np.array([sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for n in rng.choice([4, 7, 9, 12], 20_000, p=[0.1, 0.2, 0.3, 0.4])])
    fps = np.unique(base ^ flips)
    edges = S.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), hot_bucket=hot, hot_part=part)
    assert edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > 4).count() == 0
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert [got.get(int(x), int(x)) for x in fps] == [int(fps[k]) for k in components_of(fps)]


def test_forest_with_probes():
    rng = np.random.default_rng(8)
    for _ in range(50):
        held, probes = (rng.integers(0, 1 << 9, n).astype(np.uint64) for n in (12, 8))
        u, v = S.forest(held, 1, probes)
        every = sorted({*map(int, held), *map(int, probes)})
        links = [(a, b) for a in every for b in every if a < b and (a ^ b).bit_count() <= 1 and (a in held or b in held)]
        label = {x: x for x in every}
        for _ in every:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        own = {x: x for x in every}
        for _ in every:
            for a, b in zip(map(int, u), map(int, v)):
                own[a] = own[b] = min(own[a], own[b])
        assert own == label and len(u) == len(every) - len(set(label.values()))


def test_plan_covers_the_radius():
    rng = np.random.default_rng(0)
    for n in (10, 10_000, 10**7, 10**9):
        plan = S.plan_index(n, rng.uniform(0.3, 0.7, 64), np.eye(64))
        assert sum(t + 1 for _, t in plan) >= 5 and all(t >= 0 for _, t in plan)
        used = [b for bits, _ in plan for b in bits]
        assert len(used) == len(set(used))


def test_correlated_bits_stay_together():
    c = np.eye(64)
    for a, b in ((0, 40), (5, 63)):
        c[a, b] = c[b, a] = 0.9
    groups = S.grouped_bits(c, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(any({a, b} <= set(g) for g in groups) for a, b in ((0, 40), (5, 63)))


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (7000, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_edges_and_stage(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 2), (1, "a b c d e f", "x", 2), (7, "quite another text here", None, 3), (None, "q", "y", 4)], "doc_id long, text string, component_id string, fp int")
    got = S.near_duplicates(docs).collect()
    assert len(got) == 5 and {(r["doc_id"], r["component_id"]) for r in got} == {(3, 1), (1, 1), (7, 7), (None, None)}
    kept = S.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 7]
