"""The pipeline stage by stage against plain Python, and the registered queries."""

import re
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from pagemill.llm import common, langid, mixing, packing, pii, registry, simhash

NAMES = ["op1_mixing", "op2_pivots", "op3_warc", "op4_packing", "op5_licenses", "op6_resharding", "op7_pii", "op8_langid", "op9_simhash", "op10_additive"]


def test_registered():
    queries = __spark_entry__.queries()
    assert [n for n in queries if n.startswith("op")] == NAMES and "pipeline" in queries
    assert [f for _, f in corpus_pipeline.STAGES] == [langid.stage, simhash.stage, pii.stage, mixing.stage, packing.stage]
    assert set(registry.ORACLES) <= set(queries)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = sorted(c[0] for c in found.description)
    place = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted((tuple(r[k] for k in place) for r in found.fetchall()), key=str)
    df = registry.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == want


def test_stages_against_plain_python(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    extra = spark.createDataFrame([(70_001, "?? 11", "en", "src1", 5), (70_002, None, None, None, None), (70_003, "Mail me: someone@mail.example.com about the house and the river there.", "en", "src2", 71)], docs.schema)
    now = common.write_table(docs.unionByName(extra), "pipeline-in")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        now = common.write_table(stage(spark, now, sf_dir), "pipeline")
        results.append(now)
    rows = [r.collect() for r in results]
    assert all(r.columns == docs.columns for r in results[:-1])

    languages = {r["doc_id"] for r in rows[0]}
    assert languages == {r["doc_id"] for r in docs.collect()} | {70_003}

    prints = {r["doc_id"]: simhash.fingerprint_of(r["text"]) for r in rows[0]}
    label = {d: d for d in prints}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    assert sorted(r["doc_id"] for r in rows[1]) == sorted({root(d) for d in ids})

    before = {r["doc_id"]: r["text"] for r in rows[1]}
    private = re.compile(r"\S+@mail\S*\.example\.com|\+1 \(\d{3}\) 555-\d{4}")
    assert sorted(before) == sorted(r["doc_id"] for r in rows[2])
    for r in rows[2]:
        assert r["n_chars"] == len(r["text"]) and not any(m in r["text"] for m in private.findall(before[r["doc_id"]]))
        if not re.search(r"[@\d\"]", before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r["source"] for r in rows[2]})
    sizes = [sum(size(r["text"]) for r in rows[2] if r["source"] == s) for s in sources]
    goal = mixing.targets(sizes, [1 + k % 3 for k in range(len(sources))], sum(sizes), 3)
    taken = Counter()
    for r in rows[3]:
        taken[r["source"]] += size(r["text"])
    assert all(abs(taken[s] - g) <= 1 for s, g in zip(sources, goal))
    whole = {r["doc_id"]: r["text"] for r in rows[2]}
    assert all(whole[r["doc_id"]].startswith(r["text"]) or r["text"] in whole[r["doc_id"]] for r in rows[3])

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter(tuple([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]) for r in rows[3])
    by_doc = Counter()
    for r in rows[4]:
        assert r["length"] == len(r["ids"])
        by_doc["ids"] += r["length"]
    assert by_doc["ids"] == sum(len(k) * n for k, n in want.items())
    lost = Counter(i for k, n in want.items() for i in k for _ in range(n))
    lost.subtract(i for r in rows[4] for i in r["ids"])
    assert not any(lost.values())


def test_run_is_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 0
