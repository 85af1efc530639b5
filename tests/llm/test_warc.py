import gzip
import hashlib

import pytest
from pyarrow import fs

from pagemill.llm import common
from pagemill.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows):
    """Expected (page_id, bytes, digest, type, refers_to) of every row."""
    out, lows, seen = [], {}, set()
    for p, _, h, _ in rows:
        data = (h or "").encode()
        if p is not None and len(data) >= 100:
            lows[data] = min(lows.get(data, p), p)
    for p, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        low, kind, to = lows.get(data), "response", None
        if low is not None and (p != low or (p, data) in seen):
            kind, to = "revisit", low
        seen.add((p, data))
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), kind, to))
    return sorted(out, key=str)


ROWS = [(1, "https://e.com/a", "x" * 200, "d"), (2, "https://e.com/b", "x" * 200, "d"), (None, "u", "x" * 200, "d"), (5, None, None, "d"), (6, "", "a", "d"), (7, "v\r\nX-Evil: 1", "a", "d"), (2, "https://e.com/b", "x" * 200, "d"), (9, "w", "é" * 60, "d"), (9, "w", "é" * 60, "d"), (-4, "n", "x" * 99, "d"), (-3, "n", "x" * 99, "d"), (10, "big", "y<p>\r\n\r\n" * 300_000, "d")]


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    manifest = W.write(df, common.new_path(spark, "warc"))
    assert result(W.read(manifest)) == brute(ROWS)
    got = {(r["page_id"], r["record_type"]): r for r in W.read(manifest, payload=True).collect()}
    for p, _, h, _ in ROWS:
        if (p, "response") in got:
            assert bytes(got[p, "response"]["payload"]) == (h or "").encode()
    assert got[2, "revisit"]["payload"] is None and got[7, "response"]["url"] == "v%0D%0AX-Evil:%201" and got[5, "response"]["url"] == "urn:page:5"


def files(spark, manifest):
    return {r["file"].rsplit("/", 1)[1]: (r["sha256"], r["records"], r["bytes"], r["file"]) for r in manifest.collect()}


def test_same_files_under_any_partitioning(spark):
    df = spark.createDataFrame(ROWS * 1 + [(100 + k, f"https://e.com/{k}", f"page {k} " * (k % 60), "d") for k in range(400)], SCHEMA)
    one, two = (files(spark, W.write(d, common.new_path(spark, "warc"), least_shards=7)) for d in (df, df.repartition(5)))
    assert {k: v[:3] for k, v in one.items()} == {k: v[:3] for k, v in two.items()} and len(one) == 7


def test_rolls_and_leaves_whole_files(spark):
    import random

    rng = random.Random(1)
    noise = lambda: "".join(chr(rng.randrange(33, 126)) for _ in range(3000))
    rows = [(k, "https://e.com/x", noise(), "d") for k in range(60)]
    manifest = W.write(spark.createDataFrame(rows, SCHEMA), common.new_path(spark, "warc"), least_shards=2, roll_bytes=20_000)
    named = files(spark, manifest)
    assert len(named) > 6 and sum(v[1] for v in named.values()) == 60
    folder = next(iter(named.values()))[3].rsplit("/", 1)[0]
    system, root = fs.FileSystem.from_uri(folder)
    present = {i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.is_file}
    assert present == set(named)  # no temporary file stays
    for sha, _, size, uri in named.values():
        with system.open_input_stream(fs.FileSystem.from_uri(uri)[1], compression=None) as f:
            data = f.read()
        assert hashlib.sha256(data).hexdigest() == sha and len(data) == size and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_retried_tasks_agree(spark, tmp_path):
    """Two attempts at one shard, and one that dies: one file counts, and what is left over goes."""
    records = [W.record(k, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), False, None, 0) for k in range(3)]
    found = []
    for _ in range(2):
        writer = W._ShardWriter(f"file://{tmp_path}/a", 1, 1 << 20)
        for raw in records:
            writer.add(raw)
        found.append(writer.close().to_pylist())
    assert found[0] == found[1] and [p.name for p in (tmp_path / "a").iterdir()] == [found[0][0]["file"].rsplit("/", 1)[1]]
    path = common.new_path(spark, "warc")
    dead = W._ShardWriter(path, 0, 1 << 20)
    dead.add(records[0])
    dead.stream.close()
    W.write(spark.createDataFrame(ROWS, SCHEMA), path)
    system, root = fs.FileSystem.from_uri(path)
    assert not [i for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(".shard")]


def test_many_shards_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGES", 4)
    rows = [(k, "u", f"page {k} " * 40, "d") for k in range(900)] + [(None, "n", f"null {k} " * 40, "d") for k in range(600)] + [(77, "h", f"hot {k} " * 40, "d") for k in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    manifests = [W.write(d, common.new_path(spark, "warc"), least_shards=24, shard_bytes=30_000) for d in (df, df.repartition(7))]
    assert result(W.read(manifests[0])) == brute(rows)
    one, two = (files(spark, m) for m in manifests)
    assert {k: v[:3] for k, v in one.items()} == {k: v[:3] for k, v in two.items()}
    sizes = [v[1] for v in one.values()]
    assert len(sizes) >= 18 and max(sizes) < 6 * sum(sizes) / len(sizes)
    read = W.read(manifests[0])
    assert read.rdd.getNumPartitions() == len(one) and sum(1 for n in read.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n) > len(one) // 2


def test_damage_is_noticed(spark, tmp_path):
    raw = W.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), False, None, 0)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(raw))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "file string")
    with pytest.raises(Exception, match="digest"):
        W.read(manifest).collect()
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(raw)[:-20])
    with pytest.raises(ValueError):
        list(W.members(f"file://{tmp_path}/y.warc.gz"))
    with pytest.raises(ValueError):
        W.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_empty(spark):
    assert W.read(W.write(spark.createDataFrame([], SCHEMA), common.new_path(spark, "warc"))).count() == 0


def test_only_null_ids(spark):
    rows = [(None, "u", "z" * 150, "d")] * 2
    got = result(W.read(W.write(spark.createDataFrame(rows, SCHEMA), common.new_path(spark, "warc"))))
    assert sorted(r[3] for r in got) == ["response", "revisit"]
