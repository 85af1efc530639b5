"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by key into shards whose bounds come from the data alone, so the same table gives the same
files under any partitioning. Each shard rolls its files by compressed size; headers, record ids and digests are
regenerated from the payload. A file is written under a temporary name and, when it is whole, gets a name with its own
digest, so a retried or speculative task comes to the same name with the same bytes and finds it taken. A manifest in
the archive's folder, committed after all shards, lists the files that count; then temporary ones are removed.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import hash_sample, new_path, write_table

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Shards at least, bytes of payload per shard beyond that, compressed bytes after which a file rolls.
LEAST_SHARDS, SHARD_BYTES, ROLL_BYTES = 64, 256 << 20, 128 << 20
#: Rows that bounds are cut from (those with the smallest hash), ranges that they make at most, and rows for each shard
#: by which executors cut the ranges further.
BOUND_ROWS, RANGES, SHARD_ROWS = 20_000, 1024, 64
#: Tasks that read an archive back, at most.
MOST_TASKS = 1 << 16
#: The date that records carry.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("binary"), F.lit(b""))


def _cuts(rows: list[tuple[float, int]], shards: int) -> list[float]:
    """Inner bounds that split rows (key, bytes), in order, into shards of about equal bytes."""
    total, run, out = sum(b for _, b in rows), 0, []
    for key, size in rows:
        if run >= total * (len(out) + 1) / shards and (not out or key > out[-1]):
            out.append(key)
        run += size
    return out


def _bounds(light: DataFrame, shards: int) -> list[float]:
    """Inner bounds of page_id that split a hash sample's bytes evenly; the sample is the same on every run.

    Up to RANGES shards are cut from BOUND_ROWS rows. More are cut within such ranges, on the executors, from a sample
    that grows with the shards; the driver gets the bounds alone, a number per shard.
    """
    good, n = light.where("page_id IS NOT NULL"), light.count()
    sample = hash_sample(good, n, BOUND_ROWS, ["page_id", "digest"], ["page_id", "payload_bytes"]).collect()
    out = _cuts(sorted((float(r["page_id"]), r["payload_bytes"] + 500) for r in sample), min(shards, RANGES))
    if shards <= RANGES:
        return out
    chance = min(1.0, SHARD_ROWS * shards / max(n, 1))
    keyed = good.where(F.xxhash64("page_id", "digest") < int(chance * (2**64 - 1)) - 2**63) if chance < 1 else good
    each = -(-shards // (len(out) + 1))

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(frame["page_id"].astype(float), (frame["payload_bytes"] + 500).tolist()))
        return pd.DataFrame({"bound": _cuts(rows, each)}, dtype="float64")

    finer = _with_shard(keyed.select("page_id", "payload_bytes", "digest"), out, 0).groupBy("shard").applyInPandas(cut, "bound double")
    return sorted({*out, *(r["bound"] for r in finer.collect())})


def _with_shard(df: DataFrame, bounds: list[float], alike: int) -> DataFrame:
    """Adds shard: by binary search among the bounds; rows without page_id, and those of a page_id that is a bound of
    alike ones (too many bytes for a shard), go by digest."""
    if not bounds:
        return df.withColumn("shard", F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_key", outputCol="_bucket", handleInvalid="keep")
    found = cut.transform(df.withColumn("_key", F.coalesce(F.col("page_id").cast("double"), F.lit(float("-inf")))))
    loose = F.col("page_id").isNull() | (F.col("_hot") if alike else F.lit(False))
    by_digest = F.pmod(F.xxhash64("digest"), F.lit(len(bounds) + 1)).cast("int")
    return found.withColumn("shard", F.when(loose, by_digest).otherwise(F.col("_bucket").cast("int"))).drop("_key", "_bucket")


def write(pages: DataFrame, path: str, least_shards: int = LEAST_SHARDS, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """pages (page_id, url, html, ...) -> the manifest (file, shard, records, bytes, sha256) of the archive at path.

    Of records with equal payloads of at least LEAST_REVISIT bytes the one with the smallest page_id is a response and
    the others revisit it; a null page_id counts as the largest. Repeated rows (page_id and payload equal): the first
    in the file is the response, the others revisit it. A null html is an empty payload, a null url a urn. Rows without
    page_id, and those of a page_id that alone has more bytes than a shard, are dealt by digest. Other columns are
    ignored, whatever their names; an empty table gives no files. Page texts cross the network once; duplicates are found
    on digests, and what they refer to is merged in by the sort. A record and its compressed form are held whole, so the
    longest payload must fit a task's memory twice.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload(F.col("html")).alias("payload"))
    light = write_table(rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-digests")
    total = light.agg(F.sum("payload_bytes")).first()[0] or 0
    bounds = _bounds(light, max(least_shards, -(-total // shard_bytes)))
    hot = write_table(light.where("page_id IS NOT NULL").groupBy("page_id").agg(F.sum("payload_bytes").alias("b")).where(F.col("b") > shard_bytes).select("page_id", F.lit(True).alias("_hot")), "warc-hot")
    many = hot.count()  # fewer than total / shard_bytes
    groups = light.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = groups.where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    again = light.join(groups, "digest").where("page_id IS NULL OR page_id > refers_to").select("page_id", "digest", "refers_to").distinct()

    records = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    marks = again.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    both = records.unionByName(marks)
    if many:
        both = both.join(hot if many > BOUND_ROWS else F.broadcast(hot), "page_id", "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    dealt = _with_shard(both, bounds, many).repartitionById(len(bounds) + 1, "shard")
    ordered = dealt.sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, mark, last = None, None, None
        for batch in batches:
            for shard, page_id, digest, kind, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                key = (page_id, digest)
                if kind == 0:
                    mark = (key, refers_to)
                    continue
                if out is None or out.shard != shard:
                    if out is not None:
                        yield out.close()
                    out, last = _ShardWriter(path, shard, roll_bytes), None
                nth = last[1] + 1 if last and last[0] == key else 0
                last = (key, nth)
                revisit, to = False, None
                if mark and mark[0] == key:
                    revisit, to = True, mark[1]
                elif nth and len(payload) >= LEAST_REVISIT:
                    revisit, to = True, page_id
                out.add(record(page_id, url, payload, digest, revisit, to, nth))
        if out is not None:
            yield out.close()

    manifest = ordered.select("shard", "page_id", "digest", "kind", "url", "payload", "refers_to").mapInArrow(run, "file string, shard int, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{path.rstrip('/')}/manifest")
    system, root = fs.FileSystem.from_uri(path)
    for left in system.get_file_info(fs.FileSelector(root)):  # of attempts that failed
        if left.is_file and left.base_name.startswith(".shard-"):
            system.delete_file(left.path)
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{path.rstrip('/')}/manifest")


def _record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}/{nth}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | None, nth: int) -> bytes:
    """One WARC/1.1 record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest, nth)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 0)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    body = b"software: pagemill\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(None, name, 0)}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


class _ShardWriter:
    """The files of one shard, each whole before it gets its name."""

    def __init__(self, path: str, shard: int, roll_bytes: int):
        self.fs, self.root = fs.FileSystem.from_uri(path)
        self.fs.create_dir(self.root, recursive=True)
        self.path, self.shard, self.roll, self.attempt = path, shard, roll_bytes, uuid.uuid4().hex
        self.files: list[tuple] = []
        self.stream = None

    def add(self, raw: bytes) -> None:
        if self.stream is None:
            self.name = f"shard-{self.shard:06d}-{len(self.files):05d}"
            self.stream = self.fs.open_output_stream(f"{self.root}/.{self.name}.{self.attempt}")
            self.bytes, self.records, self.digest = 0, 0, hashlib.sha256()
            self._member(_info(self.name))
        self._member(raw)
        self.records += 1
        if self.bytes >= self.roll:
            self._finish()

    def _member(self, raw: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member per record, without a time
        data = packer.compress(raw) + packer.flush()
        self.stream.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def _finish(self) -> None:
        self.stream.close()
        self.stream = None
        temporary, final = f"{self.root}/.{self.name}.{self.attempt}", f"{self.name}-{self.digest.hexdigest()[:16]}.warc.gz"
        if self.fs.get_file_info(f"{self.root}/{final}").type == fs.FileType.NotFound:
            self.fs.move(temporary, f"{self.root}/{final}")
        else:  # another attempt wrote the same bytes
            self.fs.delete_file(temporary)
        self.files.append((f"{self.path}/{final}", self.shard, self.records, self.bytes, self.digest.hexdigest()))

    def close(self) -> pa.RecordBatch:
        if self.stream is not None:
            self._finish()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in self.files], kind) for k, kind in enumerate(kinds)], names=["file", "shard", "records", "bytes", "sha256"])


# ---------------------------------------------------------------- reading


def members(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    source, path = fs.FileSystem.from_uri(uri)
    with source.open_input_stream(path, compression=None) as stream:
        data, engine, parts = b"", zlib.decompressobj(31), []
        while data or (data := stream.read(chunk)):
            parts.append(engine.decompress(data))
            data = engine.unused_data
            if engine.eof:
                yield b"".join(parts)
                engine, parts = zlib.decompressobj(31), []
        if parts and any(parts):
            raise ValueError(f"{uri} ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records of a manifest's files: (page_id, url, payload_bytes, payload_digest, record_type, refers_to[,
    payload binary, null for revisits]). A response's length and digest come from its payload, which must agree with
    its header; a revisit's from its header. Other record types are passed over."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for file in batch.column(0).to_pylist():
                for raw in members(file):
                    fields, block = parse(raw)
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    http, _, body = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    length = next(int(x[15:]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:"))
                    whole = fields["warc-type"] == "response"
                    if whole and (hashlib.sha256(body).hexdigest() != digest or len(body) != length):
                        raise ValueError(f"a payload of {file} doesn't have its digest")
                    number = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
                    rows.append((number("x-page-id"), fields["warc-target-uri"], length, digest, fields["warc-type"], number("x-refers-to-page-id"), body if whole else None)[: len(names)])
                    size += len(body) if payload else 0
                    if len(rows) >= 10_000 or size > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    tasks = min(max(manifest.count(), 1), MOST_TASKS)  # a given number isn't merged: about a file a task
    return manifest.select("file").repartition(tasks, "file").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read(write(pages, new_path(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS low FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN low < page_id THEN low END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
