"""Writers: a file per page, JSON lines, ordered parts, and the corpus texts."""

from __future__ import annotations

import codecs
import os
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import scratch
from pagemill.functions import expressions as E
from pagemill.functions import urls
from pagemill.operators import corpus
from pagemill.options import Options

#: Names of the corpus files (fixed values).
INDEX, LLMS, FULL, LINES = "00_INDEX.md", "llms.txt", "FULL_CONTEXT.md", "docs.jsonl"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def put(path: str, data: bytes) -> None:
    """A whole file under a temporary name, then its own."""
    system, place = _open(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    temporary = f"{os.path.dirname(place)}/.{os.path.basename(place)}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    system.move(temporary, place)


def write_pages(pages: DataFrame, folder: str, order: str = "page_id") -> DataFrame:
    """A markdown file per page, written by the executors; returns (ix, file) after an action on it."""
    return write_numbered(corpus.numbered(pages, order), folder)


def write_numbered(numbered: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                put(f"{folder}/{name}", (text or "").encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["ix", "file"])

    rows = numbered.select("ix", E.page_filename(F.col("ix"), F.col("total"), F.col("url")).alias("file"), "markdown")
    return rows.mapInArrow(run, "ix long, file string")


def write_json_lines(pages: DataFrame, path: str, order: str = "page_id") -> None:
    """Text parts of JSON lines, in order."""
    ordered_parts(corpus.json_lines(pages, order), path)


def write_parts(pages: DataFrame, path: str, order: str = "page_id") -> None:
    """The full context in ordered text parts, for corpora beyond one file."""
    ordered_parts(corpus.context_lines(corpus.numbered(pages, order)), path)


def ordered_parts(lines: DataFrame, path: str) -> None:
    """lines (ix, line) as text parts whose names follow ix."""
    lines.select("ix", "line").repartitionByRange("ix").sortWithinPartitions("ix").select("line").write.text(path)


def join_parts(parts: str, write) -> None:
    """Give write() the bytes of ordered parts, a piece at a time: nothing is held whole."""
    system, root = _open(parts)
    names = sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.is_file and i.base_name.startswith("part-"))
    for name in names:
        with system.open_input_stream(name, compression=None) as source:
            while data := source.read(1 << 20):
                write(data)


def put_lines(path: str, head: str, lines: DataFrame) -> None:
    """One file of head and the lines in order: executors write parts, which are copied together in pieces."""
    parts = scratch.folder(lines.sparkSession, "parts")
    ordered_parts(lines, parts)
    system, place = _open(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    temporary = f"{os.path.dirname(place)}/.{os.path.basename(place)}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(head.encode("utf-8", "surrogatepass"))
        join_parts(parts, out.write)
    system.move(temporary, place)


def render(pages: DataFrame, options: Options, out=None, order: str = "page_id") -> None:
    """A folder of files, or JSON lines, or one file, or the standard output: the first that options ask for.

    Pages are numbered once. Texts of the whole corpus are written in parts by the executors and copied together piece by
    piece, so neither a row nor the driver holds one.
    """
    out = out or sys.stdout
    base = urls.parse(options.url)
    rows = corpus.numbered(pages, order)
    if options.output_dir:
        write_numbered(rows, options.output_dir).count()
        host = base.host if base else None
        for name, head, lines in ((INDEX, corpus.index_head(), corpus.index_lines(rows)), (LLMS, corpus.llms_head(host), corpus.llms_lines(rows)), (FULL, corpus.context_head(), corpus.context_lines(rows))):
            put_lines(f"{options.output_dir}/{name}", corpus.head_text(rows, head), lines)
        put_lines(f"{options.output_dir}/{LINES}", "", corpus.json_lines_of(rows))
        return
    lines = corpus.json_lines_of(rows) if options.jsonl else corpus.concatenation_lines(rows)
    if options.output:
        put_lines(options.output, "", lines)
    else:
        parts = scratch.folder(rows.sparkSession, "parts")
        ordered_parts(lines, parts)
        decoder = codecs.getincrementaldecoder("utf-8")("surrogatepass")
        join_parts(parts, lambda data: out.write(decoder.decode(data)))
