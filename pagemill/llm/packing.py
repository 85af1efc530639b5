"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, and pieces of equal
length form a bucket. Each piece is a sequence of its own, so none crosses documents and none needs padding."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import documents, worker_cache

#: Words whose ids a generation of a Python worker's cache keeps, the longest it keeps, and characters of a text that it splits at a time.
KEPT, LONGEST, SLICE = 450_000, 40, 1 << 20
#: How a word-level tokenizer splits texts, and the same for lower-cased Latin-1: its letters, digits and white space. What starts like
#: "'s" stands before other marks in both.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN_SPLIT = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
#: New pre-tokens that one call of the tokenizer gets.
TOGETHER = 4096


def is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def decompose(n: int, context: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole contexts, then the powers of two of the rest, longest first."""
    out = [(k * context, context) for k in range(n // context)]
    at, rest = n - n % context, n % context
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


class WordEncoder:
    """A tokenizer whose pre-tokenizer never joins what blanks separate: ids of a text are those of its words.

    Texts are split at spaces and line feeds only; a word that holds other white space goes to the tokenizer whole.
    Texts of Latin-1 alone, which composition doesn't change and lower case changes letter by letter, are split into
    pre-tokens as the tokenizer does, unless its split is another or they hold one of its added tokens.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end], "<u4").tobytes()
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            cuts = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.latin = bool(cuts) and cuts[0].get("pattern") == {"Regex": SPLIT}
        self.known: dict[str, bytes] = {"": b""}  # the young generation; the old one is the last that was full
        self.old: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids, the end id last."""
        parts, at = [], 0
        text = text or ""
        latin = self.latin and is_latin(text) and not any(x in text for x in self.added)
        while at < len(text):
            stop = at + SLICE
            if stop < len(text):
                ends = [x for x in (text.find(" ", stop), text.find("\n", stop)) if x >= 0]
                stop = min(ends, default=len(text))
            parts.append(self._pre_tokens(LATIN_SPLIT.findall(text[at:stop].lower())) if latin else self._words(text[at:stop].replace("\n", " ").split(" ")))
            at = stop
        return b"".join([*parts, self.end])

    def _pre_tokens(self, words: list[str]) -> bytes:
        if len(self.known) > KEPT:
            self.old, self.known = self.known, {"": b""}
        new = set(words).difference(self.known)
        if new:
            fresh = []
            for word in new:
                ids = self.old.get(word)
                if ids is None:
                    fresh.append(word)
                else:
                    self.known[word] = ids
            for k in range(0, len(fresh), TOGETHER):
                self._learn(fresh[k : k + TOGETHER])
        out = b"".join(map(self.known.__getitem__, words))
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]
        return out

    def _learn(self, words: list[str]) -> None:
        """Ids of pre-tokens, by one call for all: blanks between them go, and each keeps its place."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, ends = np.array(found.ids, "<u4").tobytes(), 4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(words)))
        at = 0
        for word, end in zip(words, ends.tolist()):
            self.known[word] = ids[at:end]
            at = end

    def _words(self, words: list[str]) -> bytes:
        got = list(map(self.known.get, words))
        if None in got:
            for i, ids in enumerate(got):
                if ids is None:
                    got[i] = self._word(words[i])
        return b"".join(got)

    def _word(self, word: str) -> bytes:
        """Of a word that isn't in the young generation. Letters of Latin-1 with a full stop or comma after them are
        two pre-tokens, and lower case and composition don't change such letters' neighbours, so only the lower-cased
        letters are kept."""
        core = word[:-1] if word[-1] in ".," else word
        if core.isalpha() and max(core) < "\u0100":
            ids = self._kept(core.lower())
            return ids if core is word else ids + self._kept(word[-1])
        return self._kept(word)

    def _kept(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            if len(word) <= LONGEST:
                if len(self.known) > KEPT:
                    self.old, self.known = self.known, {"": b""}
                self.known[word] = ids
        return ids


class TextEncoder:
    """Any other tokenizer: whole texts, as it takes them."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end], "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes() + self.end


def encoder_for(path: str, end: int) -> WordEncoder | TextEncoder:
    """By words where the tokenizer's own file says that it composes and lower-cases texts, makes white space blanks and
    drops it, and has nothing else that looks beyond a word; else by whole texts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal, pre = (spec.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    steps = [(x.get("type"), x.get("pattern"), x.get("content")) for x in normal.get("normalizers", [])]
    cuts = pre.get("pretokenizers", [])
    words = (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and len(cuts) == 2
        and (cuts[0].get("type"), cuts[0].get("behavior"), cuts[0].get("invert")) == ("Split", "Removed", True)
        and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in cuts[0].get("pattern", {}).get("Regex", "")
        and (cuts[1].get("type"), cuts[1].get("add_prefix_space"), cuts[1].get("use_regex")) == ("ByteLevel", False, False)
        and spec["model"].get("dropout") is None
    )
    return (WordEncoder if words else TextEncoder)(path, end)


def pack(docs: DataFrame, tokenizer: str, context: int = 2048, end: int = 1, ids: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset[, ids array<int>]).

    Every piece is a sequence: its length is a power of two up to context, its offset 0. sequence_id holds the length's
    logarithm in its top byte, so buckets of equal length are ranges of ids, then the partition and a count; it is
    unique, needs no shuffle, and a retried task gives the same ids for the same rows. A null or empty text has the end
    id only, so one piece of length 1; texts of any length are read whole, a slice at a time. Repeated rows get pieces
    and sequences of their own, so nothing ties; other columns are ignored; an empty table gives an empty one. tokenizer
    is a tokenizers file; one that works word by word has its words' ids cached, any other takes whole texts.
    """
    if context & (context - 1):
        raise ValueError("context must be a power of two")
    schema = T.StructType([docs.schema["doc_id"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_cache((tokenizer, end), lambda: encoder_for(tokenizer, end)), TaskContext.get().partitionId() << 32
        counts = [(k << 56) + part for k in range(context.bit_length())]
        for batch in batches:
            at, rows, content, size = [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                encoded = encoder.encode(text.as_py())
                n = len(encoded) // 4
                for start, length in decompose(n, context):
                    piece, k = encoded[4 * start : 4 * (start + length)], length.bit_length() - 1
                    at.append(i)
                    rows.append((start, length, zlib.crc32(piece), n, counts[k], 0))
                    counts[k] += 1
                    if ids:
                        content.append(piece)
                        size += len(piece)
                if size > 1 << 23 or len(rows) > 1 << 17:
                    yield _batch(batch, at, rows, content if ids else None, schema)
                    at, rows, content, size = [], [], [], 0
            if rows:
                yield _batch(batch, at, rows, content if ids else None, schema)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, at: list, rows: list, content: list[bytes] | None, schema: T.StructType) -> pa.RecordBatch:
    table = np.array(rows, np.int64)
    columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(table.shape[1]))]
    if content is not None:
        values = np.frombuffer(b"".join(content), "<u4").astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(table[:, 1]))).astype(np.int32)), pa.array(values)))
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per piece length, from which a trainer draws batches of equal lengths."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path(), ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed corpus: every piece with its ids. Null and empty texts are one piece of the end id; long texts, repeated
    rows, clashing columns and empty tables are as in pack()."""
    return pack(docs, tokenizer_path())
