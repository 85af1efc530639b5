"""Language identification: script ranges narrow candidates, then Viterbi with a switching penalty over per-word scores.

A word's score for a language is the smoothed log-probability of its character n-grams and of the word itself; the
script of its letters first narrows the languages to those that were seen in that script. The best path over the words
pays a penalty at each change of language, which labels spans of mixed-language text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import documents, unused

#: Hash buckets of n-grams, and as many again of whole words.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: First code point of each script's range; ranges without a name count as Common (fixed values of the Unicode blocks).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"),
    (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"), (0x2C60, "Latin"),
    (0x2C80, "Common"), (0x2DE0, "Cyrillic"), (0x2E00, "Common"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Kana"), (0x3200, "Common"), (0x3400, "Han"), (0xA000, "Yi"), (0xA500, "Common"), (0xA640, "Cyrillic"), (0xA6A0, "Common"),
    (0xA720, "Latin"), (0xA800, "Common"), (0xAC00, "Hangul"), (0xD7B0, "Common"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Common"),
    (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Common"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0x10000, "Common"), (0x20000, "Han"), (0x30000, "Common"),
]
STARTS = np.array([x for x, _ in SCRIPTS], np.uint32)
NAMES = sorted({x for _, x in SCRIPTS})
SCRIPT_AT = np.array([NAMES.index(x) for _, x in SCRIPTS])
#: A word: letters, and the marks that go with them; texts without marks need the simpler pattern only.
WORD, MARK, MARKED_WORD = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{M}"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Words that a task scores at a time, and scored words that it keeps.
CHUNK, KEPT = 200_000, 300_000
#: Scale of a word's evidence, cost of a change of language, and share of a language's words that shows it uses a script.
SCALE, PENALTY, SCRIPT_SHARE = 0.3, 12.0, 0.005


def word_chunks(text: str | None) -> Iterator[list[str]]:
    """The words of a text in order, CHUNK at a time."""
    if not text:
        return
    low = text.lower()
    pattern = MARKED_WORD if not low.isascii() and MARK.search(low) else WORD
    if len(low) < CHUNK:
        words = pattern.findall(low)
        if words := words if low.isascii() else _letters(words):
            yield words
        return
    found = (m[0] for m in pattern.finditer(low))
    while words := list(islice(found, CHUNK)):
        if words := _letters(words):
            yield words


def _letters(words: list[str]) -> list[str]:
    """Beyond ASCII the pattern also finds signs such as a raised 2."""
    return [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def words_of(text: str | None) -> list[str]:
    return list(chain.from_iterable(word_chunks(text)))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, where each word's features start, and each word's script (of its first letter)."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    space = codes == 32
    owner = np.cumsum(space) - 1  # a space belongs to the word after it
    inner = np.concatenate(([0], np.cumsum(space)))
    h = np.zeros(len(codes), np.uint32)
    owners, numbers = [], []
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            ok = (inner[n - 1 : n - 1 + m] - inner[1 : m + 1] == 0) if n > 1 else ~space
            ok &= ~(space[:m] & space[n - 1 :]) if n <= 2 else True
            ok[-1:] &= owner[m - 1] < len(words)
            owners.append(owner[:m][ok])
            x = h[ok]
            numbers.append(((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)) % BUCKETS)
    starts = np.flatnonzero(space)[:-1] + 1
    lengths = np.diff(np.flatnonzero(space)) - 1
    # A whole word's number: a polynomial hash by prefix sums.
    powers = np.cumprod(np.concatenate(([1], np.full(int(lengths.max(initial=0)), 0x01000193))).astype(np.uint32), dtype=np.uint32)
    place = np.arange(len(codes)) - np.repeat(np.append(starts - 1, len(codes) - 1), np.append(lengths + 1, 1))
    terms = np.where(space, 0, codes * powers[np.minimum(place, len(powers) - 1)]).astype(np.uint32)
    total = np.add.reduceat(terms, starts) if len(starts) else np.zeros(0, np.uint32)
    owners.append(np.arange(len(words)))
    numbers.append(BUCKETS + ((total ^ (total >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)) % BUCKETS)
    owners, numbers = np.concatenate(owners), np.concatenate(numbers).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    first = np.searchsorted(owners[order], np.arange(len(words)))
    script = SCRIPT_AT[np.searchsorted(STARTS, codes[starts], side="right") - 1]
    return numbers[order], first, script


# ---------------------------------------------------------------- training


@dataclass(frozen=True)
class Model:
    """langs: in order of frequency. table: features x langs, float32. allowed: scripts x langs."""

    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        """words x langs; a word of a script that no language uses has no evidence, one narrowed out has -1e4."""
        numbers, first, script = features(words)
        got = SCALE * np.add.reduceat(self.table[numbers], first, axis=0) if len(words) else np.zeros((0, len(self.langs)), np.float32)
        got -= got.max(axis=1, keepdims=True)
        can = self.allowed[script]
        got = np.where(can, got, np.float32(-1e4))
        if len(self.langs) == 1:  # nothing to compare: any word that it can have speaks for it
            got[can] = -1
        got[~can.any(axis=1)] = 0
        return got.astype(np.float32)


def train(labelled: DataFrame, rows_per_lang: int = 2000, seed: int = 8) -> Model:
    """From labelled (doc_id, text, lang): n-gram counts over a sample of about rows_per_lang rows of each language,
    chosen by a keyed hash of doc_id (all rows of a language that has fewer). Counting runs on the executors; the
    driver gets one number per language and bucket."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts, key=lambda x: (-counts[x], x))
    if not langs:
        return Model([], np.zeros((2 * BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(y) for x in langs for y in (x, min(1.0, rows_per_lang / counts[x]))])
    sample = rows.where(draw < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                for words in word_chunks(text.as_py()):
                    numbers, _, script = features(words)
                    own = sums.setdefault(lang.as_py(), np.zeros(2 * BUCKETS + len(NAMES), np.int64))
                    own[: 2 * BUCKETS] += np.bincount(numbers, minlength=2 * BUCKETS)
                    own[2 * BUCKETS :] += np.bincount(script, minlength=len(NAMES))
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], names=["lang", "at", "n"])

    found = sample.select("text", "lang").mapInArrow(count, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((2 * BUCKETS + len(NAMES), len(langs)))
    column = {x: k for k, x in enumerate(langs)}
    table[found["at"].to_numpy(), [column[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    logs = np.empty((2 * BUCKETS, len(langs)), np.float32)
    for part in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        logs[part] = np.log((table[part] + 0.5) / (table[part].sum(axis=0) + 0.5 * BUCKETS))
    scripts = table[2 * BUCKETS :]
    return Model(langs, logs, scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=0), 1))


# ---------------------------------------------------------------- prediction


class Trellis:
    """Viterbi over rows that come piece by piece: sums are carried on, and of each row only where a change of label
    would come from (one number) and which labels it reaches (a bit each) is kept."""

    def __init__(self, n: int, penalty: float):
        self.n, self.penalty, self.rows, self.now = n, penalty, 0, None
        self.sources: list[np.ndarray] = []
        self.changed: list[np.ndarray] = []

    def add(self, scores: np.ndarray) -> None:
        for at in range(0, len(scores), 4096):
            now, sources, changed = self.now, [], []
            if now is not None:
                top = max(now)
                now = [x - top for x in now]  # sums stay small over very long texts
            for row in scores[at : at + 4096].tolist():
                if now is None:
                    now, k, flags = row, 0, [False] * self.n
                else:
                    top = max(now)
                    k, enter = now.index(top), top - self.penalty
                    flags = [x < enter for x in now]
                    now = [(enter if f else x) + s for x, f, s in zip(now, flags, row)]
                sources.append(k)
                changed.append(flags)
            self.now = now
            self.rows += len(sources)
            self.sources.append(np.array(sources, np.int16))
            self.changed.append(np.packbits(np.array(changed, bool), axis=1))

    def path(self) -> np.ndarray:
        out = np.empty(self.rows, np.int16)
        at, label = self.rows, self.now.index(max(self.now)) if self.rows else 0
        for sources, changed in zip(reversed(self.sources), reversed(self.changed)):
            flags, sources = np.unpackbits(changed, axis=1, count=self.n).astype(bool), sources.tolist()
            for i in range(len(sources) - 1, -1, -1):
                at -= 1
                out[at] = label
                if flags[i, label]:
                    label = sources[i]
        return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row of scores when every change of label costs penalty.

    First an exact shortcut: if no run of words gains more than the penalty over the best single label, that label is
    the best path.
    """
    t, n = scores.shape
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    if n == 1 or t == 0:
        return np.zeros(t, np.int64)
    gain = scores - scores[:, best : best + 1]
    gain[:, best] = -np.inf
    sums = np.concatenate(([0.0], np.cumsum(gain.max(axis=1), dtype=np.float64)))
    if (sums - np.minimum.accumulate(sums)).max() <= penalty:
        return np.full(t, best)
    trellis = Trellis(n, penalty)
    trellis.add(scores)
    return trellis.path()


def label(text: str | None, known: Known, penalty: float) -> tuple[str, float, list[tuple[str, int, int]]]:
    """(language, score, spans) of a whole text; a long one is scored chunk by chunk, first for the path and again for
    what its words say, so memory holds one chunk and a few bytes a word."""
    langs = known.model.langs
    pieces = word_chunks(text) if langs else iter(())
    first = next(pieces, None)
    if first is None:
        return "und", 0.0, []
    second = next(pieces, None)
    if second is None:
        scores = known.scores(first)
        path, scored = viterbi(scores, penalty), iter([scores])
    else:
        trellis = Trellis(len(langs), penalty)
        for words in chain([first, second], pieces):
            trellis.add(known.scores(words))
        path, scored = trellis.path(), map(known.scores, word_chunks(text))
    votes, totals, at = np.zeros(len(langs), np.int64), np.zeros((len(langs), len(langs))), 0
    for scores in scored:
        own, sure = path[at : at + len(scores)], scores.any(axis=1)
        at += len(scores)
        votes += np.bincount(own[sure], minlength=len(langs))
        for k in np.unique(own[sure]):
            totals[k] += scores[sure & (own == k)].sum(axis=0, dtype=np.float64)
    if not votes.any():  # words of scripts, or equal evidence, that tell nothing
        return langs[0], 0.0, []
    best = int(votes.argmax())
    chance = 1 / np.exp(np.minimum(totals[best] - totals[best][best], 50)).sum()
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    spans = [(langs[path[a]], a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    return langs[best], float(min(1.0, chance * votes[best] / votes.sum())), spans


class Known:
    """Words that a task has scored: their numbers, and the scores by number."""

    def __init__(self, model: Model):
        self.model, self.number, self.table = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        if len(self.number) > KEPT:
            self.number.clear()
        number = self.number
        if new := list(dict.fromkeys(filterfalse(number.__contains__, words))):
            first = len(number)
            number.update(zip(new, range(first, first + len(new))))
            if len(number) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(len(number) - len(self.table), len(self.table), 1024), self.table.shape[1]), np.float32)])
            self.table[first : len(number)] = self.model.score(new)
        return self.table[np.fromiter(map(number.__getitem__, words), np.int64, len(words))]


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = True, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = ("lang_pred", "score", "spans")) -> DataFrame:
    """docs (text, ...) -> keep's columns and (lang_pred, score[, spans]), one row per row, from the text alone.

    lang_pred is the language of most words on the best path; score (0 to 1) is their share times the probability of
    their language; spans lists (lang, first word, word after the last). A null text, or one with no letter, is 'und'
    with score 0 and no spans, and so is every text when nothing was learned. Letters of scripts that no language uses
    give the most frequent language with score 0. Ties go to the more frequent language. Texts of any length are read
    whole, a chunk of words at a time. Repeated rows get equal rows, columns not in keep are ignored (names renames the new ones where they clash),
    an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sent = [*keep] if "text" in keep else [*keep, F.col("text").alias("_text")]  # a text goes to Python once
    place = keep.index("text") if "text" in keep else len(keep)
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("stop", pa.int32())]))
    names = names[: 2 + spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Known(model)
        for batch in batches:
            found = []
            for text in batch.column(place):
                found.append(label(text.as_py(), known, penalty))
            columns = [*batch.columns[: len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                columns.append(pa.array([[{"lang": a, "first": b, "stop": c} for a, b, c in x[2]] for x in found], span))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    schema = T.StructType([docs.schema[c] for c in keep])
    for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.ArrayType(T.StructType().add("lang", "string").add("first", "integer").add("stop", "integer")))):
        schema = schema.add(name, kind)
    return docs.select(*sent).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3, is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_folds(docs: DataFrame) -> Model:
    """Learns from the rows that aren't held out; a row without doc_id belongs to no fold and teaches nothing."""
    return train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, train_on_folds(docs), spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: und, or no word that speaks for a learned language (score 0), as of letters that
    none uses. Mixed texts stay, however many languages they have. When nothing was learned, all texts with a letter stay.
    Null and empty texts go; long ones are read whole; repeated rows stay repeated; rows without doc_id teach nothing and
    stay like others; extra columns of any name pass through; an empty table gives an empty one.
    """
    model = train_on_folds(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = unused("_lang_pred", docs.columns), unused("_score", docs.columns)
    found = identify(docs, model, spans=False, keep=tuple(docs.columns), names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) > 0)).select(*docs.columns)
