"""License scans by template-markup matching.

A template is a license's wording with markup: ``<<optional>> ... <</optional>>`` regions may be missing, and
``<<any N>>`` stands for up to N words of any kind. Templates compile into token automata; a text is accepted at a
place where all mandatory words match exactly and in order. Words are runs of ASCII digits, ASCII letters (case does
not count) and all characters beyond ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import documents

#: Phrases whose places are counted, and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates by label: notices and wordings of common licenses (fixed values).
TEMPLATES = {
    "MIT": """
        <<optional>>The MIT License <<optional>>(MIT)<</optional>><</optional>> <<optional>>Copyright <<any 24>><</optional>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<optional>>(including the next paragraph)<</optional>>
        shall be included in all copies or substantial portions of the Software.
        <<optional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND<<any 90>><</optional>>""",
    "MIT-notice": "<<optional>>This <<any 6>> is<</optional>> <<optional>>distributed<</optional>> <<optional>>released<</optional>> <<optional>>licensed<</optional>> under the <<optional>>terms of the<</optional>> MIT License",
    "Apache-2.0": "<<optional>>This <<any 6>> is<</optional>> Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<any 3>> except in
        compliance with the License. You may obtain a copy of the License at
        <<optional>>http<<optional>>s<</optional>>://www.apache.org/licenses/LICENSE-2.0<</optional>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-2.0": "licensed under the <<optional>>terms of the<</optional>> GNU General Public License, version 2",
    "GPL-3.0": "licensed under the <<optional>>terms of the<</optional>> GNU General Public License, version 3",
    "GPL-header": """
        This program is free software<<any 2>> you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation<<any 2>> either version <<any 2>> of the
        License, or (at your option) any later version.""",
    "BSD-2-Clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<optional>>1.<</optional>> Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. <<optional>>2.<</optional>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "ISC": """
        Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with
        or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in
        all copies.""",
    "CC-BY-4.0": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY 4.0",
    "CC-BY-SA-4.0": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY SA 4.0",
    "CC-BY-NC-4.0": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY NC 4.0",
    "CC-BY": """
        licensed under a Creative Commons Attribution <<optional>>NonCommercial<</optional>>
        <<optional>>ShareAlike<</optional>> 4.0 International License""",
}

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: One character of a word, and of what lies between words, for Java's expressions.
IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
OUT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


# ---------------------------------------------------------------- automata


@dataclass(frozen=True)
class Automaton:
    """States 0..n; the last one accepts. steps[s]: word -> next state; skips[s]: states entered without a word;
    loops[s]: the state after any one word, or None. mandatory: words that every accepted text holds."""

    steps: tuple[tuple[bytes, int] | None, ...]
    skips: tuple[tuple[int, ...], ...]
    loops: tuple[int | None, ...]
    mandatory: frozenset[bytes]

    def close(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skips[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted run of words that starts at at, or None."""
        states, end, last = self.close({0}), None, len(self.steps) - 1
        for k in range(at, len(words) + 1):
            if last in states:
                end = k
            if k == len(words):
                break
            after = set()
            for s in states:
                if (step := self.steps[s]) and step[0] == words[k]:
                    after.add(step[1])
                if self.loops[s] is not None:
                    after.add(self.loops[s])
            if not after:
                break
            states = self.close(after)
        return end

    def starts(self) -> set[bytes]:
        return {self.steps[s][0] for s in self.close({0}) if self.steps[s]}


MARKUP = re.compile(r"<<(optional|/optional|any \d+)>>")


def compile_template(template: str) -> Automaton:
    steps, skips, loops, mandatory, opened = [None], [[]], [None], set(), []

    def state() -> int:
        steps.append(None)
        skips.append([])
        loops.append(None)
        return len(steps) - 1

    for k, part in enumerate(MARKUP.split(template)):
        if k % 2 == 0:
            for word in words_of(part):
                now = len(steps) - 1
                steps[now] = (word, state())
                if not opened:
                    mandatory.add(word)
        elif part == "optional":
            now = len(steps) - 1
            skips[now].append(state())
            opened.append(now)
        elif part == "/optional":
            end = len(steps) - 1
            skips[end].append(state())
            skips[opened.pop()].append(len(steps) - 1)
        else:
            entered = len(steps) - 1
            ways = [entered]
            for _ in range(int(part.split()[1])):
                now = len(steps) - 1
                loops[now] = state()
                ways.append(loops[now])
            end = state()
            for s in ways:
                skips[s].append(end)
    if opened:
        raise ValueError("an optional region isn't closed")
    if not mandatory:
        raise ValueError("a template needs mandatory words")
    return Automaton(tuple(steps), tuple(map(tuple, skips)), tuple(loops), frozenset(mandatory))


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        self.phrases = {tuple(words_of(p)): label for p, label in phrases.items()}

    def scan(self, text: str | None) -> tuple[list[int], set[str], set[str], float, list[tuple[str, int, int]]]:
        """Base places, base labels, the method's labels, score, and the method's spans (label, first word, end)."""
        words = words_of(text)
        at: dict[bytes, list[int]] = {}
        for k, w in enumerate(words):
            at.setdefault(w, []).append(k)
        places, base = [], set()
        for phrase, label in self.phrases.items():
            for k in at.get(phrase[0], ()):
                if tuple(words[k : k + len(phrase)]) == phrase:
                    places.append(k)
                    base.add(label)
        spans = []
        for label, automaton in self.automata.items():
            if all(w in at for w in automaton.mandatory):
                done = 0
                for k in sorted(k for w in automaton.starts() for k in at.get(w, ())):
                    if k >= done and (end := automaton.match(words, k)) is not None:
                        spans.append((label, k, end))
                        done = end
        score = 1.0 if spans else 0.5 if places else 0.0
        return places, base, {label for label, _, _ in spans}, score, spans


# ---------------------------------------------------------------- the operator


def n_words(text: Column) -> Column:
    marks = F.regexp_replace(text, f"{OUT_WORD}*{IN_WORD}+", "é")  # a mark that is in no separator
    return F.coalesce(F.length(F.regexp_replace(marks, f"{OUT_WORD}+", "")), F.lit(0)).cast("long")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, spans: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score[,
    spans]), one row per row.

    score: 1 if a template accepts words of the text, 0.5 if it holds base phrases alone, else 0.
    Texts that hold none of the words that every template or phrase needs one of never leave the JVM. Null texts count
    as empty; texts are read whole; repeated rows give equal rows; other columns are ignored; an empty table gives an
    empty one.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    scanner = Scanner(templates, phrases)
    # A word of each template and phrase without which it can't match, few words for all: the rarest-looking one.
    needed = {max(words, key=lambda w: (w.startswith((b"licen", b"permi", b"redis")), len(w), w)) for words in [*(a.mandatory for a in scanner.automata.values()), *scanner.phrases]}
    may = F.lower(F.col("text")).rlike("|".join(re.escape(w.decode()) for w in sorted(needed)))
    kind = docs.schema["doc_id"]
    schema = T.StructType([kind]).add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long").add("base_labels", "string").add("labels", "string").add("score", "double")
    if spans:
        schema = schema.add("spans", T.ArrayType(T.StructType().add("label", "string").add("first", "integer").add("stop", "integer")))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("stop", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                places, base, more, score, found = scanner.scan(text) if text else ([], set(), set(), 0.0, [])
                rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, [{"label": a, "first": b, "stop": c} for a, b, c in found]))
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(7 + spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select("doc_id", n_words(F.col("text")).alias("n"), F.when(may, F.col("text")).alias("t")).mapInArrow(run, schema)


def to_regex(template: str) -> str:
    """The template as a regular expression over words that one blank each precedes, for RE2; a blank must follow."""
    out = []
    for k, part in enumerate(MARKUP.split(template)):
        if k % 2 == 0:
            out += [" " + w.decode() for w in words_of(part)]
        else:
            out.append({"optional": "(?:", "/optional": ")?"}.get(part) or f"(?: [^ ]+){{0,{part.split()[1]}}}")
    return "".join(out) + " "


def oracle() -> str:
    """DuckDB's SQL for the query."""
    places = " || ".join("list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in PHRASES)
    base = ", ".join(f"CASE WHEN contains(t, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    more = ", ".join(f"CASE WHEN regexp_matches(t, '{to_regex(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    joined = "array_to_string(list_sort(list_distinct({x})), ',')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
p AS (SELECT *, CASE WHEN contains(t, ' license ') THEN {places} ELSE [] END AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base,
CASE WHEN regexp_matches(t, 'licen|permi|redis') THEN list_filter([{more}], lambda x: x IS NOT NULL) ELSE [] END AS more FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
{joined.format(x='base')} AS base_labels, {joined.format(x='base || more')} AS labels, CASE WHEN len(more) > 0 THEN 1.0::DOUBLE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM p
"""


def query(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), spans=False)
