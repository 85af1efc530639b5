import random
import re

import pytest

from pagemill.llm import licenses as L

SCHEMA = "doc_id long, text string, labels string"


def accepts(template, words):
    """Brute force: every run of words that a template accepts, as (start, longest end)."""
    pattern = re.compile(re.sub(r"\[\^ \]", r"\\S", L.to_regex(template).rstrip(" ")) + r"(?= |$)")
    text, out = " " + " ".join(w.decode() for w in words), []
    for m in range(len(words)):
        at = len(" ".join(w.decode() for w in words[:m])) + (1 if m else 0)
        found = pattern.match(text, at)
        if found:
            out.append(m)
    return out


@pytest.mark.parametrize("template", ["a <<optional>>b<</optional>> c", "<<optional>>x<</optional>> a b", "a <<any 2>> b", "a <<optional>>b <<any 1>> c<</optional>> d", "a<<optional>> b <<optional>>c<</optional>><</optional>> d"])
def test_automata_against_expressions(template):
    automaton, rng = L.compile_template(template), random.Random(2)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"d", b"x"]) for _ in range(rng.randint(0, 7))]
        assert [k for k in range(len(words)) if automaton.match(words, k) is not None] == accepts(template, words)


def test_bad_templates():
    for bad in ("<<optional>>a", "<<optional>>a<</optional>>"):
        with pytest.raises(ValueError):
            L.compile_template(bad)


def test_known_wordings():
    s = L.Scanner(L.TEMPLATES, L.PHRASES)
    assert s.scan("Released under the MIT License.")[:4] == ([3], {"mit"}, {"MIT-notice"}, 1.0)
    assert s.scan("LICENSED under the Apache\nLicense, Version 2.0!")[2] == {"Apache-2.0"}
    assert s.scan("licensed under the GNU General Public License, version 3.")[1:3] == ({"gpl"}, {"GPL-3.0"})
    assert s.scan("Licensed under CC BY-NC 4.0.")[2] == {"CC-BY-NC-4.0"}
    mit = re.sub(r"<<.*?>>", "", L.TEMPLATES["MIT"])
    assert "MIT" in s.scan("before " + mit)[2]
    assert "MIT" not in s.scan(mit.replace("without restriction", "with restriction"))[2]
    assert s.scan("the apache license and the apache license")[:2] == ([1, 5], {"apache"})
    assert s.scan("mit-license mit; LICENSE")[0] == [0, 2] and s.scan("emit license")[0] == [] and s.scan("mit licenseé")[0] == []


def test_operator(spark):
    rows = [(1, "x MIT License y", "q"), (2, None, "q"), (3, "", "q"), (4, "nothing", "q"), (4, "nothing", "q"), (None, "Apache License é ü1", "q"), (5, "w " * 50_000 + "Released under the MIT License", "q")]
    out = L.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 7 and [got[k]["n_words"] for k in (1, 2, 3, 4, None, 5)] == [4, 0, 0, 1, 4, 50_005]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (1, 1, 1, "mit", 0.5)
    assert got[4]["first_word"] is None and got[4]["labels"] == "" and got[5]["labels"] == "MIT-notice,mit" and got[5]["first_word"] == 50_003
    assert [tuple(s) for s in got[5]["spans"]] == [("MIT-notice", 50_000, 50_005)]
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0
