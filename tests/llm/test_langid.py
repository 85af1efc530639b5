import zlib
from itertools import product

import numpy as np
import pytest

from pagemill.llm import common
from pagemill.llm import langid as L

WORDS = {"en": "the house and river with stone water under light", "de": "der Fluss und das Haus mit Stein über Wasser nicht", "ru": "дом река камень вода свет под и не на", "el": "σπίτι ποτάμι πέτρα νερό φως και στο"}


def labelled(spark):
    rows = [(k, " ".join(np.random.default_rng(k).choice(WORDS[lang].split(), 30)), lang) for k, lang in enumerate(list(WORDS) * 20)]
    rows += [(900, None, "en"), (901, "x y z", None), (None, "the and", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(spark):
    return L.train_on_folds(labelled(spark))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.normal(0, 3, (rng.integers(1, 7), 3)).astype(np.float32)
        cost = lambda p: sum(float(scores[i, x]) for i, x in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(product(range(3), repeat=len(scores)), key=cost)
        assert cost(L.viterbi(scores.copy(), 4.0).tolist()) == pytest.approx(cost(best), abs=1e-4)


def test_features_don_t_depend_on_neighbours():
    words = ["zz", "abc", "é", "日本"]
    numbers, first, script = L.features(words)
    for k, w in enumerate(words):
        own = numbers[first[k] : first[k + 1] if k + 1 < len(words) else None]
        assert sorted(own) == sorted(L.features([w])[0])
    assert [L.NAMES[s] for s in script] == ["Latin", "Latin", "Latin", "Han"]


def test_predictions(spark, model):
    assert set(model.langs) == set(WORDS)  # the row without a doc_id taught nothing
    cases = [(1, "The house and the river"), (2, "Haus und Fluss"), (3, "река и дом"), (4, "νερό και φως"), (5, None), (6, ""), (7, "123 ... !"), (8, "日本語の文"), (8, "日本語の文"), (None, "water")]
    df = spark.createDataFrame([(*c, "x") for c in cases], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in L.identify(df, model).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 8)] == ["en", "de", "ru", "el", "und", "und", "und"]
    assert got[8]["lang_pred"] in WORDS and got[8]["score"] == 0.0 and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_mixed_text_has_spans(spark, model):
    text = "the house and the river with stone and water " * 2 + "der Fluss und das Haus mit Stein nicht Wasser " * 3
    row = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de"] and abs(row["spans"][0]["stop"] - 18) <= 2 and row["lang_pred"] == "de"


def test_long_text_equals_short(model, spark, monkeypatch):
    text = WORDS["de"] + " " + WORDS["ru"] + " " + WORDS["en"]
    one = L.identify(spark.createDataFrame([(1, text * 50)], "doc_id long, text string"), model).first()
    assert one["lang_pred"] in ("en", "de") and sum(s["stop"] - s["first"] for s in one["spans"]) == len(L.words_of(text * 50))


def test_chunks_change_nothing(model, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(" ".join(rng.choice(WORDS[x].split(), rng.integers(1, 40))) for x in rng.choice(list(WORDS), 6)) for _ in range(60)]
    whole = [L.label(t, L.Known(model), L.PENALTY) for t in texts]
    monkeypatch.setattr(L, "CHUNK", 7)
    assert len(list(L.word_chunks(texts[0]))) > 3
    for t, (lang, score, spans) in zip(texts, whole):
        got = L.label(t, L.Known(model), L.PENALTY)
        assert got[0] == lang and got[2] == spans and got[1] == pytest.approx(score)


def test_against_plain_python(model):
    """Scores word by word, all paths' best by a table, votes and probability: nothing shared but the model's numbers."""
    rng = np.random.default_rng(9)
    for _ in range(40):
        words = " ".join(" ".join(rng.choice(WORDS[x].split(), rng.integers(3, 30))) for x in rng.choice(list(WORDS), 3)).lower().split()
        scores = [model.score([w])[0].astype(float).tolist() for w in words]
        n = len(model.langs)
        sums, back = [scores[0]], []
        for row in scores[1:]:
            ways = [max((sums[-1][j] - (L.PENALTY if j != k else 0), -j, j) for j in range(n)) for k in range(n)]
            back.append([w[2] for w in ways])
            sums.append([w[0] + s for w, s in zip(ways, row)])
        path = [max(range(n), key=lambda k: sums[-1][k])]
        for step in reversed(back):
            path.append(step[path[-1]])
        path = path[::-1]
        sure = [any(row) for row in scores]
        votes = [sum(s and p == k for s, p in zip(sure, path)) for k in range(n)]
        best = max(range(n), key=lambda k: (votes[k], -k))
        total = [sum(row[k] for row, s, p in zip(scores, sure, path) if s and p == best) for k in range(n)]
        chance = 1 / sum(np.exp(min(t - total[best], 50)) for t in total)
        got = L.label(" ".join(words), L.Known(model), L.PENALTY)
        assert got[0] == model.langs[best] and got[1] == pytest.approx(chance * votes[best] / sum(votes), abs=1e-6)


def test_marks_belong_to_words():
    assert L.words_of("हिन्दी भाषा, ภาษาไทย! cafe\u0301 x² 12") == ["हिन्दी", "भाषा", "ภาษาไทย", "cafe\u0301", "x"]
    assert L.words_of("Été x² ½ ² 日本") == ["été", "x²", "日本"] and L.words_of("a_b 1c") == ["a", "b", "c"]


def test_nothing_learned(spark):
    none = L.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    rows = L.identify(spark.createDataFrame([(1, "the house")], "doc_id long, text string"), none).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]
    assert L.identify(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = common.documents(spark, d)
    rows = L.query(spark, d).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_stage_keeps_clean_documents(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    extra = spark.createDataFrame([(90001, "!!! 12", "en", "s", 6), (90002, None, "en", "s", 0)], docs.schema)
    kept = L.stage(spark, docs.unionByName(extra), sf_dir)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def stage_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"] for r in L.stage(spark, docs, "").collect()}


def test_stage_keeps_mixed_texts(spark, model):
    learned = [tuple(r) for r in labelled(spark).where("doc_id < 900").collect()]
    parts = [" ".join(np.random.default_rng(7).choice(WORDS[x].split(), 40)) for x in WORDS]
    row = L.identify(spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == list(WORDS) and 0 < row["score"] < 0.3  # labelled span by span
    extra = [(1000, " ".join(parts), None), (1001, "日本語の文", None), (1002, "12 !", "en"), (1003, None, "en")]
    assert stage_ids(spark, learned + extra) == {r[0] for r in learned} | {1000}


def test_stage_when_one_language_or_none_was_learned(spark):
    rows = [(k, f"the house and river {k}", "en") for k in range(30)] + [(40, "日本語の文", None), (41, "12 !", None), (42, None, None)]
    assert stage_ids(spark, rows) == set(range(30))
    assert stage_ids(spark, [(k, t, None) for k, t, _ in rows]) == {*range(30), 40}
