"""Every query and the pipeline over tables with nulls everywhere, repeated rows, clashing columns, and over empty ones."""

import pytest

import corpus_pipeline
from pagemill.llm import registry

EXTRA = ", size string, taken long, score string, shard int, slot string, fp long, _fp string, _shard long, _order long, lang_pred string, class int, part int, component_id int, n_replaced string, row int, _rest string, h1 long, codes string, rank int"
DOCS = [
    (1, "the quick brown fox and a lazy dog, mail a.b@mail1.example.com", "en", "s1", 60), (2, None, "en", "s1", None), (3, "", None, None, 0), (4, " \t\n ", "de", "s2", 4), (None, "no id here at all", "en", "s1", 17),
    (None, None, None, None, None), (5, "der schnelle braune Fuchs und ein fauler Hund", "de", "s2", 45), (5, "der schnelle braune Fuchs und ein fauler Hund", "de", "s2", 45), (6, "1234 5678 !!!", "en", None, 13),
    (7, "long words " * 30_000, "en", "s1", 330_000), (8, "Released under the MIT License", "fr", "", 30), (8, "another text of the same number", "fr", "", 31), (9, "日本語 Привет Γειά", None, "s3", 15),
]
PAGES = [(1, "https://e.com/a", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (None, "u", None), (3, "", ""), (3, "", ""), (None, None, None)]
VECTORS = [(0, [1.0, 0.0], 1), (20, [1.0, 0.01], 1), (1, [1.0, 0.0], None), (2, None, 2), (3, [0.0, 0.0], 2), (4, [None, 1.0], 2), (None, [1.0, 0.0], 2), (5, [], 0), (20, [1.0, 0.01], 1)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp(request.param))
    for name, rows, schema in (("documents", DOCS, "doc_id long, text string, lang string, source string, n_chars long"), ("pages", PAGES, "page_id long, url string, html string"), ("embeddings", VECTORS, "vec_id long, embedding array<float>, label int")):
        n = len(EXTRA.split(",")) - 1
        spark.createDataFrame([(*r, *[None] * n) for r in rows] if request.param == "odd" else [], schema + EXTRA).write.parquet(f"{folder}/{name}.parquet")
    return request.param, folder


ROWS = {"op1_mixing": len(DOCS), "op2_pivots": len(VECTORS), "op3_warc": len(PAGES), "op5_licenses": len(DOCS), "op6_resharding": len(DOCS), "op7_pii": len(DOCS), "op8_langid": len(DOCS), "op9_simhash": len(DOCS)}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, tables, name):
    kind, folder = tables
    rows = registry.QUERIES[name](spark, folder).collect()
    if kind == "empty":
        assert rows == []
    elif name in ROWS:
        assert len(rows) == ROWS[name]
    elif name == "op10_additive":
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows) == sorted([(0, 1, 1), (0, 2, 20), (0, 3, 20)] + [(20, 1, 0), (20, 2, 1)] * 2)
    else:
        assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 1


def test_pipeline(spark, tables):
    kind, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert len(docs.columns) == 5 + len(EXTRA.split(",")) - 1, name
    assert (docs.count() > 0) == (kind == "odd")
    assert (corpus_pipeline.run(spark, folder).count() > 0) == (kind == "odd")
