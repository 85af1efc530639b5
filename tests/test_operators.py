"""DataFrame operators against small inputs, and every query that has SQL against DuckDB."""

import io
import random
import re
import time
from collections import deque

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import catalogue
from pagemill.functions import expressions as E
from pagemill.functions import relevance as R
from pagemill.functions import robots as RB
from pagemill.functions import udfs
from pagemill.operators import corpus, crawl, pages, robots, sitemaps
from pagemill.options import Options
from pagemill.sinks import files
from pagemill.streaming import pages as streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    found = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, r)) for r in found.fetchall()]
    want = sorted((tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(names)) for r in want), key=str)
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_page_errors(spark):
    raw = spark.createDataFrame([(1, "https://e.com/", "<body><nav>x</nav></body>"), (2, "https://e.com/b", "<title>T</title><p>b</p><a href='c'>c</a>"), (3, "https://e.com/n", None)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in pages.transform_pages(pages.raw_pages(raw)).collect()}
    assert out[1]["error"]["kind"] == "NoContent" and out[1]["markdown"] is None and out[3]["error"]["kind"] == "NoContent"
    assert out[2]["markdown"] == '---\ntitle: "T"\nsource: https://e.com/b\ntokens: 6\n---\n\nT\n\nb\n\n[c](c)\n' and out[2]["links"] == ["https://e.com/c"]
    assert pages.good_pages(pages.transform_pages(pages.raw_pages(raw))).count() == 1
    bad = pages.transform_pages(pages.raw_pages(raw), Options(css=">>>"))
    assert {r["error"]["kind"] for r in bad.collect()} == {"Parse"}
    with pytest.raises(pages.PageError):
        pages.single_page(pages.transform_pages(pages.raw_pages(raw.where("page_id = 1"))))


def test_pipeline_stays_one_projection(spark, sf_dir):
    df = pages.transform_pages(pages.raw_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    plan = pages.good_pages(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") <= 2 and plan.count("run(html") == 1


def test_blocks_as_a_column(spark):
    rng = random.Random(4)
    docs = [(k, "\n\n".join(rng.choice(["# h", "## tea", "tea time", "water", " ", "", "# x\ny"]) for _ in range(rng.randint(0, 8)))) for k in range(60)]
    df = spark.createDataFrame([*docs, (99, None)], "id long, text string")
    got = {r["id"]: r["b"] for r in df.select("id", udfs.md_blocks("text", F.lit("tea")).alias("b")).collect()}
    assert got.pop(99) is None
    for k, text in docs:
        assert [x["block"] for x in got[k]] == R.split_blocks(text) and [x["score"] for x in got[k]] == R.scores(R.split_blocks(text), "tea")
    assert "Exchange" not in df.select(udfs.md_filter("text", F.lit("tea")))._jdf.queryExecution().executedPlan().toString()


def test_robots_in_both_forms(spark):
    rng = random.Random(2)
    patterns = ["/", "/*", "*", "$", "/$", "/a*$", "/*a$", "/a*b*c", "/**b", "*.pdf$", "/a$b", "/é*"] + ["".join(rng.choice("/ab*") for _ in range(rng.randint(1, 6))) + rng.choice(["", "$"]) for _ in range(60)]
    paths = ["/"] + ["/" + "".join(rng.choice("abc/é") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    to_regex = lambda p: "(?s)" + ".*".join(re.escape(x) for x in p.removesuffix("$").split("*")) + (r"\Z" if p.endswith("$") else "")
    want = {(p, x): re.match(to_regex(p), x) is not None for p in patterns for x in paths}
    assert {k: RB.matches(*k) for k in want} == want
    bodies = spark.createDataFrame([(f"https://h{k}.com", f"User-agent: *\nDisallow: {p}") for k, p in enumerate(patterns)], "origin string, body string")
    urls = spark.createDataFrame([(f"https://h{k}.com{x}", p, x) for k, p in enumerate(patterns) for x in paths], "url string, pattern string, path string")
    got = robots.allowed(urls, robots.parsed(bodies)).collect()
    assert {(r["pattern"], r["path"]): not r["allowed"] for r in got} == want


def test_hostile_robots_patterns(spark):
    pattern, path = "/" + "*a" * 40 + "$", "/" + "a" * 20_000 + "b"
    began = time.perf_counter()
    assert not RB.matches(pattern, path) and time.perf_counter() - began < 0.01
    rules = robots.parsed(spark.createDataFrame([("https://e.com", f"User-agent: *\nDisallow: {pattern}")], "origin string, body string"))
    began = time.perf_counter()
    assert robots.allowed(spark.createDataFrame([("https://e.com" + path,)] * 50, "url string"), rules).where("allowed").count() == 50
    assert time.perf_counter() - began < 20  # a regular expression of this pattern never ends


def test_numbers_with_nulls_and_hashed_ids(spark):
    rows = [(None if k % 50 == 0 else hash((k, 1)), f"https://e.com/{k}") for k in range(700)]
    got = corpus.numbered(spark.createDataFrame(rows, "page_id long, url string").repartition(7)).orderBy("ix").collect()
    assert [r["ix"] for r in got] == list(range(1, 701)) and {r["total"] for r in got} == {700} and {r["url"] for r in got} == {u for _, u in rows}
    assert [r["page_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert corpus.numbered(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_render_without_gathering(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    monkeypatch.setattr(corpus, "_gathered", None)
    rows = [(k, f"https://e.com/{k}", None if k % 3 else f"T{k}", f"body {k}\n", 3) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, title string, markdown string, tokens long")
    out = io.StringIO()
    files.render(df, Options(url="https://e.com"), out)
    assert out.getvalue() == "\n\n---\n\n".join(f"body {k}" for k in range(40)) + "\n"
    files.render(df, Options(url="https://e.com", output_dir=str(tmp_path / "o")))
    text = (tmp_path / "o" / "llms.txt").read_text()
    assert text.startswith("# e.com\n\n> Total documents: 40 (~120 tokens)\n") and text.count("\n- [") == 40 and len((tmp_path / "o" / "docs.jsonl").read_text().splitlines()) == 40


def plain_bfs(links, start, depth, cap):
    queue, seen, out = deque([(start, 0)]), set(), []
    while queue and len(out) < cap:
        now, d = queue.popleft()
        if now in seen:
            continue
        seen.add(now)
        out.append((now, d))
        if d < depth:
            queue.extend((x, d + 1) for x in links.get(now, ()))
    return out


def test_crawl_orders(spark):
    rng = random.Random(7)
    links = {k: [rng.randrange(25) for _ in range(rng.randint(0, 4))] for k in range(25)}
    edges = spark.createDataFrame([(k, p, x) for k, v in links.items() for p, x in enumerate(v)], "src long, pos int, dst long")
    start = spark.createDataFrame([(0, 0), (3, 3)], "root long, node long")
    got = crawl.bfs(edges, start, 3, 8).collect()
    for root in (0, 3):
        assert [(r["node"], r["depth"]) for r in sorted((r for r in got if r["root"] == root), key=lambda r: r["rank"])] == plain_bfs(links, root, 3, 8)
    one = crawl.dfs(edges.withColumn("root", F.lit(0).cast("long")), 3, 8).orderBy("rank").collect()
    stack, seen, want = [(0, 0)], set(), []
    while stack and len(want) < 8:
        now, d = stack.pop()
        if now in seen:
            continue
        seen.add(now)
        want.append((now, d))
        if d < 3:
            stack.extend((x, d + 1) for x in links[now])
    assert [(r["node"], r["depth"]) for r in one] == want


def test_sitemap_limit_and_order(spark):
    body = lambda inner: bytearray(inner.encode())
    docs = spark.createDataFrame([
        ("https://e.com/i.xml", body("<sitemapindex><sitemap><loc>https://e.com/1.xml</loc></sitemap><sitemap><loc>https://e.com/2.xml</loc></sitemap></sitemapindex>")),
        ("https://e.com/1.xml", body("<urlset><url><loc>https://e.com/a</loc></url><url><loc>https://x.org/b</loc></url></urlset>")),
        ("https://e.com/2.xml", body("<urlset><url><loc>https://docs.e.com/c</loc></url><url><loc>https://e.com/a</loc></url></urlset>")),
    ], "url string, body binary")
    got = sitemaps.collect_urls(docs, ["https://e.com/i.xml", "https://e.com/none.xml"], "e.com", limit=5).orderBy("ord").collect()
    assert [r["url"] for r in got] == ["https://docs.e.com/c", "https://e.com/a"]
    assert sitemaps.collect_urls(docs, ["https://e.com/i.xml"], "e.com", limit=1).count() == 1


def test_llms_table(spark):
    rows = [("o1", 0, 404, "text/html", "x"), ("o1", 1, 200, "text/plain", "# enough text"), ("o2", 0, None, None, None), ("o2", 1, 200, "text/plain", "# enough text"), ("o3", 0, 200, "text/plain", "tiny"), ("o4", 0, 200, "text/plain", "# the full text"), ("o4", 1, 200, "text/plain", "# the other one")]
    got = sitemaps.llms_full_text(spark.createDataFrame(rows, "origin string, priority int, status int, content_type string, body string")).collect()
    assert sorted(tuple(r) for r in got) == [("o1", "# enough text"), ("o4", "# the full text")]


def test_sql_functions(spark):
    udfs.register(spark)
    row = spark.sql("SELECT html_to_md(html_strip_chrome('<nav>n</nav><h1>T</h1>'), false, false) AS md, url_join('https://e.com/a/', 'b') AS u").first()
    assert tuple(row) == ("# T\n", "https://e.com/a/b")
    got = spark.sql("SELECT * FROM sitemap_locs(encode('<urlset><url><loc>https://e.com/a</loc></url></urlset>', 'utf-8'))").collect()
    assert [tuple(r) for r in got] == [("https://e.com/a", "page")]


def test_expressions_on_edges(spark):
    texts = ["", "a", "a\n", "\n", "a\r\nb", "x" * 39]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.tokens(F.col("t"))).collect()]
    assert got == [0, 1, 1, 1, 2, 11]
    url = spark.createDataFrame([("https://ex.com/",), ("https://ex.com/docs/",), ("https://ex.com/a?b=c&d",), ("https://ex.com/g/index",)], "u string")
    assert [r[0] for r in url.select(E.slug(F.col("u"))).collect()] == ["index", "docs", "a", "g-index"]


def test_incremental_pages(spark, tmp_path):
    spark.createDataFrame([(1, "https://e.com/a", "<p>a</p>"), (2, "https://e.com/a", "<p>a</p>"), (3, "https://e.com/b", "<p>b</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    streams.append_pages(streams.stream_pages(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["https://e.com/a", "https://e.com/b"]
