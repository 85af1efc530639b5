"""Robots, sitemaps, charsets, fetching from a local server, options and the command line."""

import gzip
import http.server
import threading
import time

import pytest

from pagemill.cli import parse
from pagemill.cli import parser as cli_parser
from pagemill.functions import charset, robots, sitemap
from pagemill.options import DeepStrategy, Options
from pagemill.sources import http as H
from pagemill.sources import site


def test_robots_longest_match():
    r = robots.parse("User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nCrawl-delay: 20\nSitemap: https://e.com/s.xml")
    assert [r.allowed(p) for p in ("/a/x", "/a/b/c", "/x.pdf", "/x.pdfs", "/")] == [False, True, False, True, True]
    assert r.delay == robots.LONGEST_DELAY and r.sitemaps == ["https://e.com/s.xml"]


def test_robots_groups():
    r = robots.parse("User-agent: other\nUser-agent: pagemill\nDisallow: /x\n\nUser-agent: *\nDisallow: /")
    assert r.allowed("/y") and not r.allowed("/x/1")
    assert robots.parse(None).allowed("/") and robots.parse("<html>").allowed("/")


def test_sitemap_documents():
    ns = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://e.com/a?x=1&amp;y=2 </loc></url></urlset>'
    assert sitemap.locations(ns.encode()) == (["https://e.com/a?x=1&y=2"], [])
    assert sitemap.locations(b"<sitemapindex><sitemap><loc>https://e.com/s.xml</loc></sitemap></sitemapindex>") == ([], ["https://e.com/s.xml"])
    assert sitemap.locations(b"<urlset><url><loc>https://e.com/x</loc></urlset>")[0] == ["https://e.com/x"]
    assert sitemap.locations(b"& <loc>https://e.com/x</loc><loc>https://e.com/sitemap-2</loc><loc>ftp:y</loc>") == (["https://e.com/x"], ["https://e.com/sitemap-2"])
    assert sitemap.locations(b"") == ([], [])
    assert sitemap.looks_like_sitemap("https://e.com/SITEMAP_1") and not sitemap.looks_like_sitemap("https://e.com/a")
    assert sitemap.unpack("x.gz", gzip.compress(b"abc")) == b"abc" and sitemap.unpack("x.gz", b"abc") == b"abc" and sitemap.unpack("x", gzip.compress(b"q")) == b"q"


def test_charsets():
    latin = "<h1>café</h1>".encode("latin-1")
    assert charset.decode("text/html; charset=iso-8859-1", latin) == "<h1>café</h1>"
    assert "café" in charset.decode("text/html", b'<meta charset="iso-8859-1">' + latin)
    assert charset.decode("text/html; charset=nonsense", "é".encode()) == "é"
    assert charset.decode(None, b"\xef\xbb\xbfx") == "x"


def test_options():
    o = Options(refs=True, full=True, concurrency=9999).normalised()
    assert o.citations and o.browser and o.concurrency == 256 and o.page_limit() is None
    options, show = parse(["https://e.com", "--deep", "dfs", "--pages", "3", "--print-options"])
    assert options.deep is DeepStrategy.DFS and options.page_limit() == 3 and show
    again, _ = parse(options.command().split()[1:])
    assert again == options
    with pytest.raises(SystemExit):
        parse(["https://e.com", "--deep", "sideways"])
    text = cli_parser().format_help()
    for flag in ("output output-dir site match prune query citations refs raw css full deep pages no-links no-images timeout concurrency max-depth browser ignore-robots no-metadata verbose").split():
        assert f"--{flag}" in text


class Server(http.server.ThreadingHTTPServer):
    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.hits, self.pages, self.flaky = [], {}, 1
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def base(self):
        return f"http://127.0.0.1:{self.server_address[1]}"


class Handler(http.server.BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def do_GET(self):
        s = self.server
        s.hits.append(self.path)
        if self.path == "/flaky" and s.flaky:
            s.flaky -= 1
            self.send_response(503)
            self.end_headers()
            return
        if self.path == "/old":
            self.send_response(301)
            self.send_header("Location", "/new")
            self.end_headers()
            return
        found = s.pages.get(self.path)
        self.send_response(200 if found else 404)
        self.send_header("Content-Type", found[0] if found else "text/html")
        self.end_headers()
        self.wfile.write(found[1] if found else b"<p>missing</p>")


@pytest.fixture
def server():
    s = Server()
    page = lambda body: ("text/html", body.encode())
    s.pages = {
        "/new": page("<h1>new</h1>"), "/flaky": page("<h1>ok</h1>"), "/latin": ("text/html; charset=iso-8859-1", "<h1>café</h1>".encode("latin-1")),
        "/a": page("<title>A</title><p>a</p><a href='/b'>b</a><a href='/private/x'>x</a>"), "/b": page("<title>B</title><p>b</p><a href='/c'>c</a><a href='/a'>a</a>"), "/c": page("<title>C</title><p>c</p>"),
        "/private/x": page("secret"), "/robots.txt": ("text/plain", b"User-agent: *\nDisallow: /private/"),
        "/sitemap.xml": ("text/xml", f"<sitemapindex><sitemap><loc>{s.base}/s1.xml</loc></sitemap></sitemapindex>".encode()),
        "/s1.xml": ("text/xml", f"<urlset><url><loc>{s.base}/a</loc></url><url><loc>{s.base}/b</loc></url><url><loc>http://evil.test/c</loc></url></urlset>".encode()),
    }
    yield s
    s.shutdown()


def test_fetch(server):
    e = H.HttpEngine(Options(), sleep=lambda s: None)
    assert e.fetch(server.base + "/old")["final_url"].endswith("/new")
    assert e.fetch(server.base + "/flaky")["html"] == "<h1>ok</h1>"
    assert "café" in e.fetch(server.base + "/latin")["html"]
    assert e.fetch(server.base + "/none")["status"] == 404
    with pytest.raises(H.FetchError):
        e.fetch("http://127.0.0.1:9/")
    with pytest.raises(H.FetchError, match="engine"):
        H.engine(Options(browser=True))


def test_body_cap():
    class Endless:
        def read(self, n):
            return b"x" * n

    with pytest.raises(H.FetchError, match="TooLarge"):
        H.read_capped(Endless(), "u", 1 << 20)


def test_politeness(server):
    rows = sorted(H.fetch_rows(iter([{"page_id": k, "url": server.base + p} for k, p in enumerate(("/a", "/private/x", "/b"))]), Options()), key=lambda r: r["page_id"])
    assert [r["status"] for r in rows] == [200, None, 200] and rows[1]["error"]["kind"] == "Robots"
    assert server.hits.count("/robots.txt") == 1
    assert [r["status"] for r in H.fetch_rows(iter([{"page_id": 0, "url": server.base + "/private/x"}]), Options(ignore_robots=True))] == [200]


def test_crawl_delay(server):
    server.pages["/robots.txt"] = ("text/plain", b"User-agent: *\nCrawl-delay: 0.05")
    began = time.monotonic()
    list(H.fetch_rows(iter([{"page_id": k, "url": server.base + "/a"} for k in range(3)]), Options()))
    assert time.monotonic() - began >= 0.1


def test_slow_origin_holds_up_no_other(server):
    """Rows come as they are ready: an origin with a delay goes on while others are done."""
    slow, fast = Server(), server
    slow.pages = {"/a": ("text/html", b"<p>a</p>"), "/robots.txt": ("text/plain", b"User-agent: *\nCrawl-delay: 0.3")}
    rows = [{"page_id": k, "url": f"{(slow if k < 3 else fast).base}/a"} for k in range(23)] + [{"page_id": 23, "url": None}, {"page_id": 24, "url": f"{slow.base}/a"}]
    began = time.monotonic()
    got = [r["page_id"] for r in H.fetch_rows(rows, Options(concurrency=2))]
    assert time.monotonic() - began >= 0.9 and sorted(got) == list(range(25)) and got[-3:] == [1, 2, 24]
    assert slow.hits.count("/robots.txt") == fast.hits.count("/robots.txt") == 1
    slow.shutdown()


def test_deep_crawl_keeps_rules_and_delay(server):
    server.pages["/robots.txt"] = ("text/plain", b"User-agent: *\nCrawl-delay: 0.1\nDisallow: /private/")
    began = time.monotonic()
    rows = site.deep(Options(url=server.base + "/a", deep=DeepStrategy.BFS), lambda raw: (raw["final_url"], [server.base + "/b", server.base + "/private/x", server.base + "/c"]))
    assert [u.rsplit("/", 1)[1] for u in rows] == ["a", "b", "c"] and time.monotonic() - began >= 0.2
    assert server.hits.count("/robots.txt") == 1


def test_events_of_a_run(spark, server):
    from pagemill.operators import progress

    places = spark.createDataFrame([(k, server.base + p) for k, p in enumerate(("/a", "/private/x", "/none"))], "page_id long, url string")
    raw = spark.createDataFrame(H.fetch_pages(places, Options()).collect(), H.schema.RAW_PAGE)
    events = progress.run_events(raw)
    assert {(f.name, f.dataType) for f in events.schema} == {(f.name, f.dataType) for f in H.schema.EVENT}
    found = {(r["kind"], r["total"], r["url"], r["error"] and r["error"].split(":")[0]) for r in events.collect()}
    assert found == {("started", 3, None, None), ("finished", None, None, None), ("page_done", None, server.base + "/a", None), ("error", None, server.base + "/private/x", "Robots"), ("error", None, server.base + "/none", "status 404")}
    assert progress.counters(events).first().asDict() == {"processed": 1, "errors": 2, "started": 1, "finished": 1}


def test_site_discovery(server):
    assert site.site_urls(server.base + "/", Options()) == [server.base + "/a", server.base + "/b"]
    assert site.site_urls(server.base + "/", Options(match_pattern="/b")) == [server.base + "/b"]
    assert site.site_urls(server.base + "/", Options(max_pages=1)) == [server.base + "/a"]
    assert site.llms_text(server.base, Options()) is None
    server.pages["/llms.txt"] = ("text/plain", b"# All of it, in markdown")
    assert site.llms_text(server.base, Options()).startswith("# All")


def test_runs(spark, server, tmp_path):
    from pagemill.run import pages, run
    from pagemill.sources.web import register

    assert [r["title"] for r in pages(spark, Options(url=server.base + "/a")).collect()] == ["A"]
    assert sorted(r["title"] for r in pages(spark, Options(url=server.base + "/", site=True)).collect()) == ["A", "B"]
    for deep in DeepStrategy:
        assert [r["title"] for r in pages(spark, Options(url=server.base + "/a", deep=deep)).orderBy("page_id").collect()] == ["A", "B", "C"]
    run(spark, Options(url=server.base + "/", site=True, output_dir=str(tmp_path)))
    assert {p.name for p in tmp_path.iterdir()} == {"00_INDEX.md", "llms.txt", "FULL_CONTEXT.md", "docs.jsonl", "01_a.md", "02_b.md"}
    run(spark, Options(url=server.base + "/", site=True, output=str(tmp_path / "all.md"), no_metadata=True))
    assert (tmp_path / "all.md").read_text().count("\n---\n") == 1
    register(spark)
    rows = spark.read.format("webpages").option("urls", f"{server.base}/a {server.base}/private/x").load().collect()
    assert sorted((r["status"], r["error"] and r["error"]["kind"]) for r in rows if r["status"]) == [(200, None)] and len(rows) == 2
