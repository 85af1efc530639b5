"""Properties that hold for any text."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions import charset, html, markdown, readability, relevance, robots, sitemap, urls

PIECES = st.lists(st.sampled_from(["<p>", "</p>", "<nav>", "</nav>", "<div class='x'>", "</div>", "<b>", "</b>", "text ", "<br>", "<li>", "<ul>", "</ul>", "&amp;", "<", ">", "<!-- c -->", "<script>", "</script>", "<a href='/x'>", "</a>", "<td>", "<table>", "</table>", "\n\n", "`", "é", "# "]), max_size=25).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_any_markup_is_handled(text):
    once = html.strip_chrome(text)
    assert html.strip_chrome(once) == once or "<script" in text or "<nav" in text
    assert "".join(text[t.start : t.end] for t in html.tokens(text)) == text
    md = markdown.convert(text)
    assert md.endswith("\n") and "\n\n\n" not in md and markdown.blank_lines(md) == md
    readability.prune(text)
    assert html.serialise(html.parse(html.serialise(html.parse(text)))) is not None


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_urls_normalise_once(text):
    for url in (urls.normalise(text), urls.join("https://e.com/a/b?c#d", text)):
        if url is not None and url.startswith("http"):
            assert urls.normalise(url) == url


@given(st.lists(st.sampled_from(["# h", "text", "", "## k", " a b ", "x\ny"]), max_size=10), st.sampled_from(["text", "a k", "none"]), st.floats(0.01, 1))
@settings(max_examples=200, deadline=None)
def test_filters_keep_whole_blocks(parts, query, keep):
    md = "\n\n".join(parts)
    blocks = relevance.split_blocks(md)
    out = relevance.filter_blocks(md, query, keep)
    assert out == md or all(b in blocks for b in relevance.split_blocks(out)) or "# " in out
    assert bool(out.strip()) == bool(md.strip())


@given(st.binary(max_size=200))
def test_bytes_never_fail(body):
    sitemap.locations(body)
    sitemap.unpack("x.gz", body)
    assert isinstance(charset.decode(None, body), str)
    robots.parse(body.decode("latin-1")).allowed("/x")


@given(st.text("ab*$/", max_size=8), st.text("ab/", max_size=8))
def test_robots_patterns(pattern, path):
    def plain(p, s):
        if p == "$":
            return s == ""
        if not p:
            return True
        if p[0] == "*":
            return any(plain(p[1:], s[k:]) for k in range(len(s) + 1))
        return bool(s) and s[0] == p[0] and plain(p[1:], s[1:])

    if "$" not in pattern[:-1]:
        assert robots.matches(pattern, path) == plain(pattern, path)
