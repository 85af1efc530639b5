"""Cleaning, scoping, main content, markdown and citations of single documents."""

import pytest

from pagemill import catalogue
from pagemill.functions import codelang, html, markdown, readability, relevance, selectors

PAGE = """<html lang="en"><head><meta charset="utf-8"><title>Bread at home</title>
<script type="application/ld+json">{"hidden": true}</script></head><body>
<div class="wrap">
<form action="/search"><input name="q"><button>Look up</button></form>
<section id="recipe"><h2>Dough</h2>
<p>Mix <b>500 g</b> of flour with <a href="water.html">lukewarm water</a>, then wait.</p>
<ol><li>Knead for ten minutes</li><li>Rest for an hour, or <a href="https://rest.example/why">longer</a></li></ol>
<figure><img src="/img/loaf.jpg" alt="A loaf"></figure>
<blockquote>Slow dough tastes better.</blockquote>
<pre><code>hydration = water / flour</code></pre></section>
<aside><a href="/shop">Our shop</a></aside></div>
<nav><ul><li><a href="/">Home</a></li></ul></nav><style>p{color:red}</style></body></html>
"""
DOUGH = "## Dough\n\nMix **500 g** of flour with {0}, then wait.\n\n1. Knead for ten minutes\n2. Rest for an hour, or {1}\n\n![A loaf](/img/loaf.jpg)\n\n> Slow dough tastes better.\n\n```\nhydration = water / flour\n```\n"


def test_chrome_goes_and_content_stays():
    out = html.strip_chrome(PAGE)
    for gone in ("hidden", "Look up", "Our shop", "Home", "color:red"):
        assert gone not in out
    for stays in ("Bread at home", "Knead", "<blockquote"):
        assert stays in out
    assert html.strip_chrome(out) == out


def test_chrome_nested_and_unclosed():
    assert html.strip_chrome("<nav>a<nav>b</nav>c</nav>d") == "d"
    assert html.strip_chrome("<div><nav>a</div>b") == "<div></div>b"
    assert html.strip_chrome("x<script>if (a < b) {}</script>y") == "xy"
    assert html.strip_chrome('<div class="x copyButton_1">a</div>b<p class="pagination-nav">c</p>') == "b"


def test_golden_default():
    assert markdown.convert(html.strip_chrome(PAGE)) == "Bread at home\n\n" + DOUGH.format("[lukewarm water](water.html)", "[longer](https://rest.example/why)")


def test_golden_main_content():
    title, content = readability.prune(PAGE)
    assert title == "Bread at home"
    md = markdown.convert(content)
    assert "Knead for ten minutes" in md and "hydration = water / flour" in md and "Our shop" not in md


def test_golden_citations():
    out = markdown.cite(markdown.convert(html.strip_chrome(PAGE)), "https://bake.example/bread/dough", True)
    assert out == "Bread at home\n\n" + DOUGH.format("lukewarm water[1]", "longer[2]") + "\n\n## References\n\n[1]: https://bake.example/bread/water.html\n[2]: https://rest.example/why\n"


@pytest.mark.parametrize(("source", "md"), [
    ("<h2>a <em>b</em></h2>", "## a *b*\n"),
    ("<ul><li>one<li>two<ul><li>x</ul></ul>", "- one\n- two\n  - x\n"),
    ("<ol start=3><li>a</li><li>b</li></ol>", "3. a\n4. b\n"),
    ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r\n"),
    ("<p>a<br>b</p>", "a\nb\n"),
    ("<p><b>X<br><p>Y", "**X**\n\n**Y**\n"),
    ("<pre><code class='language-bash'>echo hi</code></pre>", "```bash\necho hi\n```\n"),
    ("<pre><code>def f(x):\n    return x\n</code></pre>", "```python\ndef f(x):\n    return x\n```\n"),
    ("<pre><code>just text</code></pre>", "```\njust text\n```\n"),
    ("<p>a * b_c [d]</p>", "a \\* b\\_c \\[d\\]\n"),
    ("<p>see <a href='/d' title='t'>the d</a></p>", 'see [the d](/d "t")\n'),
    ("<a href='/p'><img src='i.png' alt='pic'></a>", "[![pic](i.png)](/p)\n"),
    ("<hr>", "* * *\n"),
    ("", "\n"),
])
def test_markdown(source, md):
    assert markdown.convert(source) == md


def test_no_links_no_images():
    out = markdown.convert("<p>a <a href='/d'>b</a><img src='x.png' alt='pic'></p>", True, True)
    assert out == "a b\n"


def test_fences_with_several_blocks():
    md = "```language-js x\na\n```\ntext\n```\nSELECT a FROM t;\n```\nmore"
    assert markdown.tag_fences(md) == "```js\na\n```\ntext\n```sql\nSELECT a FROM t;\n```\nmore"


def test_citations():
    cite = lambda md: markdown.cite(md, "https://bake.example/bread/dough")
    assert cite("[oven](../oven) or [stove](/stove), then [that oven](/oven)") == "oven[1] or stove[2], then that oven[1]"
    assert cite("![a loaf](loaf.jpg) beside [its recipe](?id=7)") == "![a loaf](loaf.jpg) beside its recipe[1]"
    assert cite("call `bake[2](loaf)` twice") == "call `bake[2](loaf)` twice"
    assert cite("[no target] and [two words](not a link) [") == "[no target] and [two words](not a link) ["


def test_blank_lines():
    assert markdown.blank_lines("a  \n\n\n\nb\t\n\n") == "a\n\nb\n"
    assert markdown.blank_lines("\n\na") == "\na\n"


@pytest.mark.parametrize(("selector", "found"), [
    ("section ol li", 2), ("body > div > section", 1), ("h2 + p", 1), ("h2 ~ blockquote", 1), ("a[href^='https']", 1), ("aside a, nav a", 2), ("a[href='/shop']", 1),
    ("#recipe", 1), ("#none", 0), ("ol li:nth-child(2) a", 1), ("p:not(.x)", 1), ("*:root", 1), ("li:first-child", 2), (".wrap img[alt]", 1), ("li:last-child", 2),
])
def test_selectors(selector, found):
    assert len(selectors.select(html.parse(PAGE), selector)) == found


def test_selector_scope_and_errors():
    assert selectors.scope("<div class=s>1</div><p>x</p><div class=s>2</div>", "div.s") == '<div class="s">1</div>\n<div class="s">2</div>'
    assert selectors.scope("<p>x</p>", "div") is None
    for bad in (">>>bad", "a[", "p:unknown", "", "a,,b"):
        with pytest.raises(selectors.SelectorError):
            selectors.compile_selector(bad)


def test_prune_keeps_links_and_never_is_empty():
    text = "<html><body><article><p>Read the <a href='/g'>set-up guide</a> first, since what follows builds on it, step by step, until the end of this long enough paragraph of prose.</p></article></body></html>"
    assert "set-up guide" in readability.prune(text)[1]
    assert readability.prune("<html><body><nav>only chrome</nav></body></html>")[1].strip()
    assert readability.prune("")[1] is None


def test_prune_picks_prose_over_link_lists():
    prose = "<div class='content'>" + "".join(f"<p>Sentence {k}, with commas, goes on for a while so that it counts as prose.</p>" for k in range(8)) + "</div>"
    links = "<div class='sidebar'>" + "".join(f"<p><a href='/{k}'>A link with a rather long text in it, {k}</a></p>" for k in range(8)) + "</div>"
    out = readability.prune(f"<html><body>{links}{prose}</body></html>")[1]
    assert "Sentence 7" in out and "rather long" not in out


@pytest.mark.parametrize(("body", "language"), [
    ("#!/usr/bin/env python3\nprint(1)", "python"), ("#!/bin/sh\nif [ 1 ]; then\nfi", "bash"), ("#!/usr/bin/perl\n1;", "perl"), ("#!/bin/fish\nx", "shell"),
    ('fn main() {\n    let mut x = 1;\n    println!("{}", x);\n}', "rust"), ("const add = (a, b) => a + b;\nconsole.log(add(1, 2));", "javascript"),
    ('package main\n\nimport "fmt"\n\nfunc main() {\n}', "go"), ("SELECT a FROM t WHERE b = 1;", "sql"), ('{\n  "a": "x",\n  "b": ["y"]\n}', "json"), ('["a", "b"]', "json"),
    ("<!DOCTYPE html>\n<p>", "html"), ("---\na: b\nc:\n  - d\n", "yaml"), ("body {\n  margin: 0;\n  padding: 0;\n}", "css"), ("npm i -g x", "bash"), ("cd p && make", "bash"),
    ("export A=b", "bash"), ("#include <iostream>\nint main() {\n  std::cout << 1;\n}", "cpp"), ("FROM node\nWORKDIR /a\nRUN x", "dockerfile"),
    ("hi", None), ("", None), (None, None), ("foo\n", None), ("A_TOKEN=123\n", None), ("plain words here", None), ("a=b run me", None), ("PORT=80 serve", "bash"), ("export", "bash"), ("export PATH", "bash"),
    ('{"a": 1, /* x */\n"b": 2}', None), ('{"a": 1,\n"b": [2}', None), ("template <class T>\nT f();", "cpp"),
])
def test_code_language(body, language):
    assert codelang.guess_language(body) == language


DOC = "# Tea\n\nTea is made by pouring hot water over cured leaves.\n\n## Parking\n\nCars stop behind the house.\n\n## Tea pots\n\nPots keep tea and water hot.\n\n## Notes\n\nFixed a typo.\n"


def test_relevance():
    out = relevance.filter_blocks(DOC, "hot tea", 0.5)
    assert "cured leaves" in out and "keep tea" in out and "Cars" not in out
    assert out.index("cured leaves") < out.index("keep tea")
    assert relevance.filter_blocks(DOC, "", 0.5) == DOC
    assert relevance.filter_blocks(DOC, "tea", 1.0) == DOC
    assert relevance.filter_blocks(DOC, "quantum", 0.01).strip()


def test_last_of_several_headings_wins():
    assert relevance.split_blocks("# a\n\n# b\n\ntext\n\n# c") == ["# b\n\ntext", "# c"]


@pytest.mark.parametrize("name", ["markdown_cited", "markdown_documents", "markdown_pages"])
def test_few_bytes_that_become_many_pages_are_dealt_out(spark, sf_dir, name):
    made = catalogue.QUERIES[name](spark, sf_dir)
    tasks = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(tasks) >= 4 * spark.sparkContext.defaultParallelism and max(tasks) < sum(tasks) / 4


def test_plain_tags_are_tags_as_others_are():
    plain, other = "<P>a<B>b</B><br><Script>1<2</Script><h1>c</h1>", "<P >a<B >b</B ><br ><Script >1<2</Script ><h1 >c</h1 >"
    seen = [[(t.kind, t.name, dict(t.attrs), t.raw) for t in html.tokens(x)] for x in (plain, other)]
    assert seen[0] == seen[1] and html.serialise(html.parse(plain)) == html.serialise(html.parse(other))
    quoted = "<p a='>' b=\">\" c>x</p><i 'y>z"
    assert [quoted[t.start : t.end] for t in html.tokens(quoted)] == ["<p a='>' b=\">\" c>", "x", "</p>", "<i 'y>", "z"]
