import pytest

from pagemill.functions import urls


@pytest.mark.parametrize(("text", "normal"), [
    ("HTTP://Ex.COM:80/a/../b?q=1 2#f", "http://ex.com/b?q=1%202#f"),
    ("https://ex.com", "https://ex.com/"),
    ("https://ex.com:443/x", "https://ex.com/x"),
    ("https://ex.com:8443/x", "https://ex.com:8443/x"),
    ("https://ex.com/%7Ea b\\c", "https://ex.com/%7Ea%20b/c"),
    ("https://ex.com/ü", "https://ex.com/%C3%BC"),
    ("https://u:p@ex.com/", "https://u:p@ex.com/"),
    ("mailto:a@b", "mailto:a@b"),
    ("//x/y", None), ("http://exa mple/", None), ("", None), (None, None), ("https://ex.com:99999/", None),
])
def test_normalise(text, normal):
    assert urls.normalise(text) == normal


@pytest.mark.parametrize(("target", "joined"), [
    ("/docs", "https://e.com/docs"), ("x", "https://e.com/d/x"), ("../y?z", "https://e.com/y?z"), ("#h", "https://e.com/d/i?a#h"), ("?q", "https://e.com/d/i?q"),
    ("//h/p", "https://h/p"), ("http://o.com", "http://o.com/"), ("", "https://e.com/d/i?a"), (" ./k ", "https://e.com/d/k"), ("tel:1", "tel:1"),
])
def test_join(target, joined):
    assert urls.join("https://e.com/d/i?a#b", target) == joined


def test_normal_urls_stay():
    for text in ("https://ex.com/a/b?c=d#e", "http://ex.com:81/"):
        assert urls.normalise(urls.normalise(text)) == text
